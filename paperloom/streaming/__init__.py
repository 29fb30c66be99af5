"""Corpora that grow: files as they arrive, to which all tables of ``sources`` apply as to a corpus at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_pdf(spark: SparkSession, path: str, glob: str = "*.pdf", files_a_batch: int = 1_000) -> DataFrame:
    """(doc_id, path, bytes) of the files of a folder as they arrive, at most so many in a batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("bytes"))
