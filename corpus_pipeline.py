"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, packing.

Each stage reads what the one before kept.  All but the last return the columns of
``documents``; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import packing, similar, substrings, toxicity
from paperloom.llm.shared import Scratch
from paperloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    ship(spark)
    rejected = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang", "source", "n_chars", keep_text=True)
    return rejected.where("predicted = 0").select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word similarity of 0.8 or more, the row with the smallest doc_id.

    Rows are judged, not ids: of rows that repeat a doc_id and are alike one stays, those that
    are unlike all stay.  Null doc_ids come after all others.
    """
    ship(spark)
    return similar.one_of_group(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows."""
    ship(spark)
    cut = substrings.remove_repeats(docs, "lang", "source", texts=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences of 1024."""
    ship(spark)
    return packing.pack(docs, ids=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", keep_one_of_group), ("substring dedup", cut_repeats), ("packing", pack)]

#: SQL can't express the toxicity model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(ship(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
