"""Labels of pages from ranges of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scalars as S


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, page_num, label): by the range that holds the page; without one, the page's number from 1."""
    inside = F.col("page_num").between(F.col("base"), F.col("base") + F.col("length") - 1)
    own = ranges.withColumnRenamed("doc_id", "_doc")
    return spelt(pages.join(own, (F.col("doc_id") == F.col("_doc")) & inside, "left"))


def spelt(found: DataFrame) -> DataFrame:
    """(doc_id, page_num, label) of pages that have the range that holds them beside them, or nulls."""
    n = F.col("first") + F.col("page_num") - F.col("base")
    spelt = F.when(F.col("style") == "D", n.cast("string")).when(F.col("style") == "r", S.to_roman(n)).when(F.col("style") == "R", F.upper(S.to_roman(n))).when(F.col("style") == "a", S.to_latin(n)).when(F.col("style") == "A", F.upper(S.to_latin(n))).otherwise("")
    return found.select("doc_id", "page_num", F.when(F.col("base").isNull(), (F.col("page_num") + 1).cast("string")).otherwise(F.concat("prefix", spelt)).alias("label"))


def index_of(labelled: DataFrame, label: str) -> DataFrame:
    """(doc_id, page_num): the first page that bears a label."""
    return labelled.where(F.col("label") == label).groupBy("doc_id").agg(F.min("page_num").alias("page_num"))
