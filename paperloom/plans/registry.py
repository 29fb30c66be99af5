"""Where queries and their SQL are put, and what they have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.kernel.writer import LEADING, LINES_A_PAGE, MARGIN, WORDS_A_LINE
from paperloom.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.synthesized(table(spark, sf_dir, "documents"))


# The words of a text as the synthesised pages place them: w from 0, in lines of eight and pages of 54 lines.
WORDS = f"""
WITH t AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, lang, source, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS w FROM t),
p AS (SELECT *, w // {WORDS_A_LINE} AS l, (w // {WORDS_A_LINE}) // {LINES_A_PAGE} AS page FROM u),
b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, l ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM p),
placed AS (SELECT doc_id, lang, CAST(page AS INTEGER) AS page_num, CAST(l % {LINES_A_PAGE} AS INTEGER) AS line, w, text, {MARGIN} + 6.0 * col AS x_min, {MARGIN} + 6.0 * (col + length(text)) AS x_max, {MARGIN} + {LEADING}.0 * (l % {LINES_A_PAGE}) AS base FROM b)
"""
