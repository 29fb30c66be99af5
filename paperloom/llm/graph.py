"""Connected components of an edge table, by alternating large and small stars.

Each round is two shuffles of the edges, whose number never grows; the number of
rounds is about the logarithm of the longest path.  Edges never reach the driver,
only their number and a checksum.  The edges of a node that very many have are
not sent to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, attach, share


def _large(edges: DataFrame, limit: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return attach(both.where("v > u"), least, ["u"], limit, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, limit: int) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = attach(edges, least, ["u"], limit, F.col("v")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is its smallest node."""
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    told = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == told or not mark[0]:
            break
        told, old = mark, now
        limit = share(edges.sparkSession, 2 * mark[0])
        now = scratch.keep(_small(_large(now, limit), limit), "edges")
        scratch.drop(old)
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
