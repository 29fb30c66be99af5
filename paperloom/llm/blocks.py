"""Vectors and queries in blocks, for searches of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>): rows with an id whose vector has only finite components, and some."""
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select("vec_id", x.alias("embedding"))


def matrix(batch: pa.RecordBatch, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and the rows of a batch as one matrix; shorter vectors are filled with zeros."""
    ids = np.asarray(batch.column("vec_id"), dtype=np.int64)
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return ids, flat.reshape(len(ids), width)
    out = np.zeros((len(ids), width))
    row = np.repeat(np.arange(len(ids)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return ids, out


#: Bytes of vectors in a block at most.
BLOCK_BYTES = 32 << 20


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """(vec_id, embedding, key): the rows whose vec_id is divisible by ``every``, alike ones once.

    ``key`` tells apart the queries that share a vec_id.
    """
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "embedding"])
    return asked.withColumn("key", F.xxhash64("vec_id", "embedding"))


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name_ids binary, name_keys binary, name_rows binary, name_width int): rows of a task in blocks.

    A block has up to ``size`` rows and ``BLOCK_BYTES`` bytes of vectors.  Keys are those of a column ``key``, if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widest = max(1, int(np.asarray(batch.column("embedding").value_lengths()).max(initial=0)))
            step = max(1, min(size, BLOCK_BYTES // (8 * widest)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, x = matrix(part)
                keys = np.asarray(part.column("key"), dtype=np.int64) if "key" in part.schema.names else ids
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, keys, x)] + [pa.array([x.shape[1]], pa.int32())], names=[f"{name}_ids", f"{name}_keys", f"{name}_rows", f"{name}_width"])

    return rows.mapInArrow(run, f"{name}_ids binary, {name}_keys binary, {name}_rows binary, {name}_width int")


def unpack(r: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, vectors) of a block."""
    ids, keys = (np.frombuffer(r[f"{name}_{c}"], np.int64) for c in ("ids", "keys"))
    return ids, keys, np.frombuffer(r[f"{name}_rows"], np.float64).reshape(len(ids), r[f"{name}_width"])


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, with rank from 1."""
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids, by partition and a sort of what is left."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        tied = np.flatnonzero(scores == edge)
        at = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]
