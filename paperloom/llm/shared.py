"""Cluster plumbing of the training-data operators: shared scratch tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel handles at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
#: The same where distinct pre-tokens are coded once for each piece.
CODED_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Unset on a cluster, it is an error: a machine-local folder would lose data.
    Unset on a local master (tests), a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    They are Parquet, and are removed by :meth:`drop` or when the driver ends.  With ``collect``
    the driver collects its garbage after each table: until then it holds the plans, task reports
    and broadcast rows of finished jobs, as much as its heap takes.
    """

    def __init__(self, spark: SparkSession, collect: bool = False):
        self.spark, self.collect = spark, collect
        self.root = f"{shared_dir(spark).rstrip('/')}/paperloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if self.collect:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._paperloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if path := getattr(df, "_paperloom_path", None):
            self._remove(path)


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary) holds about ``limit`` bytes in each piece."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, binary: str | None = None) -> DataFrame:
    """``mapInArrow`` over pieces of bounded bytes (of column ``binary``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunked(batches, binary) if binary else batches:
            if piece.num_rows:
                yield kernel(piece)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, as a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def text_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``text`` as UTF-8 bytes, without the cost of Python strings."""
    return docs.select(*columns, F.col("text").cast("binary").alias("text"))


def share(spark: SparkSession, total: int) -> int:
    """Rows of one key beyond which it is hot: a quarter of a task's share of ``total`` rows."""
    return max(1, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def attach(rows: DataFrame, of: DataFrame, keys: list[str], limit: int, by: Column) -> DataFrame:
    """``rows`` with the columns of ``of`` that has one row for each key, and in ``n`` the key's number of rows; those without one go.

    Keys of more than ``limit`` rows are broadcast: of these there are at most the number of
    rows through ``limit``, with :func:`share` four for each shuffle partition, at any size of
    the data.  Their rows have then found their values and are dealt by a hash of ``by``, so
    that no task gets all rows of a key.  The other keys are joined by shuffling.
    """
    values = [c for c in of.columns if c not in keys]
    hot = F.broadcast(of.where(F.col("n") > limit).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.struct(*values).alias("_hot")))
    found = rows.join(hot, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*(f"_k_{k}" for k in keys))
    found = found.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.xxhash64(by)).otherwise(F.lit(0).cast("long")))
    cold = of.where(F.col("n") <= limit).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    out = found.join(cold, [*keys, "_salt"], "left").withColumn("_of", F.coalesce("_hot", "_cold")).where("_of is not null")
    return out.select(*rows.columns, *(F.col(f"_of.{c}").alias(c) for c in values))
