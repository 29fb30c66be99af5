"""Repeated passages: a log-structured index of window fingerprints, and exact removal.

A window is ``WINDOW`` consecutive words.  Of the word sequences of length ``ANCHOR``
inside a window, the one of smallest hash is the window's fingerprint, so equal windows
have equal fingerprints and neighbouring windows mostly share one: the index holds about
one entry for each thirteen words, not one for each word.

The index is a log of immutable runs, each a table bucketed and sorted by fingerprint.
A batch of documents becomes a run; it is merge-joined with the runs of all earlier
batches and with itself; fingerprints that occur in two documents make candidates.  Each
candidate window is then verified with a BLAKE2 digest of 128 bits over the bytes of its
words, and the words that a verified window covers go.  When there are too many runs,
their buckets are merged into those of one run, without a shuffle.  Runs lie in a folder,
so that a later session can open the index and append to it.

A row whose whole text an earlier document has is not indexed: what it would add is there
already, and all its windows go.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, attach, buffer_of, map_arrow, share, text_of
from .words import BASES, SPACE, Rolling, Words, find

WINDOW, ANCHOR = 50, 25


def _windows(text: pa.Array, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, the row of each, the first word of each window inside a row, word hashes."""
    words = find(*buffer_of(text), ~SPACE)
    rows = words.rows()
    at = np.arange(max(0, len(rows) - window + 1))
    at = at[rows[at] == rows[at + window - 1]]
    return words, rows, at, words.hashes(BASES[0])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def _fingerprints(hashes: np.ndarray, at: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The smallest hash of ``anchor`` words inside each window."""
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.arange(len(hashes) - anchor + 1)
    return _least(Rolling(hashes, BASES[1])(first, first + anchor), window - anchor + 1)[at]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _entries(batch: pa.RecordBatch, window: int, anchor: int) -> pa.RecordBatch:
    """(fp, doc_id): once for each fingerprint of a row."""
    _, rows, at, hashes = _windows(batch.column("text"), window)
    fp, row = _fingerprints(hashes, at, window, anchor), rows[at]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
    fp, row = fp[new], row[new]
    return pa.RecordBatch.from_arrays([_signed(fp), batch.column("doc_id").take(pa.array(row))], names=["fp", "doc_id"])


def _digests(text: bytes, at: np.ndarray, window: int) -> bytes:
    """16 bytes for each of the windows that start at the given words: a digest of the words, joined by spaces."""
    words = text.split()
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = ends[at + window - 1] - 1
    first = np.where(at > 0, ends[at - 1], 0)
    return b"".join(hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True))


def _candidates(batch: pa.RecordBatch, window: int, anchor: int) -> pa.RecordBatch:
    """(d1, d2, doc_id, text_hash, at): the windows whose fingerprint is in the row's ``shared``."""
    _, rows, at, hashes = _windows(batch.column("text"), window)
    fp, row = _fingerprints(hashes, at, window, anchor).view(np.int64), rows[at]
    shared = batch.column("shared")
    listed = np.asarray(shared.flatten(), dtype=np.int64)
    cut = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(shared)))])
    edge, first = np.searchsorted(row, np.arange(batch.num_rows + 1)), np.searchsorted(rows, np.arange(batch.num_rows))
    digests, places, owner = [], [], []
    for r in range(batch.num_rows):
        a, b = edge[r], edge[r + 1]
        if len(mine := at[a:b][np.isin(fp[a:b], listed[cut[r] : cut[r + 1]])] - first[r]):
            digests.append(_digests(batch.column("text")[r].as_py(), mine, window))
            places.append(mine)
            owner.append(np.full(len(mine), r))
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    take = pa.array(np.concatenate(owner or [np.zeros(0, np.int64)]))
    place = np.concatenate(places or [np.zeros(0, np.int64)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(place)], names=["d1", "d2", "doc_id", "text_hash", "at"])


def _remove(batch: pa.RecordBatch, window: int, texts: bool) -> pa.RecordBatch:
    """n_words, n_removed, kept_sha256, and with ``texts`` the text without the removed words."""
    data, offsets = buffer_of(batch.column("text"))
    raw = data.tobytes()
    words = find(data, offsets, ~SPACE)
    sizes = np.diff(words.first)
    depth = np.zeros(len(words.starts) + 1, np.int64)
    gone = batch.column("gone")
    owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(gone), 0)))
    at = words.first[owner] + np.asarray(gone.flatten(), dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + window, -1)
    whole = np.asarray(pc.fill_null(batch.column("whole"), False)) & (sizes >= window)
    np.add.at(depth, words.first[:-1][whole], 1)
    np.add.at(depth, words.first[1:][whole], -1)
    removed = np.cumsum(depth)[:-1] > 0
    count = np.concatenate([[0], np.cumsum(removed)])
    n_removed = count[words.first[1:]] - count[words.first[:-1]]
    digests, kept_texts = [], []
    for r in range(batch.num_rows):
        a, b = words.first[r], words.first[r + 1]
        text = raw[offsets[r] : offsets[r + 1]]
        if n_removed[r]:
            mine = removed[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            last, parts = offsets[r], []
            for i, j in zip(edge[::2], edge[1::2], strict=True):  # the white space after a passage goes with it
                parts.append(raw[last : words.starts[a + i]])
                last = words.starts[a + j] if a + j < b else offsets[r + 1]
            parts.append(raw[last : offsets[r + 1]])
            text = b"".join(parts)
        digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
        kept_texts.append(text)
    keep = [c for c in batch.schema.names if c not in ("text", "gone", "whole")]
    null = batch.column("text").is_null()
    body = [pc.if_else(null, pa.scalar(None, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string()))] if texts else []
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes), pa.array(n_removed), pa.array(digests), *body], names=[*keep, "n_words", "n_removed", "kept_sha256", *(["text"] if texts else [])])


class FingerprintIndex:
    """Sorted immutable runs of the fingerprints of all documents appended so far.

    Runs are bucketed and sorted by fingerprint, with one number of buckets, so that a
    merge-join of runs needs no shuffle of the history.  ``buckets`` should grow with the
    data that the index is to hold; unset, it is the session's number of shuffle
    partitions.  Runs lie below ``folder``; a folder that holds runs is opened with them.
    Without one, the index is temporary.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, most_runs: int = 4):
        self.spark, self.most_runs, self.temporary = spark, most_runs, folder is None
        self.folder = (folder or f"{Scratch(spark).root}/index").rstrip("/")
        self.name, self.tables = f"paperloom_runs_{uuid.uuid4().hex}", {}
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files, self.path = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path
        found = sorted(f.getPath().getName() for f in self.files.listStatus(at)) if self.files.exists(at) else []
        self.runs = [x for x in found if x.startswith("run-") and self.files.exists(self.path(f"{self.folder}/{x}/_SUCCESS"))]
        self.buckets = int(self.runs[0].rpartition("-")[2]) if self.runs else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.next = 1 + max([int(x.split("-")[1]) for x in found if x.startswith("run-")], default=0)
        for run in self.runs:
            self.tables[run] = f"{self.name}_{run.split('-')[1]}"
            spark.sql(f"CREATE TABLE {self.tables[run]} (fp BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        atexit.register(self.close)

    def _write(self, entries: DataFrame) -> str:
        """``entries``, partitioned by bucket, as a run."""
        run, self.next = f"run-{self.next:06d}-{self.buckets}", self.next + 1
        self.tables[run] = f"{self.name}_{run.split('-')[1]}"
        entries.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.folder}/{run}").saveAsTable(self.tables[run])
        return run

    def append(self, entries: DataFrame) -> None:
        """Write (fp, doc_id) as a new run."""
        self.runs.append(self._write(entries.repartition(self.buckets, "fp")))

    def run(self, run: str) -> DataFrame:
        return self.spark.table(self.tables[run])

    def least(self, run: str) -> DataFrame:
        """A run's smallest and largest doc_id of each fingerprint; local to a bucket."""
        return self.run(run).groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))

    def shared(self) -> DataFrame:
        """Fingerprints of the newest run that occur in two documents of the index, with the runs merge-joined to it."""
        newest, *older = self.runs[::-1]
        out = self.least(newest)
        for run in older:
            old = self.least(run).select("fp", F.col("low").alias("l"), F.col("high").alias("h"))
            out = out.join(old.hint("merge"), "fp", "left").select("fp", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
        return out.where("low < high").select("fp")

    def holders(self, shared: DataFrame) -> DataFrame:
        """(doc_id, fp) of all runs, for the given fingerprints."""
        return reduce(DataFrame.union, [self.run(run).join(shared.hint("merge"), "fp").select("doc_id", "fp") for run in self.runs])

    def compact(self) -> None:
        """Replace all runs by one, if there are more than ``most_runs``: equal buckets are merged where they lie."""
        if len(self.runs) > self.most_runs:
            old = self.runs
            self.runs = [self._write(reduce(DataFrame.union, [self.run(run) for run in old]).groupBy("fp", "doc_id").agg(F.lit(1)).select("fp", "doc_id"))]
            for run in old:
                self._drop(run)
                self.files.delete(self.path(f"{self.folder}/{run}"), True)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")

    def close(self) -> None:
        """Leave the runs to later sessions, or remove a temporary index."""
        with contextlib.suppress(Exception):  # the session may be gone at exit
            for run in self.runs:
                self._drop(run)
            if self.temporary:
                self.files.delete(self.path(self.folder), True)
        self.runs = []


def add_batch(index: FingerprintIndex, batch: DataFrame, documents: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, copies: DataFrame | None = None) -> DataFrame:
    """Index ``batch`` and return (doc_id, text_hash, gone): for its rows, the starts of windows to remove.

    ``documents`` must hold the batch and all earlier batches; it is what candidates are
    verified on, and only documents that share a fingerprint are read as words.  A window
    goes if its words also start in a document of smaller doc_id.  Documents of ``copies``
    (doc_id) are left out.
    """
    entries = map_arrow(text_of(batch, "doc_id").where("doc_id is not null"), partial(_entries, window=window, anchor=anchor), "fp long, doc_id long", "text")
    index.append(entries.join(copies, "doc_id", "left_anti").select("fp", "doc_id") if copies is not None else entries)
    listed = index.holders(index.shared()).groupBy("doc_id").agg(F.collect_set("fp").alias("shared"))
    with_shared = _keyed(documents).join(listed, "doc_id")
    windows = map_arrow(with_shared.select("doc_id", "text_hash", "text", "shared"), partial(_candidates, window=window, anchor=anchor), "d1 long, d2 long, doc_id long, text_hash long, at int", "text")
    sums = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    first = scratch.keep(sums.where("low < high").drop("high"), "first")
    limit = share(index.spark, first.agg(F.sum("n")).first()[0] or 0)
    held = attach(windows, first, ["d1", "d2"], limit, F.struct("doc_id", "at")).where("doc_id > low")
    return held.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, whole): whether a document of smaller doc_id has the same text, byte by byte (SHA-256)."""
    told = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    told = scratch.keep(told, "texts")
    least = told.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return scratch.keep(attach(told, least, ["digest"], share(docs.sparkSession, told.count()), F.col("doc_id")).select("doc_id", "text_hash", (F.col("doc_id") > F.col("low")).alias("whole")), "copies")


def remove_repeats(docs: DataFrame, *columns: str, batches: int = 2, texts: bool = True, window: int = WINDOW, anchor: int = ANCHOR, folder: str | None = None, most_runs: int = 1) -> DataFrame:
    """Every row with n_words, n_removed, kept_sha256 and, with ``texts``, its text without repeats.

    Documents enter an index in ``batches`` of rising doc_id; it is compacted when it has
    more than ``most_runs`` runs, and kept in ``folder``, if that is given.  Words are judged on the
    input: a word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id.  Null texts have no words and stay null; a null
    doc_id is smaller than none and its row is kept whole; rows that repeat a doc_id do
    not remove each other.  Besides ``columns``, others are ignored.  Empty tables give
    empty results.
    """
    spark = docs.sparkSession
    scratch, index = Scratch(spark), FingerprintIndex(spark, folder, most_runs=most_runs)
    copies = _copies(docs, scratch)
    only = copies.groupBy("doc_id").agg(F.bool_and("whole").alias("whole")).where("whole").select("doc_id")
    ids = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted({int(x) for x in ids}) if batches > 1 else []
    gone = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = reduce(lambda a, b: a & b, [F.col("doc_id") > low] * (low is not None) + [F.col("doc_id") <= high] * (high is not None), F.lit(True))
        seen = docs.where(F.col("doc_id") <= high) if high is not None else docs
        gone.append(scratch.keep(add_batch(index, docs.where(inside), seen, scratch, window, anchor, only).where(inside), "gone"))
        index.compact()
    index.close()
    whole = copies.where("whole").select("doc_id", "text_hash", F.lit(None).cast("array<int>").alias("gone"), "whole").distinct()
    all_gone = reduce(DataFrame.union, gone).withColumn("whole", F.lit(False)).union(whole)
    all_gone = all_gone.groupBy("doc_id", "text_hash").agg(F.max("gone").alias("gone"), F.bool_or("whole").alias("whole"))
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"), *columns)
    joined = plain.join(all_gone, ["doc_id", "text_hash"], "left").drop("text_hash")
    schema = joined.drop("text", "gone", "whole").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return map_arrow(joined, partial(_remove, window=window, texts=texts), schema.add("text", "string") if texts else schema, "text")
