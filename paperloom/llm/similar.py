"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, in groups.

This is the near-duplicate operator where a similarity is asked for.  SimHashes of the
shingles are filed under pairs of blocks as in :mod:`simhash`, and each is paired with the least one within
two bits; these pairs are verified on the whole sets.  At 0.8 two SimHashes
differ in about ten of 64 bits, so blocks that are sure to agree would be a few bits wide
and hold everything.  What two bits don't reach is found by a second fingerprint, 128 minima of hashes of the shingles
(16 bits of each), in the same way: fingerprints are split into 32 blocks of four minima, texts
that share a block are compared, and every pair is verified, first on the fingerprints and
then on the whole sets.  A pair at exactly 0.8 shares no block with probability
(1 - 0.8**4)**32, 5 in 10**8, and fails the first test with less than 1 in 10**6; more
similar ones more rarely.

The texts of a block are first compared with its head, the text whose blocks are the
fullest, as the original of a group has more in common with its copies than they with each
other.  Of what that does not connect, the texts of a block are compared all with all, in
squares of bounded size.  A square holds of each text its fingerprint and the ``KEPT`` lowest
hashes of its shingles: of a text with no more shingles that is the whole set, so a pair of
such texts is decided there, and only links that connect something new leave the square.
Of longer texts the hashes give an estimate, and pairs that may be similar are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from .graph import components
from .shared import Scratch, attach, chunked, share
from .words import BASES, LOWER, SPACE, Rolling, find

SHINGLE, SIMILARITY, BANDS, ROWS, ROUNDS = 5, 0.8, 32, 4, 1
#: Share of equal minima below which a pair isn't read: over five standard deviations below the similarity.
SLACK = 0.18
#: Texts that are compared with one copy of a head, and side of the squares that large blocks are compared in.
MEMBERS, SQUARE = 512, 256
#: Hashes of a text in a square, and share of the estimate from them below which a pair isn't read: five standard deviations.
KEPT, MARGIN = 512, 0.09
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """A digest of the lower-case (A-Z) words, and the distinct hashes of their shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh3_128_digest(line)
    if len(words) <= shingle:
        return digest, np.frombuffer(digest[:8], np.uint64)
    data = np.frombuffer(line, np.uint8)
    spans = find(data, np.array([0, len(data)]), ~SPACE)
    n = len(words) - shingle + 1
    hashes = Rolling(LOWER[data].astype(np.uint64) + np.uint64(1), BASES[0])(spans.starts[:n], spans.ends[shingle - 1 :])
    return digest, np.unique(hashes)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minimum, four in a long."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            x = hashes[at : at + 1024, None] * _TIMES
            x += _PLUS
            x ^= x >> np.uint64(32)
            np.minimum(least, x.min(axis=0), out=least)
    return least.astype(np.uint16).view(np.int64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima of the rows of two arrays of sketches."""
    return ((a ^ b).view(np.uint16).reshape(len(a), BANDS * ROWS) == 0).mean(axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats, neither empty."""
    few, many = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    return both / (len(a) + len(b) - both)


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The ``KEPT`` lowest of distinct hashes, mixed one to one, in order."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32))) * _TIMES[0]
    return np.sort(x ^ (x >> np.uint64(29)))[:KEPT]


def estimate(own: np.ndarray, whole: bool, others: list[np.ndarray], wholes: np.ndarray) -> np.ndarray:
    """Similarity of one lowest-hash list to each of several, over the range that both lists cover; exact where both are whole."""
    top = np.iinfo(np.uint64).max
    size = np.fromiter(map(len, others), np.int64, len(others))
    values, starts = np.concatenate(others), np.concatenate([[0], np.cumsum(size)[:-1]])
    ends = np.where(wholes, top, values[starts + size - 1])
    ends = np.minimum(ends, top if whole else own[-1])
    covered = values <= np.repeat(ends, size)
    both = np.add.reduceat(covered & (own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values), starts, dtype=np.int64)
    return both / (np.searchsorted(own, ends, "right") + np.add.reduceat(covered, starts, dtype=np.int64) - both)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, equal for equal texts (MD5; empty for null): with the doc_id, rows of one key are alike."""
    return docs.withColumn("key", F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"")))


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, digest, fp, bands) of each row: ``digest`` is equal for equal words, ``fp`` is the SimHash."""
    kept = _keyed(docs.select("doc_id", "text")).select("doc_id", "key", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            found = [shingles(x.as_py(), shingle) for x in batch.column("text")]
            keys = np.concatenate([sketch(h) for _, h in found])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            prints = np.array([simhash.fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([d for d, _ in found], pa.binary()), pa.array(prints), lists], names=["doc_id", "key", "digest", "fp", "bands"])

    return kept.mapInArrow(run, kept.drop("text").schema.add("digest", "binary").add("fp", "long").add("bands", ArrayType(LongType())))


def by_simhash(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node, fp) to verify: one node of each SimHash with the others of it, and with that of the least SimHash within two bits."""
    rows = nodes.count()
    heads = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    same = attach(nodes.select("node", "fp"), heads, ["fp"], share(nodes.sparkSession, rows), F.col("node")).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = simhash.links(heads.select("fp"), rows, scratch).groupBy(F.greatest("u", "v").alias("x")).agg(F.min(F.least("u", "v")).alias("y"))
    for x in "xy":
        near = near.join(heads.select(F.col("fp").alias(x), F.col("head").alias(f"of_{x}")), x)
    found = scratch.keep(same.union(near.select("of_x", "of_y")), "by_simhash")
    scratch.drop(heads)
    return found


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of which at least that share of minima is equal."""
    for x in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("bands").alias(f"of_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(f"of_{x}").flatten()).reshape(-1, BANDS) for x in "uv")
            on = pa.array(agreement(a, b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(on) for x in "uv"], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, limit: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar; a task reads v's text and then those of its u, one by one."""
    sizes = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / MEMBERS).cast("int"))
    heads = sizes.join(texts.withColumnRenamed("node", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("u"), "text")
    split = attach(pairs, sizes, ["v"], limit, F.col("u")).select("v", F.pmod(F.xxhash64("u"), F.col("parts").cast("long")).cast("int").alias("part"), "u")
    members = split.join(texts.withColumnRenamed("node", "u"), "u").select("v", "part", "u", "text")
    lined = heads.unionByName(members).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            us, vs, texts = (batch.column(c) for c in ("u", "v", "text"))
            found = []
            for i in range(batch.num_rows):
                own = shingles(texts[i].as_py(), shingle)[1]
                if not us[i].is_valid:
                    head = own
                elif jaccard(head, own) >= similarity:
                    found.append(i)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([us.take(at), vs.take(at)], names=["u", "v"])

    return lined.mapInArrow(run, "u long, v long")


def _with_head(grouped: DataFrame, limit: int) -> DataFrame:
    """(u, v): each node of a block with the block's head, if they are of two components; (band, key, node, c, pop, last)."""
    first = F.max(F.struct(F.when(F.col("c") == F.col("last"), 0).otherwise(1).alias("new"), "pop", F.xxhash64("node").alias("h"), "node", "c")).alias("head")
    heads = grouped.groupBy("band", "key").agg(first, F.count(F.lit(1)).alias("n"))
    return attach(grouped.select("band", "key", "node", "c"), heads, ["band", "key"], limit, F.col("node")).where("c <> head.c").select(F.col("node").alias("u"), F.col("head.node").alias("v"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, least, whole): the lowest hashes of each text, and whether these are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            found = [shingles(x.as_py(), shingle)[1] for x in batch.column("text")]
            low = [lowest(h) for h in found]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, pa.array([len(h) <= KEPT for h in found])], names=["node", "least", "whole"])

    return texts.mapInArrow(run, "node long, least array<long>, whole boolean")


def _in_squares(grouped: DataFrame, nodes: DataFrame, limit: int, similarity: float) -> DataFrame:
    """(u, v, sure): links between components that a block shows, and, not sure, the pairs that must be read.

    ``nodes`` are (node, bands, least, whole).  A block is cut into sides of at most about
    ``SQUARE`` nodes, and a task holds one square of two sides.  Of the sure links of a square
    those that close a circle are left out, as they connect nothing.
    """
    sizes = grouped.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("sides", F.ceil(F.col("n") / SQUARE).cast("int"))
    sided = attach(grouped.select("band", "key", "node", "c"), sizes, ["band", "key"], limit, F.col("node"))
    sided = sided.withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides").cast("long")).cast("int")).join(nodes, "node")
    put = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("band", "key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node", "c", "bands", "least", "whole")
    cell = ["band", "key", "x", "y"]
    lined = put.repartition(*cell).sortWithinPartitions(*cell)

    def met(rows: pa.Table) -> pa.RecordBatch:
        side, node, label, whole = (rows.column(n).to_numpy() for n in ("side", "node", "c", "whole"))
        label = label.copy()
        bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        least = [x.values.to_numpy().view(np.uint64) for x in rows.column("least")]
        band, one = rows.column("band")[0].as_py(), side == rows.column("x")[0].as_py()
        alone = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
        left, right = (np.arange(len(node)), np.arange(len(node))) if alone else (np.flatnonzero(one), np.flatnonzero(~one))
        sure, open_ = [], []
        for i in left.tolist():
            other = right[right > i] if alone else right
            other = other[label[other] != label[i]]
            same = (bands[other] ^ bands[i]).view(np.uint16).reshape(len(other), BANDS * ROWS) == 0
            first = same.reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1)
            other = other[(same.mean(axis=1) >= similarity - SLACK) & (first == band)]  # a pair counts in the first band that it shares
            if not len(other):
                continue
            alike = estimate(least[i], whole[i], [least[j] for j in other], whole[other])
            decided = whole[other] & whole[i]
            for j in other[decided & (alike >= similarity)].tolist():
                if label[j] != label[i]:
                    sure.append((i, j))
                    label[label == label[j]] = label[i]
            open_ += [(i, j) for j in other[~decided & (alike >= similarity - MARGIN)].tolist()]
        open_ = [(i, j) for i, j in open_ if label[i] != label[j]]
        us, vs = (node[np.array([p[k] for p in sure + open_], np.int64)] for k in (0, 1))
        known = pa.array([True] * len(sure) + [False] * len(open_), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(us, vs)), pa.array(np.maximum(us, vs)), known], names=["u", "v", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = [], None
        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(n)) for n in cell])
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and tuple(keys[a]) != told:
                    yield met(pa.Table.from_batches(held))
                    held = []
                held, told = [*held, batch.slice(a, b - a)], tuple(keys[a])
        if held:
            yield met(pa.Table.from_batches(held))

    return lined.mapInArrow(run, "u long, v long, sure boolean")


def links(nodes: DataFrame, texts_of, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame | None:
    """Pairs (u, v) of nodes whose groups are those of all similar pairs that share a block or are in ``more``; None if there are none.

    ``nodes`` are (node, bands); ``texts_of`` gives (node, text as bytes) of a table of nodes.
    """
    spark = nodes.sparkSession
    found: list[DataFrame] = []

    def read(pairs: DataFrame) -> None:
        pairs = scratch.keep(pairs, "pairs")
        if n := pairs.count():
            texts = scratch.keep(texts_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()), "texts")
            found.append(scratch.keep(_verified(pairs, texts, shingle, similarity, share(spark, n)), "links"))
            scratch.drop(texts)
        scratch.drop(pairs)

    filed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    limit = share(spark, BANDS * nodes.count())
    shared = filed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n"))
    members = scratch.keep(attach(filed, shared, ["band", "key"], limit, F.col("node")), "members")
    many = members.count()
    if not many:
        if more is not None:
            read(more)
        return _all(found) if found else None
    limit, pop = share(spark, many), members.groupBy("node").agg(F.sum("size").alias("pop"))
    grouped = scratch.keep(members.join(pop, "node").select("band", "key", "node", F.col("node").alias("c"), "pop", F.lit(None).cast("long").alias("last")), "grouped")
    scratch.drop(members)
    for again in range(ROUNDS):
        pairs = _alike(_with_head(grouped, limit).distinct(), nodes, similarity - SLACK)
        read(pairs if again or more is None else pairs.union(more).distinct())
        if found:
            roots = components(_all(found), scratch).withColumnRenamed("root", "root_")
            joined = grouped.drop("c", "last").join(roots, "node", "left").withColumn("c", F.coalesce("root_", "node"))
            # the component that most of a block is in by now, and the blocks that more than one is in
            state = joined.groupBy("band", "key").agg(F.max(F.struct("pop", "c"))["c"].alias("last"), F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").drop("low", "high")
            new = scratch.keep(attach(joined.select("band", "key", "node", "c", "pop"), state, ["band", "key"], limit, F.col("node")).drop("n"), "grouped")
            scratch.drop(grouped)
            grouped = new
    texts = scratch.keep(texts_of(grouped.select("node").distinct()), "texts")
    sets = scratch.keep(_sets(texts, shingle), "sets")
    pairs = scratch.keep(_in_squares(grouped, nodes.select("node", "bands").join(sets, "node"), limit, similarity), "pairs")
    found.append(pairs.where("sure").select("u", "v"))
    if n := pairs.where("not sure").count():
        found.append(scratch.keep(_verified(pairs.where("not sure").select("u", "v"), texts, shingle, similarity, share(spark, n)), "links"))
    for table in (texts, sets, grouped):
        scratch.drop(table)
    return _all(found)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def one_of_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``docs``, whole: groups are connected over links of ``similarity`` or more.

    The row of the smallest doc_id stays; a null doc_id comes after all others, and of rows
    that repeat a doc_id and are alike one stays.  Rows are the nodes, whatever their doc_id: a row
    that is like no other stays, also if its doc_id is null or that of another row.  Null
    texts and texts without words are one group.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, collect=True)
    marked = scratch.keep(_marked(docs, shingle), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    nodes = marked.groupBy("digest").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "first", "fp", "bands"), "nodes")  # written, so that a node keeps its number

    def texts_of(wanted: DataFrame) -> DataFrame:
        asked = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("id_"), F.col("first.key").alias("key"))
        found = _keyed(docs.select("doc_id", "text")).join(asked, "key").where(F.col("doc_id").eqNullSafe(F.col("id_")))
        return found.select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])

    linked, chosen = links(nodes.select("node", "bands"), texts_of, scratch, shingle, similarity, by_simhash(nodes.select("node", "fp"), scratch)), nodes
    if linked is not None:
        roots = components(linked, scratch)
        placed = nodes.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
        chosen = placed.groupBy("root").agg(F.min("first").alias("first"))
    # of the chosen ones, those that several alike rows have
    n = marked.groupBy("doc_id", "key").agg((F.count(F.lit(1)) > 1).alias("several"))
    kept = chosen.select(F.col("first.doc_id").alias("id_"), F.col("first.key").alias("key"))
    again = n.where("several").select(F.col("doc_id").alias("id_"), "key", "several")
    kept = scratch.keep(kept.join(again, kept["id_"].eqNullSafe(again["id_"]) & (kept["key"] == again["key"]), "left").select(kept["id_"], kept["key"], F.coalesce("several", F.lit(False)).alias("several")), "chosen")
    for table in (marked, nodes):
        scratch.drop(table)
    rows = _keyed(docs).join(kept, "key").where(F.col("doc_id").eqNullSafe(F.col("id_")))
    return rows.where("not several").select(*docs.columns).union(rows.where("several").dropDuplicates(["id_", "key"]).select(*docs.columns))
