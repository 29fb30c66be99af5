"""SimHash near-duplicates: fingerprints, pigeonhole blocks, connected groups.

Two fingerprints of 64 bits that differ in at most two bits agree in at least two
of four 16-bit blocks, so each fingerprint is filed under its six pairs of blocks
and only fingerprints under one 32-bit key are compared.  A key with many distinct
fingerprints would cost a square of pairs; there, fingerprints are filed under every
fingerprint at distance 0 or 1 instead.  Two within two bits share such a centre, and
all under one centre are within two bits, so no link is lost and no pair listed twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, attach, chunked, share, text_of

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Distinct fingerprints under one key beyond which centres replace pairs; both ways are exact.
PAIRWISE_LIMIT = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for a text without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = np.fromiter(accumulate(map(len, words), initial=0), np.int64, len(words) + 1) + np.arange(len(words) + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[shingle:] - 1).tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns and ``fp``, the fingerprint as a signed long; null texts have none of the words."""
    kept = text_of(docs, *columns)
    schema = kept.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            fp = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(fp)], names=[*(n for n in batch.schema.names if n != "text"), "fp"])

    return kept.mapInArrow(run, schema)


def links(nodes: DataFrame, rows: int, scratch: Scratch, limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints whose groups are those of all pairs within two bits.

    ``nodes`` has one row for each distinct ``fp``, ``rows`` at most.
    """
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block[a], 16)).bitwiseOR(block[b]) for t, (a, b) in enumerate(combinations(range(4), 2))]
    filed = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.keep(attach(filed, shared, ["key"], share(nodes.sparkSession, len(keys) * rows), F.col("fp")), "members")

    few = members.where(F.col("n") <= limit).select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").where((F.col("u") < F.col("v")) & near).select("u", "v")

    many = members.where(F.col("n") > limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)))
    centres = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    # at most 65 fingerprints are within one bit of a centre, so no window is large
    chained = centres.select("fp", F.lag("fp").over(W.partitionBy("centre").orderBy("fp")).alias("u")).where("u is not null").select("u", F.col("fp").alias("v"))
    return pairs.union(chained).distinct()


def near_duplicates(docs: DataFrame, limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of two or fewer
    differing bits.  Rows are the nodes: rows that repeat a doc_id are linked by their
    own texts.  Null and word-less texts have fingerprint 0.  A null doc_id is kept, and
    is never a component's id unless all its members' are null.  Other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprints(docs, "doc_id"), "fingerprints")
    rows = marked.count()
    hot = share(docs.sparkSession, rows)
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(nodes.select("fp"), rows, scratch, limit), scratch)  # (node, root)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = attach(placed, ids, ["root"], hot, F.col("fp")).select("fp", "component_id", F.col("rows").alias("n"))
    # a fingerprint that very many rows have is not sent to one task
    return attach(marked, classes, ["fp"], hot, F.monotonically_increasing_id()).select("doc_id", "fp", "component_id")
