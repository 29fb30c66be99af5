"""Exact top-k by inner product of sparse integer vectors, term at a time.

Queries are sparse rows.  For a block of queries and a block of candidates, each term's
postings (the candidates that have it, and their weights) are scattered, times the
queries' weights, into dense arrays of scores; partition selection then keeps the k best
of each query, and the blocks' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, packed, queries_of, same_width, top_of, unpack, usable

#: Rows of a block of candidates, of queries, and of queries scored at once.
CANDIDATES, QUERIES, AT_ONCE, STRIP = 16_384, 1_024, 32, 4_096
LONG = (1 << 63) - 1


def quantised(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x); exact Python integers where a long might overflow."""
    y = np.floor(factor * x)
    if not np.isfinite(y).all():  # the product left the doubles' range
        return np.array([[int(v * factor) if abs(v) > 1e16 else int(np.floor(v * factor)) for v in map(int, r)] for r in x.tolist()], object).reshape(x.shape)
    return y.astype(np.int64) if np.abs(y).max(initial=0) < 2**62 else np.array([[int(v) for v in r] for r in y.tolist()], object).reshape(y.shape)


class Postings:
    """Of a block of candidates, each term's postings: the candidates that have it, and their weights.

    A term that over half the candidates have keeps its zeros, so that it is added without an index.
    """

    def __init__(self, candidates: np.ndarray):
        self.n, self.terms = len(candidates), np.ascontiguousarray(candidates.T)
        self.most = int(np.abs(candidates).max(initial=0))
        self.lists = [None if 2 * len(at) > self.n else at for at in map(np.flatnonzero, self.terms)]

    def accumulate(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, scores of some queries against all candidates), exhaustively, term at a time."""
        bound = int(np.abs(queries).max(initial=0)) * self.most * queries.shape[1]
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        terms = self.terms.astype(kind)
        for at in range(0, len(queries), AT_ONCE):
            block = queries[at : at + AT_ONCE].astype(kind)
            scores = np.zeros((len(block), self.n), kind)
            had = np.flatnonzero((block != 0).any(axis=0)).tolist()
            for t in had:
                if (postings := self.lists[t]) is not None and len(postings):
                    scores[:, postings] += block[:, t, None] * terms[t, postings]
            full = [t for t in had if self.lists[t] is None]
            for strip in range(0, self.n, STRIP):  # short rows of scores stay in the processor's cache
                into = scores[:, strip : strip + STRIP]
                for t in full:
                    into += block[:, t, None] * terms[t, strip : strip + STRIP]
            yield at, scores


def search(table: DataFrame, k: int = 20, every: int = 20, factor: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``.

    Null vectors and those with null or non-finite components take no part, nor do empty
    ones or rows without an id; zero vectors do.  Of vectors of different lengths, the
    missing components count as zero.  Rows that repeat a vec_id are candidates each, but
    no row is one for a query with its own id.  Query rows alike in vec_id and vector are
    one query; those that share only a vec_id are one each, with ranks of its own.  Ties
    go to the smaller vec_id.  A score beyond a long is the nearest long.  Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = usable(table)
    candidates = packed(rows, CANDIDATES, "c")
    queries = packed(queries_of(rows, every), QUERIES, "q")
    # a stated query set, in blocks, against all rows, in blocks: each pair of blocks is one row
    lanes = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    dealt = candidates.withColumn("lane", F.pmod(F.xxhash64("c_ids"), F.lit(lanes)).cast("int"))
    pairs = dealt.join(queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).hint("shuffle_hash"), "lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, x, postings = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                if (r["c_ids"], r["c_rows"]) != known:
                    ids, _, x = unpack(r, "c")
                    known, postings = (r["c_ids"], r["c_rows"]), None
                query_ids, keys, q = unpack(r, "q")
                q, wide = same_width(q, x)
                if postings is None or len(postings.terms) != wide.shape[1]:
                    postings = Postings(quantised(wide, factor))
                found = []
                for at, scores in postings.accumulate(quantised(q, factor)):
                    for i, own in enumerate(scores):
                        others = np.flatnonzero(ids != query_ids[at + i]) if (ids == query_ids[at + i]).any() else slice(None)
                        left, theirs = own[others], ids[others]
                        top = top_of(left, theirs, k)
                        found.append((np.full(len(top), query_ids[at + i]), np.full(len(top), keys[at + i]), theirs[top], np.clip(left[top], -LONG - 1, LONG).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "query_key", "vec_id", "score"])

    return best(pairs.mapInArrow(run, "query_id long, query_key long, vec_id long, score long"), k)
