"""Approximate nearest neighbours by inner product, on a robust-pruned directed graph.

Rows are dealt into shards of bounded rows and bytes, and each shard builds
its own graph: greedy searches propose neighbours, and of these a point keeps those that
no kept one is nearer to, by a relaxed factor, so that long and diverse edges stay.  A
query runs a beam search on every shard, and the shards' best are merged.  An additional
component makes all vectors of a shard equally long, so that the nearest by distance is
the largest inner product.  Equal vectors are one node that stands for all their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, matrix, packed, queries_of, same_width, top_of, unpack, usable
from .shared import Scratch

#: Edges of a node, width of the beams that build and search, relaxation of the last pass.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 96, 1.2
#: Rows of a shard at most (about); shards that a small table is dealt into, of so many rows at least.
SHARD_ROWS, SPREAD, LEAST_ROWS = 50_000, 12, 1_000
#: Searches that run together; nodes that each expands in a step.
TOGETHER, EXPANDED = 512, 4
QUERIES = 2_048
#: Bytes of a shard's vectors, and the largest id.
SHARD_BYTES, LAST = 64 << 20, (1 << 63) - 1


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances without the query's norm) of each query's beam, nearest first; -1 where there are fewer."""
    n, m = len(x), len(queries)
    norms = np.einsum("ij,ij->i", x, x)
    width = min(width, n)
    beam = np.full((m, width), -1, np.int64)
    far = np.full((m, width), np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    beam[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    far[:, 0] = norms[entry] - 2 * queries @ x[entry]
    live = np.arange(m)
    while len(live):
        b, o = beam[live], open_[live]
        order = np.argsort(~o, axis=1, kind="stable")[:, :EXPANDED]  # a beam is sorted, so the first open ones are the nearest
        each = np.arange(len(live))[:, None]
        picked = np.where(o[each, order], b[each, order], -1)
        o[each, order] = False
        near = np.where(picked[:, :, None] >= 0, edges[picked], -1).reshape(len(live), -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        keep = max(1, int((near < n).sum(axis=1).max()))
        near = np.sort(near, axis=1)[:, :keep]
        seen[live[:, None], near] = True
        real = np.minimum(near, n - 1)
        d = norms[real] - 2 * np.matmul(x[real], queries[live][:, :, None])[:, :, 0]
        d[near == n] = np.inf
        all_d = np.concatenate([far[live], d], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        beam[live] = np.concatenate([b, near], axis=1)[each, top]
        far[live] = all_d[each, top]
        open_[live] = np.concatenate([o, near < n], axis=1)[each, top] & (far[live] < np.inf)
        live = live[open_[live].any(axis=1)]
    beam[far == np.inf] = -1
    return beam, far


def robust_prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's proposed nodes (-1: none), at most ``degree`` diverse ones."""
    m, k = proposed.shape
    none = (proposed < 0) | (proposed == points[:, None])
    c = x[np.maximum(proposed, 0)]
    own = ((c - x[points][:, None, :]) ** 2).sum(axis=2)
    own[none] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    each = np.arange(m)[:, None]
    proposed, own, c = proposed[each, order], own[each, order], c[each, order]
    norm = np.einsum("ijk,ijk->ij", c, c)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    alive = own < np.inf
    out = np.full((m, degree), -1, np.int64)
    rows = np.arange(m)
    for i in range(min(degree, k)):
        first = alive.argmax(axis=1)
        on = alive[rows, first]
        if not on.any():
            break
        out[on, i] = proposed[on, first[on]]
        alive[rows, first] = False
        alive &= ~((alpha * alpha * between[rows, first] <= own) & on[:, None])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry) of a graph on distinct points, from a random start, in a strict and a relaxed pass."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n <= degree + 1:
        edges = np.tile(np.arange(n), (n, 1))
        edges[edges == np.arange(n)[:, None]] = -1
        return edges, entry
    edges = rng.integers(0, n, (n, degree))
    for factor in (1.0, alpha):
        for at in range(0, n, TOGETHER):
            points = np.arange(at, min(at + TOGETHER, n))
            found, _ = beam_search(x, edges, entry, x[points], beam)
            edges[points] = robust_prune(x, points, np.concatenate([found, edges[points]], axis=1), degree, factor)
            # each new edge is offered backwards, and full nodes are pruned again
            to, from_ = edges[points].ravel(), np.repeat(points, degree)
            to, from_ = to[to >= 0], from_[to >= 0]
            order = np.argsort(to, kind="stable")
            to, from_ = to[order], from_[order]
            ends, first = np.unique(to, return_index=True)
            count = np.diff(np.append(first, len(to)))
            offered = np.full((len(ends), int(count.max())), -1, np.int64)
            offered[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(first, count)] = from_
            for part in range(0, len(ends), TOGETHER):
                e, o = ends[part : part + TOGETHER], offered[part : part + TOGETHER]
                width = max(1, int((o >= 0).sum(axis=1).max()))
                both = np.concatenate([edges[e], o[:, :width]], axis=1)
                both.sort(axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                full = (both >= 0).sum(axis=1) > degree
                new = -np.sort(-both, axis=1)[:, :degree]
                if full.any():
                    for k in range(0, int(full.sum()), 64 if width > 128 else TOGETHER):
                        sub = np.flatnonzero(full)[k : k + (64 if width > 128 else TOGETHER)]
                        new[sub] = robust_prune(x, e[sub], both[sub], degree, factor)
                edges[e] = new
    return edges, entry


@dataclass
class Graph:
    """A shard: distinct vectors, the ids of each, and the graph on them."""

    rows: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    edges: np.ndarray
    entry: int

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Graph:
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.lexsort((ids, which))
        edges, entry = build(lengthened(distinct))
        return cls(distinct, ids[order], np.searchsorted(which[order], np.arange(len(distinct) + 1)), edges, entry)

    def best_ids(self, node: int, own: int, k: int) -> np.ndarray:
        """The k smallest ids of a node other than ``own``; a node's ids are sorted."""
        a, b = self.first[node], self.first[node + 1]
        low, high = a + np.searchsorted(self.ids[a:b], [own, own + 1]) if own < LAST else (b, b)
        return self.ids[a : min(b, a + k)] if low == high else np.concatenate([self.ids[a:low], self.ids[high:b]])[:k]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position of the query, ids, scores) of each query's k best rows, itself apart."""
        x = lengthened(self.rows)
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER]
            flat = np.pad(q, ((0, 0), (0, 1))).astype(np.float32)
            found, _ = beam_search(x, self.edges, self.entry, flat, max(beam, k + 1))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                scores = (self.rows[nodes] * q[i]).sum(axis=1)
                take = [self.best_ids(v, query_ids[at + i], k) for v in nodes]
                scores = np.repeat(scores, [len(t) for t in take])
                ids = np.concatenate(take) if take else np.zeros(0, np.int64)
                top = top_of(scores, ids, k)
                yield at + i, ids[top], scores[top]


def lengthened(rows: np.ndarray) -> np.ndarray:
    """The rows scaled to length at most 1, with one more component that makes it 1, as float32."""
    size = (rows**2).sum(axis=1)
    longest = size.max(initial=0) or 1.0
    return np.column_stack([rows / np.sqrt(longest), np.sqrt(np.maximum(0, 1 - size / longest))]).astype(np.float32)


def search(table: DataFrame, k: int = 20, every: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``.

    Every row is indexed.  Null, empty and zero vectors and those with null or non-finite
    components take no part, nor do rows without an id.  Rows that repeat a vec_id are
    candidates each, but no row is one for a query with its own id.  Query rows alike in
    vec_id and vector are one query; those that share only a vec_id are one each, with
    ranks of its own.  Of vectors of different lengths, the missing components count as
    zero.  Ties go to the smaller vec_id.  Other columns are ignored; an empty table gives
    an empty result.
    """
    scratch = Scratch(table.sparkSession)
    rows = usable(table).where(F.exists("embedding", lambda v: v != 0))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(8 * F.size("embedding").cast("long"))).first()
    shards = max(-(-n // shard_rows), -(-(size or 0) // SHARD_BYTES), min(SPREAD, -(-n // LEAST_ROWS)), 1)
    # by rows and not by ids, so that no id that many rows repeat fills a shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def build_shard(part: pa.Table) -> pa.Table:
        ids, x = matrix(part.select(["vec_id", "embedding"]).combine_chunks().to_batches()[0])
        g = Graph.of(ids, x)
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "entry": pa.array([g.entry], pa.int32()), "rows": pa.array([g.rows.tobytes()]), "ids": pa.array([g.ids.tobytes()]), "first": pa.array([g.first.astype(np.int64).tobytes()]), "edges": pa.array([g.edges.astype(np.int32).tobytes()])})

    graphs = scratch.keep(dealt.groupBy("shard").applyInArrow(build_shard, "shard int, width int, entry int, rows binary, ids binary, first binary, edges binary"), "graphs")
    queries = packed(queries_of(rows, every), QUERIES, "q")
    # a stated query set, in blocks, on every shard: a task reads a shard's graph once, then the blocks one by one
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = graphs.withColumn("block", F.lit(0)).unionByName(asked.withColumn("block", F.lit(1)), allowMissingColumns=True)
    lined = both.repartition(shards, "shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, width = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["block"] == 0:
                    x, width = np.frombuffer(r["rows"], np.float64).reshape(-1, r["width"]), r["width"]
                    g = Graph(x, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["first"], np.int64), np.frombuffer(r["edges"], np.int32).reshape(len(x), -1).astype(np.int64), r["entry"])
                    continue
                if g is None:
                    continue
                query_ids, keys, q = unpack(r, "q")
                q, wide = same_width(q, g.rows)
                here = g if wide.shape[1] == width else replace(g, rows=wide)
                found = [(np.full(len(ids), query_ids[at]), np.full(len(ids), keys[at]), ids, scores) for at, ids, scores in here.search(query_ids, q, k, beam)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "query_key", "vec_id", "score"])

    return best(lined.mapInArrow(run, "query_id long, query_key long, vec_id long, score double"), k)
