"""Toxic documents by two Kneser-Ney models that share their backoff counts.

A word gives two tokens, its first letters and its whole form, so that a rare form of a
known stem is still told by its stem.  One bigram model is learnt from toxic, one from
ordinary documents.  Counts are of documents, so that one long document is one witness;
they are discounted, and what that frees goes to the class's continuation counts, the
number of tokens that a token follows, and below them to the continuation counts of both
classes together, which the classes share.  Ratios of rare expressions are smoothed, not
cut: one that n documents of both classes hold counts n**2 / (n**2 + r**2), and a
bigram leaves the rest to its last token.  The log-likelihood ratio of a document, divided
by a power of its length, is mapped to a probability by a logistic fit on documents that
the fitted models had not seen.  r and the power (1: per token; 1/2: as chance grows) are
those of ``RARE`` and ``POWERS`` that foretell such documents best, by cross-validation
inside the rows that may be learnt from.

The models are learnt in one task from at most ``per_class`` labelled documents and
``BYTES`` bytes of text of each class, as many of one as of the other (those of least
hash), so their size is bounded; every document is scored, whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import buffer_of, chunked, give_back, text_of
from .words import BASES, LOWER, WORDLIKE, Rolling, find, mix

#: Bounds of the training sample of a class, discount, bytes of a stem, and the score from which a document is toxic.
PER_CLASS, BYTES, DISCOUNT, STEM, THRESHOLD = 2_500, 32 << 20, 0.25, 4, 0.3
#: Tried: documents at which a ratio counts half, and powers of the length.
RARE, POWERS = (0, 2, 4, 8, 16), (0.5, 1.0)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bigrams, row of each): both as hashes, in order; a token's bigram is with the one before."""
    data, offsets = buffer_of(text)
    words = find(LOWER[data], offsets, WORDLIKE)
    rows = np.repeat(words.rows(), 2)
    hashes = Rolling(words.data.astype(np.uint64) + np.uint64(1), BASES[0])
    stream = np.empty(len(rows), np.uint64)
    stream[0::2] = hashes(words.starts, np.minimum(words.starts + STEM, words.ends)) ^ np.uint64(BASES[1])
    stream[1::2] = hashes(words.starts, words.ends)
    before = np.zeros_like(stream)
    before[1:] = np.where(rows[1:] == rows[:-1], stream[:-1], np.uint64(0))
    return stream, mix(before * np.uint64(BASES[0]) + stream), before, rows


@dataclass
class Model:
    """Smoothed log-likelihood ratios of the bigrams and tokens seen."""

    bigrams: np.ndarray
    bigram_llr: np.ndarray
    unigrams: np.ndarray
    unigram_llr: np.ndarray
    weights: np.ndarray
    power: float

    def sums(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ratio and number of tokens of each row."""
        stream, pairs, _, rows = tokens(text)
        at = _find(self.bigrams, pairs)
        llr, known = np.zeros(len(at)), at < len(self.bigrams)
        llr[known] = self.bigram_llr[at[known]]
        at = _find(self.unigrams, stream)
        known = ~known & (at < len(self.unigrams))
        llr[known] = self.unigram_llr[at[known]]
        return np.bincount(rows, llr, len(text)), np.bincount(rows, minlength=len(text)).astype(float)

    def score(self, text: pa.Array) -> np.ndarray:
        return sigmoid(features(*self.sums(text), self.power) @ self.weights)


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted array; its length where they are missing."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys)
    at[known[np.minimum(at, len(known) - 1)] != keys] = len(known)
    return at


def features(sums: np.ndarray, n: np.ndarray, power: float) -> np.ndarray:
    return np.column_stack([np.ones(len(n)), sums / np.maximum(n, 1) ** power])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Sample:
    """Labelled texts as distinct tokens and bigrams, and the documents that hold them."""

    def __init__(self, text: pa.Array, toxic: np.ndarray):
        pieces = [b.column("text") for b in chunked(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), "text")]
        names, found = [], []
        for piece in pieces:  # once for the distinct tokens and bigrams, once to code the texts, so that no array has all tokens as hashes
            stream, pairs, before, _ = tokens(piece)
            names.append(np.unique(stream))
            keys, first = np.unique(pairs, return_index=True)
            found.append((keys, stream[first], before[first]))
        self.names = np.unique(np.concatenate(names))
        keys, last, context = map(np.concatenate, zip(*found, strict=True))
        del names, found
        self.keys, first = np.unique(keys, return_index=True)
        self.last, self.context = (_find(self.names, x[first]).astype(np.int32) for x in (last, context))  # of each bigram
        del keys, last, context, first

        coded, first_row = [], 0
        for piece in pieces:
            stream, pairs, _, rows = tokens(piece)
            items = [_find(self.names, stream), _find(self.keys, pairs)]
            held = [np.divmod(np.unique(x * len(piece) + rows), len(piece)) for x in items]
            coded.append([items[1].astype(np.int32), (rows + first_row).astype(np.int32), *(x.astype(np.int32) for item, row in held for x in (item, row + first_row))])
            first_row += len(piece)
        self.pair_of, self.rows, *held = map(np.concatenate, zip(*coded, strict=True))
        self.held = [held[:2], held[2:]]
        self.toxic = toxic.astype(bool)
        self.n = np.bincount(self.rows, minlength=len(toxic)).astype(float)

    def ratios(self, used: np.ndarray, discount: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Log ratios of tokens and of bigrams, learnt from the used documents, and how many of those hold them."""
        singles, doubles = ([np.bincount(item[used[row] & (self.toxic[row] == c)], minlength=n).astype(float) for c in (True, False)] for (item, row), n in zip(self.held, (len(self.names), len(self.keys)), strict=True))

        def continued(double: np.ndarray, below: np.ndarray | float) -> np.ndarray:
            """Discounted numbers of contexts of each token, and what is below."""
            follows = np.bincount(self.last, double > 0, len(self.names))
            total = max(1.0, follows.sum())
            return np.maximum(follows - discount, 0) / total + (discount * np.count_nonzero(follows) / total if follows.any() else 1.0) * below

        shared = continued(sum(doubles), 1 / (len(self.names) + 1))
        unigram, bigram = [], []
        for double in doubles:
            p = continued(double, shared)
            follows = np.bincount(self.context, double, len(self.names) + 1)
            kinds = np.bincount(self.context, double > 0, len(self.names) + 1)
            left = np.where(follows > 0, discount * kinds / np.maximum(follows, 1), 1.0)
            unigram.append(p)
            bigram.append(np.maximum(double - discount, 0) / np.maximum(follows, 1)[self.context] + left[self.context] * p[self.last])
        return [np.log(x[0] / x[1]) for x in (unigram, bigram)], [sum(singles), sum(doubles)]

    def smoothed(self, ratios: list[np.ndarray], n: list[np.ndarray], rare: float) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens and of bigrams; a bigram leaves to its last token what it doesn't count."""
        of_token, of_pair = (x**2 / (x**2 + max(rare, 1e-9) ** 2) for x in n)
        tokens = of_token * ratios[0]
        return tokens, of_pair * ratios[1] + (1 - of_pair) * tokens[self.last]

    def sums(self, pair_llr: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, pair_llr[self.pair_of], len(self.toxic))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by Newton's method with a small ridge, and the mean loss."""
    w, ridge = np.zeros(2), np.diag([1e-6, 1e-2])
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(sigmoid(x @ w), 1e-12, 1 - 1e-12)
    return w, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(text: pa.Array, toxic: np.ndarray, share: float, discount: float = DISCOUNT, folds: int = 4) -> Model | None:
    """Models of all rows, and weights from rows scored by models of the other folds.

    ``share`` is the share of toxic documents where scores will be used.
    """
    if len(np.unique(toxic)) < 2:
        return None
    sample = Sample(text, toxic)
    fold, sums = np.arange(len(toxic)) % folds, {r: np.zeros(len(toxic)) for r in RARE}
    for k in range(folds):
        own = fold == k
        if len(np.unique(toxic[~own])) == 2:
            learnt = sample.ratios(~own, discount)
            for r in RARE:
                sums[r][own] = sample.sums(sample.smoothed(*learnt, r)[1])[own]
    tried = [(*logistic(features(sums[r], sample.n, power), toxic), r, power) for r in RARE for power in POWERS]
    w, _, rare, power = min(tried, key=lambda x: x[1])
    seen = toxic.mean()
    w[0] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    token_llr, pair_llr = sample.smoothed(*sample.ratios(np.ones(len(toxic), bool), discount), rare)
    return Model(sample.keys, pair_llr, sample.names, token_llr, w, power)


def stored(model: Model | None) -> bytes:
    """A model for sending: keys as steps, byte by byte, and single-precision ratios, compressed."""

    def planes(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)

    if model is None:
        return b""
    parts = [planes(np.diff(k, prepend=np.uint64(0))) for k in (model.bigrams, model.unigrams)] + [planes(x.astype(np.float32)) for x in (model.bigram_llr, model.unigram_llr)]
    return zstandard.compress(pickle.dumps((parts, model.weights, model.power)), 6)


@lru_cache(maxsize=1)
def loaded(body: bytes) -> Model | None:
    if not body:
        return None
    parts, weights, power = pickle.loads(zstandard.decompress(body))
    bigrams, unigrams = (np.cumsum(np.ascontiguousarray(p.T).view(np.uint64).ravel(), dtype=np.uint64) for p in parts[:2])
    ratios = [np.ascontiguousarray(p.T).view(np.float32).ravel() for p in parts[2:]]
    return Model(bigrams, ratios[0], unigrams, ratios[1], weights, power)


def held_out(doc_id) -> object:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[bytes, float]:
    """A stored model of the labelled rows that aren't held out (empty: none), and the share of toxic ones."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    # the cut is by hash of the id: a bounded, repeatable sample, with as many of either class
    most = min(per_class, *(max(1, n.get(c, 0)) for c in (0, 1)))
    picked = [marked.where(F.col("toxic") == c).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id").limit(most) for c in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    rows = text_of(docs, "doc_id").join(ids, "doc_id").select("text", "toxic", "h")
    before = W.partitionBy("toxic").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.sum(F.octet_length("text")).over(before)).where(F.coalesce("before", F.lit(0)) < BYTES).drop("before")
    prior = min(max(share, 1e-6), 1 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.argsort(np.asarray(table.column("h")), kind="stable")))
            model = fit(table.column("text").combine_chunks(), np.asarray(table.column("toxic"), dtype=np.int64), prior)
            del held, table
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([stored(model)], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()  # one row, from a bounded sample
    return (bytes(found[0]["model"]) if found else b""), share


def score(docs: DataFrame, labels: DataFrame, *columns: str, per_class: int = PER_CLASS, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """``columns``, doc_id, held_out, score and predicted for every row of ``docs``, and with ``keep_text`` its text.

    Scores depend on the text only; null and empty texts, and texts without words, score
    as a text that says nothing.  Of repeated labels of a document, toxic counts; null
    labels don't.  Without labels of both classes every score is the share of toxic
    labels.  Rows that repeat get equal scores; other columns are ignored.
    """
    spark = docs.sparkSession
    body, share = learn(docs, labels, per_class)
    sent = spark.sparkContext.broadcast(body)  # bounded by per_class and BYTES
    kept = text_of(docs, "doc_id", *columns)
    names = ["doc_id", *columns] + ["text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            model = loaded(sent.value)
            s = model.score(batch.column("text")) if model else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64())], names=[*names, "score"])

    scored = kept.mapInArrow(run, kept.select(*names).schema.add("score", "double"))
    text = [F.col("text").cast("string").alias("text")] * keep_text
    return scored.select("doc_id", *columns, *text, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
