"""Cross-entropy difference: how much better a target model foretells a document than a background model.

Both are interpolated bigram models over one vocabulary of words, learnt alike: the
target's from the documents marked as good, the background's from all documents.  Every
distinct word and bigram of the corpus has its own count, so the models grow with the
corpus; no task and not the driver holds one whole.  A document's own counts are left out
when it is scored, else the target would know its own documents by heart.

Documents are put into chunks of some megabytes.  A chunk's distinct keys, sorted, are
sent with their counts, cut by ranges of keys.  Each range sums the counts of its keys
over all chunks and answers each chunk in the order of its list; the chunk's documents
are then scored from the answers.  Keys are hashes whose width grows with the corpus:
about one key in 500,000 shares its hash with another one, at every size.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, buffer_of, chunked
from .words import BASES, LOWER, WORDLIKE, Rolling, find, mix

#: Weight of bigrams, and counts added to each word of the vocabulary.
BIGRAM, ADDED = 0.6, 0.1
#: Bytes of text in a chunk, and at most for each range of keys.
CHUNK, RANGE = 8 << 20, 32 << 20
#: Bits of a key beyond the logarithm of the corpus's bytes.
SPARE = 16
#: The mark before a row's first word, and the salt that tells words from bigrams.
MARK, WORD = np.uint64(BASES[1]), np.uint64(0x5851F42D4C957F2D)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(body))


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


def _planes(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as steps, byte by byte, so that bytes that are mostly zero lie together."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(len(keys), 8).T)


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word) of each word of each row, as hashes, and the words of each row; a mark is before the first one."""
    data, offsets = buffer_of(text)
    words = find(LOWER[data], offsets, WORDLIKE)
    h = Rolling(words.data.astype(np.uint64) + np.uint64(1), BASES[0])(words.starts, words.ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    n = np.diff(words.first)
    before[words.first[:-1][n > 0]] = MARK
    return before, h, n


class Chunk:
    """Documents coded as positions in ``keys``, which are sorted.

    A word's count as a context is its count as a word, so that what its bigrams leave is
    the chance that the text ends; the mark counts the rows that have words.
    """

    def __init__(self, text: pa.Array, good: np.ndarray, width: int):
        parts = [hashes(p.column("text")) for p in chunked(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), "text")]
        before, word, self.n = map(np.concatenate, zip(*parts, strict=True))
        del parts
        pairs, first, seq = np.unique(mix(before * np.uint64(BASES[0]) + word), return_index=True, return_inverse=True)
        last, context = word[first], before[first]
        words, of = np.unique(np.concatenate([last, context, [MARK]]), return_inverse=True)
        del before, word, first
        keys = np.concatenate([pairs, mix(words ^ WORD)]) >> np.uint64(64 - width)
        self.keys, place = np.unique(keys, return_inverse=True)
        place = place.astype(np.int32)
        self.rows, words_at = np.repeat(np.arange(len(self.n)), self.n), place[len(pairs) :]
        self.pair_at, self.word_at, self.context_at = place[: len(pairs)][seq], words_at[of[: len(pairs)]][seq], words_at[of[len(pairs) : -1]][seq]
        mark = words_at[of[-1]]
        self.is_word = np.zeros(len(self.keys), bool)
        self.is_word[self.word_at] = True
        self.counts = []
        for held in (good, np.ones(len(good), bool)):
            used = held[self.rows]
            count = sum(np.bincount(at[used], minlength=len(self.keys)) for at in (self.pair_at, self.word_at))
            count[mark] += np.count_nonzero(held & (self.n > 0))
            self.counts.append(count)

    def lists(self, width: int, bits: int) -> Iterator[tuple[int, bytes]]:
        """(range, its keys, whether they are words, and their counts in good and in all documents)."""
        of = (self.keys >> np.uint64(width - bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            yield int(of[a]), _packed(_planes(self.keys[a:b]), np.packbits(self.is_word[a:b]), *(_narrow(c[a:b]) for c in self.counts))


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def _read(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(body)).read_all().combine_chunks()


def _coded(table: pa.Table, width: int) -> Chunk:
    return Chunk(table.column("_text").combine_chunks(), np.asarray(table.column("_good"), dtype=bool), width)


def _chunks(marked: DataFrame) -> DataFrame:
    """(chunk, documents): rows of about ``CHUNK`` bytes of text, compressed."""
    schema = pa.schema([("chunk", pa.int64()), ("documents", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": uuid.uuid4().int >> 65, "documents": _stored(pa.Table.from_batches(held))}], schema)

        for piece in chunked(batches, "_text"):
            held.append(piece)
            size += piece.column("_text").nbytes
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return marked.mapInArrow(run, "chunk long, documents binary")


def _lists(chunks: DataFrame, width: int, bits: int) -> DataFrame:
    """(chunk, range, keys, words, good_words): a row for each range of a chunk; its words are told on the first one."""
    schema = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("words", pa.int64()), ("good_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = _read(row["documents"])
                chunk, good = _coded(table, width), np.asarray(table.column("_good"), dtype=bool)
                words, good_words = int(chunk.n.sum()), int(chunk.n[good].sum())
                found: list[dict] = []
                for of, body in chunk.lists(width, bits):
                    found.append({"chunk": row["chunk"], "range": of, "keys": body, "words": words, "good_words": good_words})
                    words = good_words = 0
                    if len(found) == 256:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found = []
                yield pa.RecordBatch.from_pylist(found, schema)

    return chunks.mapInArrow(run, "chunk long, range long, keys binary, words long, good_words long")


def _totals(group: pa.Table) -> pa.Table:
    """Of each list of a range, the counts over all lists, in the list's order; new_words: the range's distinct words, on one row."""
    lists = [_unpacked(body) for body in group.column("keys").to_pylist()]
    sizes = [x[0].shape[1] for x in lists]
    keys, at = np.unique(np.concatenate([_keys(x[0]) for x in lists]), return_inverse=True)
    word = np.concatenate([np.unpackbits(x[1], count=s).astype(bool) for x, s in zip(lists, sizes, strict=True)])
    sums = [np.bincount(at, np.concatenate([x[k] for x in lists]).astype(float), len(keys)).astype(np.int64) for k in (2, 3)]
    bodies = [_packed(*(_narrow(s[at[b - n : b]]) for s in sums)) for n, b in zip(sizes, np.cumsum(sizes), strict=True)]
    new = np.zeros(len(lists), np.int64)
    new[0] = len(np.unique(at[word]))
    return pa.table({"chunk": group.column("chunk"), "range": group.column("range"), "totals": pa.array(bodies, pa.binary()), "new_words": pa.array(new), "words": group.column("words"), "good_words": group.column("good_words")})


def _own(rows: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """How often each item occurs in its row."""
    _, at, counts = np.unique(rows.astype(np.int64) * n_items + items, return_inverse=True, return_counts=True)
    return counts[at]


def losses(chunk: Chunk, good: np.ndarray, totals: list[np.ndarray], seen: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, target loss, background loss) of each row of a chunk, in nats a word."""
    n, rows, first = chunk.n, chunk.rows, np.zeros(len(chunk.rows), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    own12, own2 = (_own(rows, x, len(chunk.keys)) for x in (chunk.pair_at, chunk.word_at))
    own1 = np.where(first, 1, np.roll(own2, 1))  # a context is the word before, or the mark
    out = []
    for total, held, words in zip(totals, (good, np.ones(len(n), bool)), seen, strict=True):
        c12, c1, c2 = (total[at].astype(np.int64) - own * held[rows] for at, own in ((chunk.pair_at, own12), (chunk.context_at, own1), (chunk.word_at, own2)))
        base = (c2 + ADDED) / ((words - n * held)[rows] + ADDED * vocabulary)
        p = np.where(c1 > 0, BIGRAM * c12 / np.maximum(c1, 1) + (1 - BIGRAM) * base, base)
        out.append(np.bincount(rows, -np.log(p), len(n)) / np.maximum(n, 1))
    return n, *out


def score(docs: DataFrame, target: DataFrame, *columns: str) -> DataFrame:
    """doc_id, ``columns``, n_words, target_loss, background_loss and their difference for every row.

    ``target`` holds the doc_id of the documents to be like.  Losses are nats a word, 0
    for null and word-less texts.  A document that repeats in ``target`` counts once, one
    that repeats in ``docs`` each time.  Other columns are ignored; empty tables give
    empty results.
    """
    scratch, names = Scratch(docs.sparkSession), ["doc_id", *columns]
    marks = target.select("doc_id").where("doc_id is not null").distinct().withColumn("_marked", F.lit(True))
    texts = docs.select(*names, F.col("text").cast("binary").alias("_text"))
    marked = texts.join(marks.hint("shuffle_hash"), "doc_id", "left").withColumn("_good", F.coalesce("_marked", F.lit(False))).drop("_marked")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, width = (size // RANGE).bit_length(), min(64, size.bit_length() + SPARE)

    chunks = scratch.keep(_chunks(marked), "chunks")
    summed = _lists(chunks, width, bits).groupBy("range").applyInArrow(_totals, "chunk long, range long, totals binary, new_words long, words long, good_words long")
    answers = scratch.keep(summed, "totals")
    sums = answers.agg(F.sum("good_words"), F.sum("words"), F.sum("new_words")).first()
    *seen, vocabulary = (x or 0 for x in sums)

    def scored(held: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        answered = [_unpacked(body) for body in found.sort_by("range").column("totals").to_pylist()]
        totals = [np.concatenate([a[k] for a in answered]) for k in (0, 1)]
        for documents in held.column("documents").to_pylist():
            table = _read(documents)
            good = np.asarray(table.column("_good"), dtype=bool)
            n, t, b = losses(_coded(table, width), good, totals, seen, max(1, vocabulary))
            out.append(pa.table([*(table.column(c) for c in names), pa.array(n), pa.array(t), pa.array(b), pa.array(t - b)], names=[*names, "n_words", "target_loss", "background_loss", "difference"]))
        return pa.concat_tables(out)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*names).schema)
    both = chunks.groupBy("chunk").cogroup(answers.select("chunk", "range", "totals").groupBy("chunk"))
    return both.applyInArrow(scored, f"{head}, n_words long, target_loss double, background_loss double, difference double")
