"""Byte-level BPE on padded matrices: many pre-tokens are merged at once with numpy.

Distinct pre-tokens are bucketed by length and padded to matrices of ids.  In each round
every row merges its leftmost pair of least rank, found by a hashed table of mergeable
pairs; the rows are then shifted together, and rows with no pair left are taken out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pretokens import Coder
from .shared import CODED_BYTES, chunked, text_of

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; a longer pre-token is merged alone, with a heap, in the same order.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class PairTable:
    """Open-addressed hash table from (left id, right id) to the rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [((ranks[t[:i]] << 32) | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge, or either is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, into = keys.ravel(), out.ravel()
        slot = self._slot(flat[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == flat[todo]
            into[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return into.reshape(keys.shape)


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.spelled = Spelling(self.tokens)
        self.decimal = Spelling([b"%d," % i for i in range(len(self.tokens))])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of each pre-token, as if each were encoded alone."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > WIDTHS[-1]:
                out[i] = np.array(self._merge_long(word), np.int32).tobytes()
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(word) <= w), []).append(i)
        for width, which in by_width.items():
            for at in range(0, len(which), step := max(1, (1 << 18) // width)):
                part = which[at : at + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        ids = self.single[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)]
        ids[np.arange(width) >= sizes[:, None]] = -1
        done, final = np.full((n, width), -1, np.int32), sizes.copy()
        rows, column = np.arange(n), np.arange(width)
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            ended = best == NONE
            if ended.any():  # compaction
                done[rows[ended]] = np.pad(ids[ended], ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
                go = ~ended
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            final[rows] -= 1
            n_ids = ids.shape[1] - 1
            shift = column[:n_ids] + (column[:n_ids] > at[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[each, at] = best
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, : n_ids - 1] + 0, ranks.shape[1] - 1), axis=1) if n_ids > 1 else np.zeros((len(rows), 0), np.int32)
            if n_ids == 1:
                done[rows, 0] = ids[:, 0]
                break
            after = at < n_ids - 1
            ranks[each[after], at[after]] = self.pairs(ids[each[after], at[after]], ids[each[after], at[after] + 1])
            before = at > 0
            ranks[each[before], at[before] - 1] = self.pairs(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        raw = done.tobytes()
        return [raw[4 * width * i : 4 * (width * i + k)] for i, k in enumerate(final.tolist())]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long pre-token, in time n log n."""
        ranks, n = self.ranks, len(word)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        alive = [True] * n

        def rank(i: int) -> int | None:
            return ranks.get(word[i : end[end[i]]]) if end[i] < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue
            gone = end[i]
            alive[gone], end[i] = False, to
            if to < n:
                left[to] = i
            for j in (i, left[i]):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j, end[end[j]]))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Spelling:
    """A table of byte strings, gathered for an array of indices."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of all ids together, and where each begins (and the end)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[where].tobytes(), np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def model(path: str) -> tuple[ByteBpe, Coder]:
    bpe = ByteBpe(path)
    return bpe, Coder(bpe.encode_words)


def encode(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """``columns``, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids and the decoded bytes.

    Null and empty texts have no ids.  Each row is encoded on its own, so repeated rows
    give equal results; other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = text_of(docs, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, code = model(path)
        for batch in chunked(batches, "text", CODED_BYTES):
            flat, first = code(batch.column("text"))
            digits, digit_at = bpe.decimal(flat)
            decoded, byte_at = bpe.spelled(flat)
            spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            names = [hashlib.sha256(digits[digit_at[a] : max(digit_at[a], digit_at[b] - 1)]).hexdigest() for a, b in spans]
            texts = [decoded[byte_at[a] : byte_at[b]] for a, b in spans]
            out = [*(batch.column(c) for c in columns), pa.array(np.diff(first)), pa.array(names, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if ids:
                out += [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat, pa.int32())), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * ids])

    schema = kept.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return kept.mapInArrow(run, schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary") if ids else schema)
