"""Packing token streams into sequences of bounded length, by best-fit decreasing.

A document's ids, ended by ``END``, are cut into full windows and a rest.  Rests are
dealt over tasks by a hash of their keys, and each task packs its own: longest first,
each into the open sequence with the least room that still holds it.  Room is a whole
number up to ``size``, so open sequences are filed by their room, and a segment tree
over the rooms finds the tightest.  Each task leaves at most one half-empty sequence or
so, and a task's memory is bounded by ``BLOCK`` pieces, however many it is dealt.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Coder
from .shared import CODED_BYTES, chunked, text_of

SIZE, END = 1024, 0
#: Pieces packed together by a task; with their ids, a 64th of it.
BLOCK = 1 << 20


class RoomTree:
    """A segment tree over rooms 0..size; a leaf holds the open sequences with that room."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.filled = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.width
        while at:
            self.filled[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) for the smallest room of ``least`` or more."""
        filled, at = self.filled, least + self.width
        while not filled[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at + (not filled[2 * at])
        room = at - self.width
        while at:
            filled[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given in falling order of length."""
    tree, sequence, offset, n = RoomTree(size), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        room, at = tree.take(length) or (size, -1)
        if at < 0:
            at, n = n, n + 1
        sequence[i], offset[i] = at, size - room
        if room > length:
            tree.add(room - length, at)
    return sequence, offset


@lru_cache(maxsize=2)
def coder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of a column's rows by the tokenizers library, one after another, and the row offsets in them.

    Rows that hold the string of an added token are coded whole, as the library cuts a text at
    those before anything else; of all others each distinct pre-token is coded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    added = [t.content for t in model.get_added_tokens_decoder().values()]

    def encode(words: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    plain = Coder(encode)

    def code(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.zeros(len(column), bool)
        for content in added:
            odd |= np.asarray(pc.fill_null(pc.match_substring(column, content), False))
        if not odd.any():
            return plain(column)
        flat, first = plain(pc.if_else(pa.array(odd), pa.scalar(b"", column.type), column))
        whole = {r: np.array(model.encode(column[r].as_py().decode(), add_special_tokens=False).ids, np.int32) for r in np.flatnonzero(odd).tolist()}
        parts = [whole[r] if odd[r] else flat[first[r] : first[r + 1]] for r in range(len(column))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    return code


def pieces(docs: DataFrame, path: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of all pieces of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in chunked(batches, "text", CODED_BYTES):
            flat, first = code(batch.column("text"))
            if not batch.num_rows:
                continue
            tokens = np.diff(first) + 1
            stream = np.insert(flat, first[1:], END).astype("<u4")
            begin = np.cumsum(tokens) - tokens
            count = -(-tokens // size)
            row = np.repeat(np.arange(len(tokens)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(tokens[row] - start, size)
            raw = memoryview(stream.tobytes())
            cut = [raw[4 * a : 4 * b] for a, b in zip((begin[row] + start).tolist(), (begin[row] + start + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(tokens[row])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in cut], pa.binary())] * ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_of(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset, and with ``ids`` their little-endian ids.

    Null and empty texts give the one piece that holds only the end id; rows that repeat
    a doc_id, or have none, are packed each on its own; other columns are ignored; an
    empty table gives none.
    """
    cut = pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), size, ids)
    # in an order of its own, so that a task that runs again packs alike
    dealt = cut.repartition(F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions("ids_crc32", "start", "doc_id")

    def packed(table: pa.Table, base: int) -> tuple[pa.Table, int]:
        length = np.asarray(table.column("length"))
        key = [np.asarray(table.column(c).fill_null(0)) for c in ("ids_crc32", "start", "doc_id")]
        order = np.lexsort((*key, -length))
        sequence, offset = best_fit(length[order], size)
        out = table.take(pa.array(order)).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
        return out, base + (int(sequence.max()) + 1 if len(sequence) else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= BLOCK >> (6 * ids):
                out, base = packed(pa.Table.from_batches(held), base)
                held, rows = [], 0
                yield from out.to_batches(max_chunksize=10_000)
        if rows:
            yield from packed(pa.Table.from_batches(held), base)[0].to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, T.StructType(list(dealt.schema.fields)).add("sequence_id", "long").add("offset", "long"))
