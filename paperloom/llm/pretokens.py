"""Pre-tokens of many texts at once, as spans that cover every byte.

``public_tokenizers.PATTERN`` gives every character to exactly one match, so a text's
matches are its bytes cut at some places.  For characters up to U+00FF those places
follow from classes of neighbouring characters and are found with numpy for a whole
chunk; a text with other characters goes through the pattern itself.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from .shared import buffer_of

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_PATTERN = regex.compile(public_tokenizers.PATTERN)


def _class_of(c: str) -> int:
    return LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if c in "\t\n\v\f\r \x85\xa0" else OTHER


_CLASS = np.array([_class_of(chr(i)) for i in range(256)], np.uint8)


def _cuts_latin(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start; all characters are below U+0100."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)  # byte position of each character
    code = data[at]
    two = code >= 0xC0
    code = code.copy()
    code[two] = ((code[two] & 0x03) << 6) | (data[at[two] + 1] & 0x3F)
    kind = _CLASS[code]
    n = len(at)
    new_row = np.zeros(n + 1, bool)
    new_row[np.searchsorted(at, offsets)] = True
    new_row[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) | new_row[1:n]
    cut = change.copy()
    is_space = kind == SPACE
    plain = code == 0x20
    # the last white space before other characters of its row stands alone, or a plain space joins them
    last_space = np.zeros(n, bool)
    last_space[:-1] = is_space[:-1] & ~is_space[1:] & ~new_row[1:n]
    cut[:n] |= last_space
    joined = np.flatnonzero(last_space & plain) + 1
    cut[joined] = False
    # contractions: an apostrophe that starts a match
    mark = np.flatnonzero((code == 0x27) & change[:n])
    after_space = np.zeros(n + 1, bool)
    after_space[joined] = True
    mark = mark[~after_space[mark] & (mark + 1 < n)]
    mark = mark[~new_row[mark + 1]]
    if len(mark):
        c1 = code[mark + 1]
        has2 = (mark + 2 < n) & ~new_row[np.minimum(mark + 2, n)]
        c2 = np.where(has2, code[np.minimum(mark + 2, n - 1)], 0)
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        pair = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for hit, length in ((mark[one], 2), (mark[pair], 3)):
            cut[hit + 1] = False
            cut[hit + length] = True
    return at[np.flatnonzero(cut[:n])]


def _cuts_any(text: str) -> list[int]:
    """Byte positions at which pre-tokens start, by the pattern."""
    out, at = [], 0
    for m in _PATTERN.findall(text):
        out.append(at)
        at += len(m.encode())
    return out


def pretokens(column: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """All pre-tokens of a binary column, and the position of each row's first (and the end)."""
    data, offsets = buffer_of(column)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    odd = np.flatnonzero(data >= 0xC4)
    if not len(odd):
        cuts = _cuts_latin(data, offsets)
    else:
        strange = np.zeros(len(offsets) - 1, bool)
        strange[np.searchsorted(offsets, odd, side="right") - 1] = True
        pieces = []
        edges = np.flatnonzero(np.diff(np.concatenate([[not strange[0]], strange]).astype(np.int8))).tolist() + [len(strange)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if strange[a]:
                for r in range(a, b):
                    pieces.append(np.array(_cuts_any(data[offsets[r] : offsets[r + 1]].tobytes().decode()), np.int64) + offsets[r])
            elif offsets[b] > offsets[a]:
                pieces.append(_cuts_latin(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a])
        cuts = np.concatenate(pieces)
    bounds = np.append(cuts, len(data)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return tokens, np.searchsorted(cuts, offsets)


class Coder:
    """Ids of pre-tokens, with a bounded memory of those met before.

    ``encode`` gives the id lists of distinct pre-tokens that are not remembered.
    """

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's rows, one after another, and the row offsets in them."""
        tokens, first = pretokens(column)
        if not len(tokens):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        known = self.known
        if fresh := [w for w in words if w not in known]:
            known.update(zip(fresh, self.encode(fresh), strict=True))
        lists = [known[w] for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.frombuffer(b"".join(lists), np.int32) if lists and isinstance(lists[0], bytes) else np.concatenate(lists)
        if lists and isinstance(lists[0], bytes):
            sizes //= 4
        begin = np.cumsum(sizes) - sizes
        index = np.asarray(coded.indices, dtype=np.int64)
        each = sizes[index]
        ends = np.cumsum(each)
        pick = np.repeat(begin[index] - (ends - each), each) + np.arange(ends[-1])
        return flat[pick], np.concatenate([[0], ends])[first]
