"""Words of many texts at once, as numpy spans and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters and digits; those of non-ASCII characters count as letters.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Two odd bases of the polynomial hashes; two make a digest of 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (np.uint64(base), np.uint64(inverse)))
    return up, down


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses modulo 2**64, from tables of doubling sizes."""
    return _powers(base, 1 << max(12, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near hashes spread over all bits."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Polynomial hashes of any spans of one sequence, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


@dataclass
class Words:
    """Spans of words in one buffer; word i of row r has first[r] <= i < first[r + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, base: int) -> np.ndarray:
        return Rolling(self.data.astype(np.uint64) + np.uint64(1), base)(self.starts, self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` (a table of 256) holds, cut at row offsets."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    on = inside[data]
    starts = on.copy()
    starts[1:] &= ~on[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = on[cuts]
    ends = on.copy()
    ends[:-1] &= ~on[1:]
    inner = cuts[cuts > 0] - 1
    ends[inner] = on[inner]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, s, e, np.searchsorted(s, offsets))
