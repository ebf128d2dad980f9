"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  Nothing here loops over documents or words in
Python: a slice of documents is one byte buffer, word bounds are found by
comparing neighbouring bytes, and hashes are differences of prefix sums of a
polynomial with odd multipliers modulo 2**64, finished by an avalanche mix.
Slices are cut at document bounds after about ``SLICE_BYTES`` bytes, so the
temporary arrays stay a fixed multiple of that size or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes outside words of letters: all of ASCII but its letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; grown on demand."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
    return have


@dataclass
class Words:
    """Words of some documents: byte bounds in ``data`` and, for document d, words first[d]..first[d+1]-1."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, most: int = 0) -> np.ndarray:
        """A hash of each word, or of its first ``most`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        pw, inv = powers(_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * pw[: len(self.data)], out=sums[1:])
        end = np.minimum(self.end, self.start + most) if most else self.end
        return mix((sums[end] - sums[self.start]) * inv[self.start] + (end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Word bounds of documents data[offsets[d]:offsets[d+1]]; ``between`` flags the bytes that words do not have."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    space = between[data]
    opens = np.empty(n + 1, bool)
    opens[0] = True
    opens[1:] = space
    opens[offsets] = True  # a document's first byte has nothing before it
    begin = ~space
    stop = begin.copy()
    begin &= opens[:-1]
    closes = np.empty(n + 1, bool)
    closes[:-1] = space
    closes[n] = True
    closes[offsets] = True
    stop &= closes[1:]
    start = np.flatnonzero(begin)
    return Words(data, offsets, start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one document, and the index of each one's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k <= 6:
        got = hashes[: n - k + 1].copy()
        for j in range(1, k):
            got *= np.uint64(_BASE2)
            got += hashes[j : n - k + 1 + j]
    else:
        pw, inv = powers(_BASE2, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * pw[:n], out=sums[1:])
        got = (sums[k:] - sums[:-k]) * inv[: n - k + 1]
    at = np.arange(n - k + 1)
    ok = at + k <= np.repeat(first[1:], np.diff(first))[: n - k + 1]
    return mix(got[ok]), at[ok]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, lower: bool = False, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of documents of a string column, whole texts each."""
    if not len(column):
        return
    data, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1))
        yield lo, hi, scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, between)
        lo = hi


def ragged_unique(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs sorted by doc, then value."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted, where document d has values[first[d]:first[d+1]]; and the new bounds.

    Sorts document by document, in place: short sorts of plain integers are much
    faster than one long sort by two keys.
    """
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = first[:-1][first[:-1] < first[1:]]
    keep[starts] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[first]
