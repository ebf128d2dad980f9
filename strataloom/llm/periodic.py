"""Runs of repeated words, by the linear-time tandem-repeat method of Gusfield and Stoye.

Documents are taken some at a time as one sequence of numbered words, in which
no repeat crosses a document.  A suffix array stands for the suffix tree; the
rank tables made while it is sorted name every word sequence whose length is a
power of two, so any two sequences are compared by two lookups, and common
extensions to either side of any two places by a few.

Three steps find every kind of square (a sequence of words twice in a row):
blocks of the Lempel-Ziv factorisation give squares that cover the leftmost
place of each kind; each marks its place in the tree; and from each mark, suffix
links lead to the kinds that are its rotations.  Then the leaves below each mark
are all places of that kind, and places side by side merge into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import ship

#: Words of some documents that are looked at together; a longer document is taken alone.
TOGETHER = 1 << 15


class Suffixes:
    """Sorted suffixes of a sequence of documents, with names of all windows of 1, 2, 4 ... words."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray):
        n = len(symbols)
        self.n, self.symbols = n, symbols
        key = doc.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        rank, heads = np.empty(n + 1, np.int32), _heads(key[order])
        rank[order], rank[n] = heads, -1
        #: names[j][i]: the first place, in order, of suffixes with the 2**j words from i; no window leaves its document
        self.names = [rank]
        open_ = np.flatnonzero(_shared(heads))
        ends = np.searchsorted(doc, doc, "right")
        width = 1
        while len(open_):
            at = order[open_]
            after = np.minimum(at + width, n)
            second = np.where(after < ends[at], rank[after], -1)
            key = rank[at].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            order[open_] = at = at[by]
            heads = open_[_heads(key[by])]
            rank = rank.copy()
            rank[at] = heads
            self.names.append(rank)
            open_ = open_[_shared(heads)]
            width *= 2
        self.order, self.ends = order, ends

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that are equal from the different places x and y on."""
        return self._extend(x, y, True)

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that are equal before the different places x and y."""
        return self._extend(x, y, False)

    def _extend(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        def same(j: int, at: np.ndarray) -> np.ndarray:
            if forward:
                a, b = x[at] + got[at], y[at] + got[at]
                return self.names[j][a] == self.names[j][b]
            a, b = x[at] - got[at] - (1 << j), y[at] - got[at] - (1 << j)
            fits = np.minimum(a, b) >= 0
            return fits & (self.names[j][np.maximum(a, 0)] == self.names[j][np.maximum(b, 0)])

        got, live, alike = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for j in range(len(self.names)):
            live = live[same(j, live)]
            if not len(live):
                break
            alike.append(live)
        for j in range(len(alike) - 1, -1, -1):
            live = alike[j][same(j, alike[j])]
            got[live] += 1 << j
        return got

    def below(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in order the suffixes begin and end that share their first ``length`` words with the suffix i."""
        place = self.names[-1][i].astype(np.int64)
        level = np.minimum(np.frexp(length.astype(float))[1] - 1, len(self.names) - 1)  # 2**level <= length
        rest = length - (1 << level)
        names = np.concatenate(self.names)
        start = level * (self.n + 1)
        left, right = names[start + i], names[start + i + rest]

        def shares(m: np.ndarray) -> np.ndarray:
            at = self.order[m]
            return (names[start + at] == left) & (names[start + np.minimum(at + rest, self.n)] == right)

        lo, hi, first, last = left.astype(np.int64), place.copy(), place.copy(), np.full(len(i), self.n - 1)
        while (lo < hi).any():  # the first that shares
            m = (lo + hi) // 2
            yes = shares(m)
            hi, lo = np.where(yes, m, hi), np.where(yes, lo, np.minimum(m + 1, hi))
        while (first < last).any():  # the last that shares
            m = (first + last + 1) // 2
            yes = shares(m)
            first, last = np.where(yes, m, first), np.where(yes, last, np.maximum(m - 1, first))
        return lo, first + 1

    def onward(self, i: int, length: int, symbol: int) -> int:
        """A suffix that shares its first ``length`` words with the suffix i and goes on with ``symbol``; -1 if none does."""
        level = min(length.bit_length() - 1, len(self.names) - 1)
        names, rest = self.names[level], length - (1 << level)
        left, right, order, symbols, ends = names[i], names[i + rest], self.order, self.symbols, self.ends

        def side(m: int) -> int:
            """Where the suffix in place m lies: before those wanted (-1), among them (0) or behind (1)."""
            at = order[m]
            if names[at] != left:
                return 1
            if names[at + rest] != right:
                return -1 if m < place else 1
            after = symbols[at + length] if at + length < ends[at] else -1
            return int(after > symbol) - int(after < symbol)

        place = int(self.names[-1][i])
        lo, hi, step = int(left), place + 1, 1
        while hi < self.n and side(hi) <= 0:  # a bound behind them, by steps that double
            hi, step = min(self.n, hi + step), step * 2
        while lo < hi:
            m = (lo + hi) // 2
            lo, hi = (m + 1, hi) if side(m) < 0 else (lo, m)
        return int(order[lo]) if lo < self.n and side(lo) == 0 else -1


def _heads(keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys, where the first equal one is."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _shared(heads: np.ndarray) -> np.ndarray:
    """Which elements have others with their head."""
    same = heads[1:] == heads[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(heads) else np.zeros(0, bool)


def _earlier(order: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it, not before ``low``, with a smaller value; -1 without."""
    near = np.arange(len(order)) - 1
    live = np.flatnonzero(near >= low)
    found = np.full(len(order), -1)
    found[live] = near[live]
    near = found
    while len(live):
        live = live[order[near[live]] > order[live]]
        near[live] = near[near[live]]
        live = live[near[live] >= 0]
    return near


def blocks(s: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest sequence that also begins earlier in its document, or one new word."""
    n, heads = s.n, s.names[0][s.order].astype(np.int64)
    tails = n - 1 - _heads(heads[::-1])[::-1]
    longest = np.zeros(n, np.int64)
    before = _earlier(s.order, heads)
    after = _earlier(s.order[::-1], n - 1 - tails[::-1])[::-1]
    after = np.where(after >= 0, n - 1 - after, -1)
    for other in (before, after):
        some = np.flatnonzero(other >= 0)
        if len(some):
            longest[s.order[some]] = np.maximum(longest[s.order[some]], s.ahead(s.order[some], s.order[other[some]]))
    steps, starts, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, np.int64)


def covering(s: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares that cover the leftmost one of each kind: those around the borders of blocks."""
    n, count = s.n, len(starts)
    own = np.repeat(np.arange(count), np.diff(np.append(starts, n)))
    bounds = np.append(starts, n)
    q, words = np.arange(n), s.symbols
    found = []

    def keep(border: np.ndarray, place: np.ndarray, latest: np.ndarray | None) -> None:
        """Squares with one half's end at the border and the other's at place; ``latest``: their first half ends before it."""
        same = words[border] == words[place]
        border, place = border[same], place[same]
        left, half = np.minimum(border, place), np.abs(border - place)
        onward, back = s.ahead(border, place), s.behind(border, place)
        start = np.maximum(left - back, left - half + 1)
        good = onward + back >= half
        if latest is not None:
            good &= start + half <= latest[same]
        found.append((start[good], half[good]))

    border = bounds[own + 1]
    inside = border < s.ends  # another block of the document follows
    keep(border[inside], q[inside], None)
    for back in (0, 1, 2):  # the border is the start of the place's block, of the block before, or of the one before that, for a block's first word
        ok = own >= back
        h = starts[np.maximum(own - back, 0)]
        ok &= (h < q) & (s.ends[h] == s.ends) & ((q == starts[own]) if back == 2 else True)
        keep(h[ok], q[ok], bounds[own[ok] - back + 1])
    start, half = (np.concatenate(c) for c in zip(*found))
    key = np.unique(start * (n + 1) + half)
    return key // (n + 1), key % (n + 1)


def primitive(s: Suffixes, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which squares have a half that is not itself a repetition."""
    lengths, inverse = np.unique(half, return_inverse=True)
    factors = [_primes(k) for k in lengths.tolist()]
    counts = np.array([len(f) for f in factors], np.int64)[inverse]
    row = np.repeat(np.arange(len(start)), counts)
    prime = np.array([p for k in inverse.tolist() for p in factors[k]], np.int64)
    step = half[row] // prime if len(row) else row
    ok = np.ones(len(start), bool)
    ok[row[s.ahead(start[row], start[row] + step) >= 2 * half[row] - step]] = False
    return ok


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def vocabulary(s: Suffixes, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every kind of primitive square, by suffix links from the given ones."""
    marked, kinds = set(), []
    words, ends, names = s.symbols, s.ends, s.names
    for i, k in zip(start.tolist(), half.tolist()):
        level = min((2 * k).bit_length() - 1, len(names) - 1)
        name, rest = names[level], 2 * k - (1 << level)
        while (mark := (int(name[i]), int(name[i + rest]), k)) not in marked:
            marked.add(mark)
            kinds.append((i, k))
            # the suffix link leads to the suffix behind the first word; that word has to come again
            if i + 2 * k < ends[i] and words[i + 2 * k] == words[i]:
                i += 1
            elif (i := s.onward(i + 1, 2 * k - 1, int(words[i]))) < 0:
                break
    found = np.array(kinds, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def runs(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of two or more periods, by start, then period; doc never falls."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    s = Suffixes(symbols, doc)
    start, half = covering(s, blocks(s))
    ok = primitive(s, start, half)
    start, half = vocabulary(s, start[ok], half[ok])
    if not len(start):
        return none, none, none
    lo, hi = s.below(start, 2 * half)
    sizes = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    places = np.sort(np.repeat(half, sizes) * (s.n + 1) + s.order[at])
    first = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
    last = np.append(first[1:], len(places)) - 1
    period, begin = places[first] // (s.n + 1), places[first] % (s.n + 1)
    length = places[last] - places[first] + 2 * period
    by = np.lexsort((period, begin))
    return begin[by], length[by], period[by]


def _collapsed(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sizes, at = np.zeros(batch.num_rows, np.int64), 0
            kept, found = [], []
            while at < batch.num_rows:
                held, first = [], at
                count = 0
                while at < batch.num_rows and (count < TOGETHER or not held):
                    words = (texts[at].as_py() or b"").split()  # splits at the six white space bytes of ASCII
                    if held and count + len(words) > TOGETHER:
                        break
                    held.append(words)
                    count += len(words)
                    at += 1
                sizes[first:at] = [len(w) for w in held]
                flat = [w for words in held for w in words]
                ids = dict.fromkeys(flat)
                ids.update(zip(ids, range(len(ids))))
                symbols = np.fromiter(map(ids.__getitem__, flat), np.int64, count)
                bounds = np.concatenate([[0], np.cumsum(sizes[first:at])])
                begin, length, period = runs(symbols, np.repeat(np.arange(at - first), sizes[first:at]))
                long = length >= np.maximum(least, times * period)
                begin, length, period = begin[long], length[long], period[long]
                owner = np.searchsorted(bounds, begin, "right") - 1
                gone = np.zeros(count + 1, np.int64)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, begin + length, -1)
                stays = np.cumsum(gone)[:count] == 0
                touched = set(owner.tolist())
                for d, words in enumerate(held):
                    kept.append(b" ".join([w for w, k in zip(words, stays[bounds[d] : bounds[d + 1]].tolist()) if k] if d in touched else words))
                found.append((owner + first, begin - bounds[owner], length, period))
            owner, *columns = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            items = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return run


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """Find runs of repeated words and keep the first period of each.

    A run is a stretch of words that equal those one period later, as long as it
    can be, with its smallest period q and at least ``least`` and ``times * q``
    words.  Returns doc_id, n_words, runs (start, length and period in words, by
    start, then period) and text (the words left, joined by one space: those in no
    run, or in each of their runs among its first q) for every row of docs.  A
    null text has no words; repeated rows are judged alike; other columns are left
    alone; an empty table gives no rows.

    Each document is judged by itself, so nothing is shuffled.
    """
    ship(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(_collapsed(least, times), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
