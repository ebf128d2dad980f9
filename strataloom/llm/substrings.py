"""Removal of repeated word sequences by suffix automata.

``remove_known`` is the method as such: a reference, cut into shards of bounded
size, becomes one suffix automaton a shard; each is broadcast, documents stream
past and their matching statistics (how many words up to here the reference also
has in a row) give the maximal spans at or above the length threshold.

``remove_repeats`` asks the same of a corpus against itself.  There the
reference grows with the corpus, and sending every shard to every document would
be a cross join, so shards are cut by content and documents go only where they
can match: each window of ``width`` words has an anchor, its k words of smallest
hash (the first of them on ties), so equal windows have equal anchors.  The
stretch of a document whose windows share an anchor is a segment.

1. Anchors found once in the whole corpus are left out; exact copies of texts
   are left out but for the first.
2. Equal segments are combined before they are shuffled, keeping the earliest.
3. The distinct segments of an anchor are one reference shard.  They stream past
   its automaton from the earliest to the latest, each being added after it was
   matched: windows without a match are first occurrences.
4. Anchors with more than HOT segments are not given a shard.  Their windows are
   combined one by one, which needs no more than a minimum over rows.

A window with a known anchor that is no first occurrence repeats an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.llm.jaccard import few
from strataloom.session import discard, durable, ship

WIDTH = 20
ANCHOR = 8
HOT = 512
#: Most digests of texts with copies (40 bytes each) that are broadcast.
BROADCAST_DIGESTS = 200_000
#: Words of one broadcast automaton (some 600 bytes each at most).
SHARD_WORDS = 100_000
LAST_ID = (1 << 63) - 1


class Automaton:
    """A suffix automaton of several word sequences; matches never run from one into the next."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _clone(self, p: int, q: int, w) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def matching(self, words: list) -> list[int]:
        """For each word, how many words that end with it stand in a row in a known sequence."""
        state = length = 0
        out = []
        next_, link, longest = self.next, self.link, self.length
        for w in words:
            while state and w not in next_[state]:
                state = link[state]
                length = longest[state]
            got = next_[state].get(w)
            if got is None:
                state = length = 0
            else:
                state, length = got, length + 1
            out.append(length)
        return out


def anchors(words: tokens.Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Segments of a run of documents: document, anchor hash, its first word, the segment's first word, windows in it."""
    k = min(ANCHOR, width)
    none = np.zeros(0, np.int64)
    gram, at = tokens.windows(hashes, words.first, k)
    start = np.flatnonzero(np.arange(len(hashes)) + width <= np.repeat(words.first[1:], words.counts())) if len(hashes) else none
    if not len(start):
        return none, np.zeros(0, np.uint64), none, none, none
    value = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    value[at] = gram
    place = np.arange(len(hashes))
    span, reach = width - k + 1, 1

    def best(v, p, by):  # the smaller of each and the one ``by`` further on, the first on ties
        v2, p2 = v[by:], p[by:]
        v, p = v[: len(v2)], p[: len(p2)]
        left = v <= v2
        return np.where(left, v, v2), np.where(left, p, p2)

    v, p = value, place
    while 2 * reach <= span:
        v, p = best(v, p, reach)
        reach *= 2
    if reach < span:
        v, p = best(v, p, span - reach)
    owner = p[start]
    doc = words.doc()[start]
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]))
    # 48 bits name an anchor: two that share them only share a shard
    return doc[cut], value[owner[cut]] >> np.uint64(16), owner[cut], start[cut], np.diff(np.append(cut, len(start)))


def spans(hashes: np.ndarray, base: int):
    """A function from (first, end) of words to hashes of the words between."""
    pw, inv = tokens.powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * pw[: len(hashes)], out=sums[1:])
    return lambda a, b: tokens.mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64))


_BASE, _OTHER = 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, words in tokens.slices(batch.column("text")):
                doc, anchor, at, _, _ = anchors(words, words.hashes(), width)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((at - words.first[doc]).astype(np.int32))], ["anchor", "doc", "at"])

    return run


def _marks(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The rows of a list<struct> column for documents lo..hi-1, with their document."""
    part = column.slice(lo, hi - lo)
    flat = part.flatten()
    sizes = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy().astype(np.int64)
    return np.repeat(np.arange(hi - lo), sizes), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _chosen(doc: np.ndarray, at: np.ndarray, mark_doc: np.ndarray, mark_at: np.ndarray) -> np.ndarray:
    """For each (doc, at) the place of the equal mark, or -1."""
    if not len(mark_doc):
        return np.full(len(doc), -1)
    key = (mark_doc << 32) | mark_at
    order = np.argsort(key, kind="stable")
    mine = (doc << 32) | at
    found = np.minimum(np.searchsorted(key[order], mine), len(key) - 1)
    return np.where(key[order][found] == mine, order[found], -1)


def _segments(width: int):
    names = ["hot", "anchor", "h1", "h2", "doc", "at", "off", "n", "words"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, words in tokens.slices(batch.column("text")):
                hashes = words.hashes()
                doc, anchor, at, first, n = anchors(words, hashes, width)
                mark_doc, mark = _marks(batch.column("marks"), lo, hi)
                found = _chosen(doc, at - words.first[doc], mark_doc, mark["at"].astype(np.int64))
                keep = found >= 0
                doc, anchor, at, first, n = (x[keep] for x in (doc, anchor, at, first, n))
                hot = mark["hot"][found[keep]].astype(bool) if keep.any() else np.zeros(0, bool)
                one, two = spans(hashes, _BASE), spans(hashes, _OTHER)
                end, off = first + n + width - 1, at - first
                c = ~hot
                data, begin, stop = words.data, words.start, words.end
                text = [data[begin[a] : stop[b - 1]].tobytes() for a, b in zip(first[c].tolist(), end[c].tolist())]
                salt = tokens.mix(off.astype(np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip((np.zeros(c.sum(), bool), anchor[c].view(np.int64), (one(first, end) ^ salt)[c].view(np.int64), two(first, end)[c].view(np.int64), ids[lo:hi][doc[c]], (at - words.first[doc])[c], off[c], n[c], text), kinds)], names
                )
                if hot.any():
                    window = np.repeat(first[hot], n[hot]) + _within(n[hot])
                    d, p = np.repeat(doc[hot], n[hot]), np.repeat(at[hot], n[hot])
                    m = len(window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip((np.ones(m, bool), np.repeat(anchor[hot], n[hot]).view(np.int64), one(window, window + width).view(np.int64), two(window, window + width).view(np.int64), ids[lo:hi][d], p - words.first[d], p - window, np.ones(m, np.int64), np.full(m, b"", object)), kinds)], names
                    )

    return run


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _firsts(width: int):
    """Rows sorted by anchor, document and place -> those with the windows (as bits) that nothing earlier has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton, waiting = None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("hot", "anchor", "h1", "doc", "at", "n", "words")]
            for hot, anchor, h1, doc, at, n, text in zip(*columns):
                mask = (1 << n) - 1
                if not hot:
                    if anchor != known:
                        known, automaton, waiting = anchor, None, text
                    else:
                        if automaton is None:  # most anchors have one segment and need none
                            automaton = Automaton()
                            automaton.add(waiting.split())
                        words = text.split()
                        for i, got in enumerate(automaton.matching(words)[width - 1 :]):
                            if got >= width:
                                mask &= ~(1 << i)
                        if mask:
                            automaton.add(words)
                if mask:
                    out.append((doc, at, hot, h1, mask))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], ["doc", "at", "hot", "h1", "first"])

    return run


def _strip(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, words in tokens.slices(batch.column("text")):
                hashes, total = words.hashes(), words.counts()
                gone = np.zeros(len(hashes) + 1, np.int64)
                doc, _, at, first, n = anchors(words, hashes, width)
                mark_doc, mark = _marks(batch.column("marks"), lo, hi)
                if len(mark_doc) and len(doc):
                    place = at - words.first[doc]
                    is_first = mark["first"] != 0
                    cand = _chosen(doc, place, mark_doc[~is_first], mark["at"][~is_first].astype(np.int64))
                    keep = cand >= 0
                    hot = mark["hot"][~is_first][cand[keep]].astype(bool)
                    doc, at, first, n, place = (x[keep] for x in (doc, at, first, n, place))
                    one = spans(hashes, _BASE)
                    salt = tokens.mix((at - first).astype(np.uint64) + np.uint64(1))
                    segment = (one(first, first + n + width - 1) ^ salt).view(np.int64)
                    # what is known to come first, by document, place and hash
                    who = {(d, p, h): int(m) for d, p, h, m in zip(mark_doc[is_first].tolist(), mark["at"][is_first].tolist(), mark["h1"][is_first].tolist(), mark["first"][is_first].tolist())}
                    window = np.repeat(first, n) + _within(n)
                    mine = np.array([who.get(k, 0) for k in zip(doc.tolist(), place.tolist(), segment.tolist())], np.int64)
                    new = (np.repeat(mine, n) >> _within(n)) & 1
                    is_hot = np.repeat(hot, n)
                    if hot.any():
                        keys = one(window[is_hot], window[is_hot] + width).view(np.int64)
                        new[is_hot] = [(d, p, h) in who for d, p, h in zip(np.repeat(doc, n)[is_hot].tolist(), np.repeat(place, n)[is_hot].tolist(), keys.tolist())]
                    again = window[new == 0]
                    np.add.at(gone, again, 1)
                    np.add.at(gone, again + width, -1)
                removed = np.cumsum(gone[:-1]) > 0
                whole = copies[lo:hi] & (total >= width)
                removed |= np.repeat(whole, total)
                lost = np.bincount(words.doc()[removed], minlength=hi - lo)
                kept = _joined(words, removed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(total), pa.array(lost.astype(np.int64)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _joined(words: tokens.Words, removed: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, as one string a document, without a loop over words."""
    m = len(words.first) - 1
    stay = ~removed
    doc = words.doc()[stay]
    start, size = words.start[stay], (words.end - words.start)[stay]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    width = size + ~last  # a space after each word but the last
    take = np.repeat(start, width) + _within(width)
    data = words.data[np.minimum(take, len(words.data) - 1)] if len(take) else np.zeros(0, np.uint8)
    ends = np.cumsum(width)
    spaces = ends[~last] - 1
    data[spaces] = 32
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, width, m).astype(np.int64))])
    return pa.Array.from_buffers(pa.large_string(), m, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Remove every word in a window of ``width`` words that also starts earlier in docs (doc_id, text).

    Earlier means a smaller doc_id, or an earlier start in the same document;
    windows are judged on the input.  Returns doc_id, n_words, n_removed and kept,
    the words left, joined by one space.  A null text has no words; rows without
    a doc_id come after all others; rows that repeat a doc_id are one document
    whose starts are counted in each row, so a repeated row does not lose what
    the other has at the same place; an empty table gives no rows; other columns
    are not used.
    """
    ship(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    plain = docs.select(F.col("doc_id").cast("long"), doc.alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    # copies of whole texts: rows whose doc_id is theirs alone and not the smallest that has the text
    thin = durable(plain.select("doc", F.md5("text").alias("digest")), "digests")
    smallest = durable(thin.groupBy("digest").agg(F.min("doc").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n"), "smallest")
    alone = thin.groupBy("doc").agg(F.count("*").alias("n"), F.min("digest").alias("digest")).filter("n = 1").drop("n")
    copies = durable(alone.join(few(smallest, BROADCAST_DIGESTS), "digest").filter("doc > low").select("doc"), "copies")

    found = durable(plain.select("doc", "text").mapInArrow(_anchors(width), "anchor long, doc long, at int"), "anchors")
    # written apart, so that the join deals both sides by itself and can split a common anchor
    counts = durable(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    again = found.join(counts, "anchor").select("doc", "at", (F.col("n") > HOT).alias("hot")).join(copies, "doc", "left_anti")
    marks = durable(again.groupBy("doc").agg(F.collect_set(F.struct("at", "hot")).alias("marks")), "marks")
    discard(thin, found, counts)

    schema = "hot boolean, anchor long, h1 long, h2 long, doc long, at int, off int, n int, words binary"
    segments = plain.select("doc", "text").join(marks, "doc").select("doc", "text", "marks").mapInArrow(_segments(width), schema)
    place = F.struct("doc", "at", "off", "n", "words")
    distinct = segments.groupBy("hot", "anchor", "h1", "h2").agg(F.min(place).alias("p"))
    distinct = durable(distinct.select("hot", "anchor", "h1", "p.*"), "segments")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # windows of hot anchors need no shard: the earliest is first
    hot = distinct.filter("hot").select("doc", "at", "hot", "h1", F.lit(1).cast("long").alias("first"))
    sharded = distinct.filter("not hot").repartition(count, "anchor").sortWithinPartitions("anchor", "doc", "at")
    firsts = sharded.select("hot", "anchor", "h1", "doc", "at", "n", "words").mapInArrow(_firsts(width), "doc long, at int, hot boolean, h1 long, first long")
    mark = F.struct("at", "hot", "h1", "first")
    known = marks.select("doc", F.explode("marks").alias("m")).select("doc", "m.at", "m.hot", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("first"))
    info = durable(firsts.unionByName(hot).unionByName(known).groupBy("doc").agg(F.collect_set(mark).alias("marks")), "firsts")
    discard(marks, distinct)
    info = info.select("doc", "marks", F.lit(False).alias("copy")).unionByName(copies.select("doc", F.array().cast(info.schema["marks"].dataType).alias("marks"), F.lit(True).alias("copy")))
    whole = plain.join(info, "doc", "left").select("doc_id", "text", "marks", F.coalesce("copy", F.lit(False)).alias("copy"))
    return whole.mapInArrow(_strip(width), "doc_id long, n_words long, n_removed long, kept string")


def shards(reference: DataFrame, words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of the texts of a reference, each over about ``words`` words; read text by text."""
    automaton, size = Automaton(), 0
    for row in reference.filter(F.col("text").isNotNull()).select("text").toLocalIterator(prefetchPartitions=True):
        got = row["text"].encode().split()
        automaton.add(got)
        size += len(got)
        if size >= words:
            yield automaton
            automaton, size = Automaton(), 0
    if size:
        yield automaton


def remove_known(docs: DataFrame, reference: DataFrame, width: int = WIDTH, words: int = SHARD_WORDS) -> DataFrame:
    """Remove the words of docs in runs of ``width`` or more that stand in a row in a text of the reference.

    The reference is a stated set of texts that does not grow with docs, such as
    a benchmark; all its shards meet all documents in one pass.  Returns doc_id,
    n_words, n_removed and kept.  Null texts have no words; an empty reference
    removes nothing; an empty table gives no rows; repeated rows and null doc_ids
    stay; other columns are not used.
    """
    ship(docs.sparkSession)
    held = [docs.sparkSession.sparkContext.broadcast(a) for a in shards(reference, words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                got = (text.as_py() or "").encode().split()
                gone = np.zeros(len(got) + 1, int)
                for automaton in held:
                    for end, n in enumerate(automaton.value.matching(got)):
                        if n >= width:
                            gone[end - n + 1] += 1
                            gone[end + 1] -= 1
                out = np.cumsum(gone[:-1]) > 0
                rows.append((len(got), int(out.sum()), b" ".join(w for w, x in zip(got, out) if not x).decode()))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
