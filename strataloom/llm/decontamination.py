"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

For every length in words that benchmark items have, a document is looked at
through windows of that length.  A window gets a SimHash of its weighted word
shingles.  Fingerprints of BITS bits are indexed in BLOCKS blocks: if two differ
in at most RADIUS bits, some block differs in at most FLIPS, so looking up each
block of a window with up to FLIPS bits changed finds every item within the
radius.  A part of the flips is stored with the items, the rest is probed.
Items found are verified by the exact weighted Jaccard similarity of the shingle
multisets, with weights counted over the whole benchmark.

Which items a window is held against is for the fingerprints to say.  One exact
bound goes before them and names no item: a window has to hold as much weight in
shingles of the benchmark, whichever item they are of, as ``similarity`` times
the lightest item of its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.session import durable, ship

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 two fingerprints of 128 bits differ in 19.4 bits on average; 31 is 2.9 deviations above.
BITS, BLOCKS, FLIPS = 128, 8, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Flips of a block that are stored with the items.
STORED = 2
#: Bytes of item texts in one broadcast index; a larger benchmark is taken in blocks of that size.
INDEX_BYTES = 4 << 20
#: Shingles whose fingerprint sums, and windows whose candidates, are in memory at once.
PIECE, PROBES = 1 << 15, 1 << 13
#: Weights are whole multiples of 1 / GRAIN in fingerprints, so that sums are exact.
GRAIN = 256


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes of one text; of all its words together where there are fewer than SHINGLE."""
    n = len(hashes)
    if not n:
        return hashes
    return tokens.windows(hashes, np.array([0, n]), min(SHINGLE, n))[0]


def sums(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums, from 0, of each bit's weighted signs."""
    halves = [tokens.mix(values ^ np.uint64(salt)) for salt in (0x5BD1E995, 0x27D4EB2F165667C5)]
    bits = np.unpackbits(np.stack(halves, axis=1).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    out = np.zeros((len(values) + 1, BITS), np.int32)
    np.cumsum((bits.astype(np.int32) * 2 - 1) * np.rint(weight * GRAIN).astype(np.int32)[:, None], axis=0, out=out[1:])
    return out


def prints_of(total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS numbers."""
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint16).reshape(-1, BLOCKS)


def flips(most: int) -> np.ndarray:
    """All numbers of one block's bits with at most so many bits set."""
    n = BITS // BLOCKS
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(n), k)], np.uint16)


def weighted_jaccard(a: Counter, b: Counter, weight) -> float:
    low = sum(weight(x) * min(n, b[x]) for x, n in a.items() if x in b)
    high = sum(weight(x) * n for x, n in a.items()) + sum(weight(x) * n for x, n in b.items()) - low
    return low / high if high else 0.0


@dataclass
class Item:
    """An item's distinct shingles, sorted, how often it has each, their weights, and their sum; ``also``: more ids of its text."""

    id: int
    n_words: int
    shingle: np.ndarray
    count: np.ndarray
    weight: np.ndarray
    total: float
    also: tuple[int, ...] = ()

    @classmethod
    def of(cls, id_, n_words: int, bag: dict[int, int], weights: dict[int, float], also: tuple[int, ...] = ()) -> "Item":
        known = sorted(bag)
        count, weight = np.array([bag[s] for s in known]), np.array([weights.get(s, 1.0) for s in known])
        return cls(id_, n_words, np.array(known, np.uint64), count, weight, float((count * weight).sum()), also)

    def similarity(self, window: np.ndarray, weight: np.ndarray) -> float:
        """Weighted Jaccard similarity with a window of shingles of these weights."""
        at = np.minimum(np.searchsorted(self.shingle, window), len(self.shingle) - 1)
        have = np.bincount(at[self.shingle[at] == window], minlength=len(self.shingle))
        low = float((np.minimum(have, self.count) * self.weight).sum())
        return low / (float(weight.sum()) + self.total - low)


class Blocks:
    """The multi-index over the fingerprints of some items."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables = []
        for b in range(BLOCKS):
            key = (prints[:, b][:, None] ^ flips(STORED)).ravel()
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order // len(flips(STORED))))

    def within(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of wanted, item, distance) of all pairs within the radius, sorted."""
        n, probes = len(self.prints), flips(FLIPS - STORED)
        found = [np.zeros(0, np.int64)]
        for b, (key, item) in enumerate(self.tables):
            probe = (wanted[:, b][:, None] ^ probes).ravel()
            lo = np.searchsorted(key, probe)
            size = np.searchsorted(key, probe, "right") - lo
            hit = np.flatnonzero(size)
            place = np.repeat(lo[hit], size[hit]) + np.arange(size[hit].sum()) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])
            found.append(np.unique(np.repeat(hit // len(probes), size[hit]) * n + item[place]))
        row, item = np.divmod(np.unique(np.concatenate(found)), n)
        distance = np.bitwise_count(wanted[row] ^ self.prints[item]).sum(axis=1)
        near = distance <= RADIUS
        return row[near], item[near], distance[near]


@dataclass
class Index:
    """Items of one block of the benchmark."""

    items: list[Item]
    prints: list[int]
    shingle: np.ndarray
    weight: np.ndarray
    lengths: dict[int, tuple[np.ndarray, Blocks, float]]  # items of a length in words, and the least weight of one

    @classmethod
    def of(cls, items: list[tuple], weights: dict[int, float]) -> "Index":
        """items are (id, text)."""
        made = []
        for id_, text in items:
            data = text.encode()
            got = tokens.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), True)
            bag = Counter(shingles(got.hashes()).tolist())
            if bag:
                made.append(Item.of(id_, len(got.start), bag, weights))
        return cls.build(made)

    @classmethod
    def build(cls, items: list[Item]) -> "Index":
        every = np.concatenate([np.zeros(0, np.uint64), *(i.shingle for i in items)])
        shingle, first = np.unique(every, return_index=True)
        weight = np.concatenate([np.zeros(0), *(i.weight for i in items)])[first]
        totals = [sums(np.repeat(i.shingle, i.count), np.repeat(i.weight, i.count))[-1] for i in items]
        prints = prints_of(np.array(totals).reshape(-1, BITS))
        lengths = {}
        for n in sorted({i.n_words for i in items}):
            at = np.array([j for j, i in enumerate(items) if i.n_words == n])
            lengths[n] = (at, Blocks(prints[at]), min(items[j].total for j in at))
        return cls(items, [int.from_bytes(p.tobytes(), "little") for p in prints], shingle, weight, lengths)

    def near(self, print_: int) -> list[tuple[int, int]]:
        """(distance, item) of all items within the radius, nearest first."""
        row = np.frombuffer(print_.to_bytes(BITS // 8, "little"), np.uint16)[None]
        found = []
        for at, blocks, _ in self.lengths.values():
            _, item, distance = blocks.within(row)
            found += zip(distance.tolist(), at[item].tolist())
        return sorted(found)

    def weigh(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each shingle whether an item has it, and its weight."""
        if not len(self.shingle) or not len(values):
            return np.zeros(len(values), bool), np.ones(len(values))
        at = np.minimum(np.searchsorted(self.shingle, values), len(self.shingle) - 1)
        hit = self.shingle[at] == values
        return hit, np.where(hit, self.weight[at], 1.0)


def match(values: np.ndarray, first: np.ndarray, n_words: np.ndarray, index: Index, similarity: float, k: int = SHINGLE) -> list[tuple]:
    """(document, item, first word, words, similarity, distance) of the best window of each item that a document leaks.

    Document d has n_words[d] words and the shingles values[first[d]:first[d+1]],
    of k words each: SHINGLE for items of as many and more words, or else the
    words of an item, which is one shingle then.
    """
    lengths = {n: held for n, held in index.lengths.items() if min(n, SHINGLE) == k}
    if not lengths:
        return []
    hit, weight = index.weigh(values)
    mass = np.concatenate([[0.0], np.cumsum(np.where(hit, weight, 0.0))])
    least = similarity * min(low for _, _, low in lengths.values()) - 1e-9
    alive = np.flatnonzero((mass[first[1:]] - mass[first[:-1]] >= least) & (first[1:] > first[:-1]))
    if not len(alive):
        return []
    doc = np.repeat(alive, np.diff(first)[alive])
    place = np.concatenate([np.arange(first[d], first[d + 1]) for d in alive.tolist()])
    longest = max(lengths)
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(place), PIECE):
        start, of = place[lo : lo + PIECE], doc[lo : lo + PIECE]
        upto = min(len(place), lo + PIECE + longest)
        total = sums(values[place[lo:upto]], weight[place[lo:upto]])
        room = first[of + 1] - start  # shingles from here to the end of the document
        for n, (at, blocks, low) in lengths.items():
            span = np.minimum(n, n_words[of])
            wide = np.maximum(1, span - k + 1)
            fits = np.flatnonzero(wide <= room)
            heavy = mass[start[fits] + wide[fits]] - mass[start[fits]] >= similarity * low - 1e-9
            rows = fits[heavy]
            for some in np.split(rows, range(PROBES, len(rows), PROBES)):
                prints = prints_of(total[some + wide[some]] - total[some])
                for w, i, distance in zip(*(x.tolist() for x in blocks.within(prints))):
                    s, e = int(start[some[w]]), int(start[some[w]] + wide[some[w]])
                    item = index.items[int(at[i])]
                    got = item.similarity(values[s:e], weight[s:e])
                    d = int(of[some[w]])
                    for key in ((d, id_) for id_ in (item.id, *item.also)) if got >= similarity - 1e-9 else ():
                        if key not in best or got > best[key][4] + 1e-12:
                            best[key] = (*key, s - int(first[d]), int(span[some[w]]), got, distance)
    return [best[k] for k in sorted(best)]


def _search(index: Callable[[], Index], similarity: float, short_items: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index()
        widths = sorted({min(n, SHINGLE) for n in known.lengths})
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, words in tokens.slices(batch.column("text"), True):
                hashes, n = words.hashes(), words.counts()
                for k in widths:
                    values, at = tokens.windows(hashes, words.first, k)
                    if k < SHINGLE and not short_items:
                        whole = np.repeat(n == k, n)[at]
                        values, at = values[whole], at[whole]
                    first = np.searchsorted(at, words.first)
                    rows += [(ids[lo + d], *m) for d, *m in match(values, first, n, known, similarity, k)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

    return run


LEAKS = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (item_id, name, text) -> their shingles: item_id, name, n_words, size of the text, shingle, count."""
    for batch in batches:
        out = []
        for id_, name, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "name", "text"))):
            data = text.encode()
            got = tokens.scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]), True)
            value, count = np.unique(shingles(got.hashes()), return_counts=True)
            out += [(id_, name, len(got.start), len(data), v, c) for v, c in zip(value.view(np.int64).tolist(), count.tolist())]
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "name", "n_words", "size", "shingle", "count"])


def _texts(benchmark: DataFrame) -> DataFrame:
    """Distinct texts with the ids that have them, the smallest first, and a digest as their name."""
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("long")))
    return benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).groupBy("text").agg(ids.alias("ids")).withColumn("name", F.sha2("text", 256))


def blocks_of(benchmark: DataFrame, every_id: bool = False) -> list[Index]:
    """Indexes over all items, each over at most INDEX_BYTES of text (or the texts of one item_id).

    Shingles weigh by how few items of the whole benchmark have them, so what is
    found does not depend on the cut.  Items without a word find nothing; equal
    texts are one item, named by the smallest item_id or with ``every_id`` by all;
    different texts are items of their own, also under one item_id.
    """
    ship(benchmark.sparkSession)
    texts = _texts(benchmark).withColumn("item_id", F.col("ids")[0])
    bags = durable(texts.select("item_id", "name", "text").mapInArrow(_bags, "item_id long, name string, n_words long, size long, shingle long, count long"), "bags")
    n = bags.select("name").distinct().count()
    frequency = bags.groupBy("shingle").agg(F.count("*").alias("items"))
    weight = F.log1p(F.lit(n) / F.col("items")) / F.log1p(F.lit(float(n)))
    rows = bags.join(frequency, "shingle").groupBy("item_id", "name", "n_words", "size").agg(F.sort_array(F.collect_list(F.struct("shingle", "count", weight.alias("weight")))).alias("bag"))
    rows = rows.join(texts.select("name", "ids"), "name")
    held, size, out = [], 0, []
    for r in rows.orderBy("item_id", "name").toLocalIterator(prefetchPartitions=True):
        if size >= INDEX_BYTES and r["item_id"] != held[-1].id:
            out.append(Index.build(held))
            held, size = [], 0
        bag = {x["shingle"] & (1 << 64) - 1: x for x in r["bag"]}
        held.append(Item.of(r["item_id"], r["n_words"], {s: x["count"] for s, x in bag.items()}, {s: x["weight"] for s, x in bag.items()}, tuple(r["ids"][1:]) if every_id else ()))
        size += r["size"]
    if held:
        out.append(Index.build(held))
    return out


def _sent(spark, index: Index) -> Callable[[], Index]:
    shared = spark.sparkContext.broadcast(index)
    return lambda: shared.value


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, every_id: bool = False, short_items: bool = False) -> DataFrame:
    """One row per document and benchmark item it leaks: the best window.

    docs has doc_id and text, benchmark item_id and text.  Words are compared in
    lower case (A-Z).  Null texts and items, and items without an item_id, leak
    nothing; items with equal texts are reported as the one of smallest item_id,
    or each with ``every_id``; different texts of one item_id are all looked for,
    and the best window of any is reported (of each block of the benchmark, should
    they lie in two); a repeated row of docs gives its rows again; a null doc_id
    stays null; empty tables give no rows; other columns are not used.  An item of
    fewer than SHINGLE words is one shingle: it is found in texts that are these
    words, and with ``short_items`` in all that have them in a row.  The benchmark
    is a stated set of queries: it is broadcast in blocks of bounded size, and
    every block meets all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for index in blocks_of(benchmark, every_id):
        part = plain.mapInArrow(_search(_sent(spark, index), similarity, short_items), LEAKS)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], LEAKS) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, short_items: bool = False) -> DataFrame:
    """docs without the documents that leak an item, in one pass over the texts; all columns stay."""
    ship(docs.sparkSession)
    kept = docs
    for index in blocks_of(benchmark):
        kept = kept.mapInArrow(_drop(_sent(docs.sparkSession, index), similarity, short_items), docs.schema)
    return kept


def _drop(index: Callable[[], Index], similarity: float, short_items: bool):
    search = _search(index, similarity, short_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows, dtype=np.int64))
            numbered = pa.RecordBatch.from_arrays([place, batch.column("text")], ["doc_id", "text"])
            bad = np.unique(np.concatenate([b.column("doc_id").to_numpy() for b in search(iter([numbered]))]))
            yield batch.filter(pa.array(~np.isin(np.arange(batch.num_rows), bad)))

    return run
