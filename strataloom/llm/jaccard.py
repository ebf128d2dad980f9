"""Exact similarity join of word-shingle sets.

The sets that link share a shingle among the first of each, in any fixed order
of all shingles, so only those few are indexed.  The order is by hash, with
shingles that very many sets start with put last; lists of the index then stay
short, whatever passages the texts share.  Each entry of a list knows its set's
size and its place in it, and lists are kept in order of size:

* a long list is kept in blocks by place, in order of size: what a block's place
  and the probing set's own leave to share bounds the sizes that can link, and a
  block without such sizes is skipped as a whole;
* pairs are counted over lists, and what is left of each set bounds the overlap
  that a count allows, so hardly a pair that does not link gets further;
* answers are derived from those of highly similar sets: equal sets are one set;
  sets first meet only the most central set of each long list, and their exact
  distances to it then bound their distances to each other, which settles most
  pairs without their texts; pairs connected by then are not looked at again.

What remains is verified on the sets themselves, made anew from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import tokens
from strataloom.llm.components import components
from strataloom.llm.exprs import fresh
from strataloom.session import discard, durable, scope, ship

#: Lists of at most so many entries are paired within themselves; longer ones meet their centre first.
SHORT = 32
#: Most shingles that are put last in the order (8 bytes each in a broadcast), those in the most lists.
LAST = 200_000
#: Most ids (8 bytes each) that are broadcast to leave texts out early.
BROADCAST_IDS = 1_000_000
#: Entries of a long list that one task pairs with as many others.
BLOCK = 512
#: Places of one block of a long list.
PLACES = 8
#: Partitions over which the entries of a shingle put last are dealt.
SALTS = 64
#: Sets that one task compares with one and the same other set.
SATELLITES = 256


def sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, shingle, bounds): distinct k-word shingles of each document, sorted; lower case.

    A text of fewer than k words has its whole sequence as its one shingle.
    """
    for lo, hi, words in tokens.slices(column, True):
        hashes, n = words.hashes(), words.counts()
        value, at = tokens.windows(hashes, words.first, k)
        first = np.searchsorted(at, words.first)
        for few in range(1, k):
            short = np.flatnonzero(n == few)
            if len(short):
                got = np.zeros(len(short), np.uint64)
                for j in range(few):
                    got = (got ^ hashes[words.first[short] + j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(few)
                value = np.insert(value, first[short], tokens.mix(got))
                more = np.zeros(len(n) + 1, np.int64)
                more[short + 1] = 1
                first = first + np.cumsum(more)
        yield lo, hi, *tokens.sorted_sets(value, first)


def heads(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of size n any set with enough overlap must share one of."""
    return n - -(-percent * n // 100) + 1


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each value and its place there."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc, np.arange(first[-1]) - first[doc]


def _sets(k: int, percent: int):
    """doc_id -> size, two fingerprints of the set, and somewhat more than its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, value, first in sets(batch.column("text"), k):
                m, n = hi - lo, np.diff(first)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
                odd = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
                f1, f2 = (s[first[1:]] - s[first[:-1]] for s in (sums, odd))
                most = wide(n, percent)
                doc, at = _places(first)
                ends = np.concatenate([[0], np.cumsum(most)])
                head = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(brief(value[at < most[doc]])))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, m), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), head], ["doc_id", "n", "f1", "f2", "head"])

    return run


def _sized(k: int):
    """doc_id and text with size and fingerprints of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _sets(k, 50)(iter([batch])):
                at = got.num_rows
                yield pa.RecordBatch.from_arrays([got.column("doc_id"), batch.column("text").slice(0, at), *(got.column(c) for c in ("n", "f1", "f2"))], ["doc_id", "text", "n", "f1", "f2"])
                batch = batch.slice(at)

    return run


def wide(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles are counted to see which very many sets start with: a quarter more."""
    return np.minimum(n, (heads(n, percent) * 5 + 3) // 4)


def brief(value: np.ndarray) -> np.ndarray:
    """The first 40 bits, by which shingles are counted: a shared beginning only puts a shingle last needlessly."""
    return (value >> np.uint64(24)).view(np.int64)


def _among(value: np.ndarray, last: np.ndarray) -> np.ndarray:
    if not len(last):
        return np.zeros(len(value), bool)
    short = brief(value)
    return last[np.minimum(np.searchsorted(last, short), len(last) - 1)] == short


def _deeper(k: int, percent: int, last: np.ndarray):
    """All shingles of the texts that would start with shingles put last in a quarter of their places.

    With those gone to the end of the order, other shingles of the same
    widespread texts come first, which have not been counted yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, value, first in sets(batch.column("text"), k):
                doc, at = _places(first)
                most = wide(np.diff(first), percent)
                head = at < most[doc]
                found = np.bincount(doc[head][_among(value[head], last)], minlength=len(most))
                take = (4 * found >= most)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(brief(value[take]))], ["token"])

    return run


def _entries(k: int, percent: int, last: np.ndarray):
    """(token, doc_id, code, late) of the first shingles, in the order with ``last`` (sorted) at the end.

    code is the size of the set and, in its lower 32 bits, the place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, value, first in sets(batch.column("text"), k):
                n = np.diff(first)
                doc, at = _places(first)
                end = _among(value, last)
                if len(last):
                    before = np.concatenate([[0], np.cumsum(end)])  # shingles put last so far
                    mine = before[:-1] - before[first[:-1]][doc]
                    ahead = (n - (before[first[1:]] - before[first[:-1]]))[doc]
                    at = np.where(end, ahead + mine, at - mine)
                take = at < heads(n, percent)[doc]
                doc = doc[take]
                code = (n[doc].astype(np.int64) << 32) | at[take]
                yield pa.RecordBatch.from_arrays([pa.array(value[take].view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(code), pa.array(end[take])], ["token", "doc_id", "code", "late"])

    return run


def possible(n1, at1, n2, at2, percent: int):
    """Whether sets whose first common shingle is at these places can overlap enough; columns or arrays.

    Nothing before it is common, so the overlap is at most 1 and what is left
    after it, and enough is percent * union.  Two sets meet in the list of each
    shingle they share; a later one leaves less, so a pair passes in some list
    just if it passes in that of its first.
    """
    low = F.least if isinstance(n1, Column) else np.minimum
    return (100 + percent) * (low(n1 - at1, n2 - at2)) >= percent * (n1 + n2)


def _lists(percent: int):
    """Entries sorted by token and size -> pairs of short lists (kind 0) and the entries of others (kind 1).

    A pair is (a, b, size of a, size of b, whether the places allow a link), an entry (token, doc_id, code).
    At most SHORT entries of a list are held: from then on they go out as they come.
    """

    def give(kind: int, *columns) -> pa.RecordBatch:
        n = len(columns[0])
        full = [pa.array(np.asarray(c).astype(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full, *[pa.nulls(n, pa.int64())] * (5 - len(full))], ["kind", "p", "q", "r", "s", "t"])

    def pairs(token, doc, code) -> Iterator[pa.RecordBatch]:
        n, at = code >> 32, code & 0xFFFFFFFF
        for by in range(1, SHORT):  # the entries ``by`` further on in the same list
            i = np.flatnonzero(token[by:] == token[:-by])
            if not len(i):
                return
            j = i + by
            near = (n[j] * percent <= n[i] * 100) & (doc[i] != doc[j])
            i, j = i[near], j[near]
            ok = possible(n[i], at[i], n[j], at[j], percent)
            swap = doc[i] > doc[j]
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            yield give(0, doc[x], doc[y], n[x], n[y], ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        endless = None  # the token of a list that is known to be long
        for batch in batches:
            late = batch.column("late").to_numpy(zero_copy_only=False).astype(bool)
            rows = [batch.column(c).to_numpy() for c in ("token", "doc_id", "code")]
            if late.any():
                yield give(1, *(x[late] for x in rows))
            token, doc, code = (np.concatenate([h, x[~late]]) for h, x in zip(held, rows))
            if not len(token):
                continue
            cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(cut, len(token)))
            long = size > SHORT
            if endless is not None and token[0] == endless:
                long[0] = True
            endless = token[-1] if long[-1] else None
            long = np.repeat(long, size)
            if long.any():
                yield give(1, token[long], doc[long], code[long])
            wait = np.zeros(len(token), bool)
            if endless is None:
                wait[cut[-1] :] = True
            held = [token[wait], doc[wait], code[wait]]
            done = ~long & ~wait
            yield from pairs(token[done], doc[done], code[done])
        yield from pairs(*held)

    return run


def _across(percent: int):
    """Pairs (a, b, sure) of long lists; rows come sorted by list, with the distance to the list's centre (or -1).

    The list is in blocks by place and in order of size in each, so the sizes
    that can link with a set are one range of a block, and often none.  Two sets
    at distances d and e from the same set are |d - e| to d + e apart, which
    leaves pairs out, or in (``sure``), without a look at them.
    """
    names = ["token", "n", "at", "doc_id", "component", "side", "d"]

    def walk(n, at, doc, comp, side, d) -> Iterator[tuple[np.ndarray, ...]]:
        block = at // PLACES
        order = np.lexsort((doc, n, block))
        n, at, doc, comp, side, d, block = (x[order] for x in (n, at, doc, comp, side, d, block))
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ranges = list(zip(first.tolist(), np.append(first[1:], len(n)).tolist(), (block[first] * PLACES).tolist()))
        for i in range(len(n)):
            most = ((100 + percent) * (n[i] - at[i]) - percent * n[i]) // percent
            found = []
            for lo, hi, place in ranges:
                if hi <= i + 1:
                    continue
                lo = max(lo, i + 1)
                least = -(-(percent * n[i] + (100 + percent) * place) // 100)
                if n[hi - 1] < least or n[lo] > most:
                    continue  # no size of this block leaves enough
                found.append(np.arange(lo + np.searchsorted(n[lo:hi], least), lo + np.searchsorted(n[lo:hi], most, "right")))
            if not found:
                continue
            j = np.concatenate(found)
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0)) & (doc[j] != doc[i])]
            j = j[possible(n[i], at[i], n[j], at[j], percent)]
            both, known = n[i] + n[j], (d[j] >= 0) & (d[i] >= 0)
            enough = 2 * percent * both
            far = known & ((100 + percent) * (both - np.abs(d[j] - d[i])) < enough)
            sure = known & ((100 + percent) * (both - d[j] - d[i]) >= enough)
            if not far.all():
                j, sure = j[~far], sure[~far]
                yield np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), sure

    def give(pairs: list) -> pa.RecordBatch:
        a, b, sure = (np.concatenate(x) for x in zip(*pairs))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], ["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * len(names)
        pairs, held = [], 0

        def lists(rows, final: bool):
            cut = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]])) if len(rows[0]) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(rows[0]))
            yield from zip(cut[: len(cut) if final else -1].tolist(), ends.tolist())

        def through(rows, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pairs, held
            for lo, hi in lists(rows, final):
                for got in walk(*(x[lo:hi] for x in rows[1:])):
                    pairs.append(got)
                    held += len(got[0])
                    if held > 200_000:
                        yield give(pairs)
                        pairs, held = [], 0

        for batch in batches:
            rows = [np.concatenate([k, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, names)]
            yield from through(rows, False)
            cut = np.flatnonzero(rows[0][1:] != rows[0][:-1])
            kept = [x[cut[-1] + 1 if len(cut) else 0 :] for x in rows]
        yield from through(kept, True)
        if pairs:
            yield give(pairs)

    return run


def _compare(k: int):
    """Rows of stars (hub, part, role 0 for the hub itself, node, text), sorted -> (a, b, n_a, n_b, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star = hub = None  # the star at hand and its hub's set
        last = None  # (node, set) of the set that waits for other rows of its id

        def settle(out: list) -> None:
            if last is not None and hub is not None:
                merged = np.concatenate([hub, last[1]])
                merged.sort()
                shared = int((merged[1:] == merged[:-1]).sum())
                a, b = (star[0], len(hub)), (last[0], len(last[1]))
                (a, n_a), (b, n_b) = sorted((a, b))
                out.append((a, b, n_a, n_b, shared))

        def give(out: list) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n_a", "n_b", "shared"])

        for batch in batches:
            out: list = []
            keys = [batch.column(c).to_pylist() for c in ("hub", "part", "role", "node")]
            for lo, _, value, first in sets(batch.column("text"), k):
                for i in range(len(first) - 1):
                    h, part, role, node = (c[lo + i] for c in keys)
                    mine = value[first[i] : first[i + 1]]
                    if (h, part) != star:
                        settle(out)
                        star, hub, last = (h, part), None, None
                    if role == 0:  # of rows that repeat an id the one with the most shingles stands for it
                        hub = mine if hub is None or len(mine) > len(hub) else hub
                    elif last is not None and last[0] == node:
                        last = (node, mine) if len(mine) > len(last[1]) else last
                    else:
                        settle(out)
                        last = (node, mine)
                hub, last = None if hub is None else hub.copy(), None if last is None else (last[0], last[1].copy())
            yield give(out)
        out = []
        settle(out)
        yield give(out)

    return run


def few(ids: DataFrame, most: int | None = None) -> DataFrame:
    """ids, written before, to be broadcast if they are few enough, and joined by a shuffle if not."""
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids


def overlaps(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, n_a, n_b, shared) of pairs (a, b), written before; texts has node and text.

    A pair belongs to the end that is in more pairs, so a text that very many
    others are compared with travels once for SATELLITES of them and not once
    for each.  Texts in no pair do not move where the pairs are few enough to be
    broadcast.
    """
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    degree = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg")), "degrees")
    of = lambda s: few(degree).withColumnsRenamed({"node": s, "deg": f"deg_{s}"})
    by_a = F.col("deg_a") >= F.col("deg_b")
    star = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("deg_a", "deg_b").alias("deg"))
    star = star.select("hub", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("deg") / SATELLITES)).cast("int").alias("part"))
    needs = star.select("hub", "part", F.lit(1).alias("role"), "node").unionByName(star.select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("node")).distinct())
    needs = durable(needs, "needs")
    rows = texts.join(few(needs), "node").select("hub", "part", "role", "node", "text")
    dealt = rows.repartition(count, "hub", "part").sortWithinPartitions("hub", "part", "role", "node")
    return dealt.mapInArrow(_compare(k), "a long, b long, n_a long, n_b long, shared long")


def linked(got: DataFrame, percent: int) -> DataFrame:
    return got.filter((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents under links of Jaccard similarity percent / 100 or more.

    docs has doc_id and text.  Returns one row per row of docs: doc_id,
    n_shingles and component_id, the smallest doc_id that links reach.  Words are
    compared in lower case (A-Z).  A text without words, or a null one, has an
    empty set and links with nothing; rows without a doc_id come back with a null
    component_id and take no part; rows that repeat a doc_id are joined as one
    document if their sets are the same, and else the one with the most shingles
    stands for the id in links; an empty table gives no rows; other columns are
    not used.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    with scope() as end:
        found, groups = _components(docs.select(F.col("doc_id").cast("long"), "text"), k, percent)
        end(found, groups)
    got = found.select("doc_id", F.col("n").alias("n_shingles")).join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return got.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _one_each(plain: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """plain with one row for each doc_id: where rows that repeat it differ, the one with the most shingles."""
    several = durable(found.groupBy("doc_id").agg(F.count_distinct("n", "f1", "f2").alias("c")).filter("c > 1").select("doc_id"), "several")
    if several.isEmpty():
        return plain
    of = several.join(found, "doc_id").groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("best"))
    texts = plain.join(few(several), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.lit(1).alias("one"))
    known = texts.select("doc_id", "text").mapInArrow(_sized(k), "doc_id long, text string, n long, f1 long, f2 long").join(of, "doc_id")
    best = known.filter(F.struct("n", "f1", "f2") == F.col("best")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return plain.join(few(several), "doc_id", "left_anti").unionByName(best)


def _components(plain: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets, and the components of those that link; each a table or read from one."""
    spark = plain.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    whole = durable(plain.mapInArrow(_sets(k, percent), "doc_id long, n long, f1 long, f2 long, head array<long>"), "heads")
    found = durable(whole.drop("head"), "sets")

    # shingles in the heads of very many sets, put last in the order; the number is bounded
    def most_common(token: DataFrame) -> np.ndarray:
        often = token.groupBy("token").count().filter(F.col("count") > SHORT)
        rows = often.orderBy(F.desc("count"), "token").limit(LAST).select("token").collect()
        return np.array([r[0] for r in rows], np.int64)

    last = np.sort(most_common(whole.select(F.explode("head").alias("token"))))
    if len(last):
        last = np.union1d(last, most_common(plain.select("text").mapInArrow(_deeper(k, percent, last), "token long")))
    discard(whole)

    # equal sets are one node, named by the smallest doc_id
    real = found.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    texts = _one_each(plain.filter(F.col("doc_id").isNotNull()), real, k, percent)
    real = real.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("set")).select("doc_id", "set.*")
    real = durable(real, "real")
    twins = durable(real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")).filter("c > 1").drop("c"), "twins")
    copies = durable(real.join(few(twins), ["n", "f1", "f2"]).filter(F.col("doc_id") != F.col("node")).select("doc_id", "node"), "copies")

    # the index, without copies: short lists come out as pairs.  Shingles put last are known to be
    # common, so their entries are dealt apart; the others have few entries each, which meet by token once
    single = texts.join(few(copies.select("doc_id")), "doc_id", "left_anti")
    entry = single.mapInArrow(_entries(k, percent, last), "token long, doc_id long, code long, late boolean")
    salt = F.when(F.col("late"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = entry.withColumn("salt", salt).repartition(count, "token", "salt").sortWithinPartitions("token", "code", "doc_id")
    met = durable(dealt.select("token", "doc_id", "code", "late").mapInArrow(_lists(percent), "kind int, p long, q long, r long, s long, t long"), "lists")
    entries = met.filter("kind = 1").select(F.col("p").alias("token"), F.col("q").alias("doc_id"), F.shiftright("r", 32).alias("n"), F.col("r").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"))
    lengths = durable(entries.groupBy("token").agg(F.count("*").alias("all")).filter("all > 1"), "lengths")
    long = durable(entries.join(few(lengths), "token"), "long")

    # pairs of short lists, counted; a pair goes on if its count and the entries in long lists allow enough
    short = met.filter("kind = 0").groupBy(F.col("p").alias("a"), F.col("q").alias("b"))
    counted = short.agg(F.count("*").alias("c"), F.max("t").alias("ok"), F.max("r").alias("n_a"), F.max("s").alias("n_b")).filter("ok = 1")
    # beyond the heads: at most what is left of the set whose head ends first in the order
    head = lambda s: F.col(f"n_{s}") - F.ceil(percent * F.col(f"n_{s}") / 100) + 1
    after = F.greatest(F.least(F.col("n_a") - head("a"), F.col("n_b")), F.least(F.col("n_b") - head("b"), F.col("n_a")))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))
    more = durable(long.groupBy("doc_id").agg(F.count("*").alias("h")), "more")
    of = lambda s: few(more).select(F.col("doc_id").alias(s), F.col("h").alias(f"h_{s}"))
    in_long = F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    likely = counted.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(enough(F.col("c") + in_long + after)).select("a", "b")

    # long lists: every set meets the most central one, whose shingles the most others have
    central = long.groupBy("doc_id").agg(F.sum(F.log(F.col("all"))).alias("score"))
    hub = long.join(central, "doc_id").groupBy("token").agg(F.max(F.struct(F.col("score"), (-F.col("doc_id")).alias("id"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"))).alias("hub"))
    hubs = durable(hub.select("token", (-F.col("hub.id")).alias("hub"), "hub.hub_n", "hub.hub_at"), "hubs")
    near_hub = long.join(few(hubs), "token").filter((F.col("doc_id") != F.col("hub")) & possible(F.col("n"), F.col("at"), F.col("hub_n"), F.col("hub_at"), percent))
    first = durable(likely.unionByName(near_hub.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))).distinct(), "pairs")
    nodes = texts.withColumnRenamed("doc_id", "node")
    checked = durable(overlaps(first, nodes, k), "overlaps")
    discard(met)
    links = linked(checked, percent)
    near = components(links)

    # long lists again: only pairs not yet connected, not yet looked at, and not settled by their distances to the centre
    far = checked.select("a", "b", (F.col("n_a") + F.col("n_b") - 2 * F.col("shared")).alias("d"))
    apart = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).withColumnsRenamed({"a": "doc_id", "b": "hub"})
    at = long.join(near.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    at = at.join(few(hubs).select("token", "hub"), "token").join(apart, ["doc_id", "hub"], "left")
    at = durable(at.withColumn("d", F.when(F.col("doc_id") == F.col("hub"), F.lit(0)).otherwise(F.coalesce("d", F.lit(-1)))), "open")
    open_ = durable(at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token"), "tokens")
    blocks = F.ceil(F.col("all") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    # a long list is cut into blocks; every two blocks, and each with itself, meet in a task of their own
    spread = at.join(few(open_), "token").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1)))
    rows = spread.select(task.alias("token"), "n", "at", "doc_id", "component", side.alias("side"), "d")
    again = rows.repartition(count, "token").sortWithinPartitions("token").mapInArrow(_across(percent), "a long, b long, sure boolean")
    second = durable(again.groupBy("a", "b").agg(F.max("sure").alias("sure")).join(first, ["a", "b"], "left_anti"), "pairs")
    verified = linked(overlaps(durable(second.filter("not sure").select("a", "b"), "pairs"), nodes, k), percent)
    same = copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    groups = components(links.unionByName(second.filter("sure").select("a", "b")).unionByName(verified).unionByName(same))
    return found, groups


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id; all columns stay.

    Of rows that repeat a doc_id and are equal in all columns one stays.  Texts
    without words and rows without a doc_id link with nothing and all stay.
    """
    gone_id, twice_id = fresh(docs, "gone"), fresh(docs, "twice")
    with scope() as end:
        groups = similar(docs, k, percent)
        gone = durable(groups.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
        twice = durable(groups.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice_id)), "twice")
        end(gone, twice)
    mine = F.col("doc_id").cast("long")
    kept = docs.join(few(gone), mine == F.col(gone_id), "left_anti")
    if twice.isEmpty():
        return kept
    of = mine == F.col(twice_id)
    return kept.join(twice, of, "left_anti").unionByName(kept.join(twice, of, "left_semi").dropDuplicates())
