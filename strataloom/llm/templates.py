"""Line dedup with a log-template tree of fixed depth.

A line is reduced to a template: tokens with a digit become ``<*>``.  Templates
are parsed down a tree, first by their number of tokens, then by their leading
tokens; in a leaf a template joins the first group, in a fixed order, that it
equals in enough places, and the places where it differs become ``<*>`` too.
Lines whose template group recurs in enough documents are dropped, but for the
document with the smallest id, so no content is lost altogether.

Lines are counted by template where they are read, so a line that a third of
all documents has is one row a task.  Only leaves that can reach the limit are
parsed, template by template and not line by line.  A leaf is never split, since
groups depend on all of its templates; those that no other one of a large leaf
can be like are put aside before it is parsed, which changes no group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.exprs import SPACE, fresh, let
from strataloom.session import discard, durable, scope, ship

#: Documents from which on a template recurs, and least tokens of a line that can be dropped.
MIN_DOCS = 10
MIN_TOKENS = 3
#: Leading tokens on the way to a leaf, and templates from which on those of a leaf without a like are put aside first.
DEPTH, LEAF_TEMPLATES = 4, 2_000
#: Most rows (of two longs) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Share of places in which a template equals its group; shorter ones have to be equal throughout.
ALIKE, LEAST_ALIKE = 0.8, 6
WILD = "<*>"

VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"


def template(line: Column) -> Column:
    """The tokens of a line with those that have a digit generalised, as an array."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, WILD)).otherwise(line)
    return F.array_remove(F.split(masked, SPACE), "")


def _lead(tokens: Column, n: int) -> Column:
    return F.xxhash64(F.size(tokens), F.array_join(F.slice(tokens, 1, n), " "))


def lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, text_hash, line (from 0), leaf, n, template, hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
        .select("doc_id", "text_hash", "line", template(F.col("raw")).alias("t"))
        .filter(F.size("t") >= MIN_TOKENS)
        .select(
            "doc_id",
            "text_hash",
            "line",
            _lead(F.col("t"), DEPTH).alias("leaf"),
            F.size("t").alias("n"),
            F.array_join("t", " ").alias("template"),
        )
        .withColumn("hash", F.xxhash64("template", "n"))
    )


def blocks(n: int) -> list[tuple[int, int]]:
    """Ranges of places of which two alike sequences of n tokens equal each other in one at least: one more than places that may differ."""
    spare = next(k for k in range(n, -1, -1) if n - k >= ALIKE * n)
    start = min(DEPTH, n - spare - 1)  # the leading tokens are equal in a leaf
    cuts = [start + (n - start) * i // (spare + 1) for i in range(spare + 2)]
    return list(zip(cuts, cuts[1:]))


def group(templates: list[list[str]]) -> tuple[list[int], list[list[str]]]:
    """The group of each template of one node and length, taken in the order given, and what each group generalises to.

    Only groups that equal the template in a block are compared, which leaves out none that is alike.
    """
    if not templates:
        return [], []
    n = len(templates[0])
    ranges = blocks(n)
    numbers: dict[str, int] = {WILD: 0}
    held = np.zeros((16, n), np.int32)  # the tokens of each group by number
    index: dict[tuple, list[int]] = {}
    groups: list[list[str]] = []
    out = []
    for t in templates:
        row = np.array([numbers.setdefault(x, len(numbers)) for x in t], np.int32)
        keys = [(i, *t[a:b]) for i, (a, b) in enumerate(ranges)]
        near = np.unique(np.concatenate([np.array(index.get(k, []), np.int64) for k in keys]))
        near = near[(held[near] == row).sum(axis=1) >= ALIKE * n]
        if len(near):
            best = int(near[0])
            sketch = [a if a == b else WILD for a, b in zip(groups[best], t)]
            for i, (a, b) in enumerate(ranges):
                if sketch[a:b] != groups[best][a:b]:
                    index.setdefault((i, *sketch[a:b]), []).append(best)
            groups[best] = sketch
            held[best] = np.where(held[best] == row, row, 0)
        else:
            best = len(groups)
            groups.append(list(t))
            if best == len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            held[best] = row
            for k in keys:
                index.setdefault(k, []).append(best)
        out.append(best)
    return out, groups


def _node(table: pa.Table) -> pa.Table:
    rows = sorted(zip((-x for x in table.column("docs").to_pylist()), table.column("template").to_pylist(), table.column("hash").to_pylist()))
    by_size: dict[int, list] = {}
    for _, t, h in rows:
        tokens = t.split(" ")
        by_size.setdefault(len(tokens), []).append((tokens, h))
    found = []
    for held in by_size.values():
        where, groups = group([t for t, _ in held])
        members = Counter(where)
        names = {g: int.from_bytes(hashlib.blake2b(" ".join(groups[g]).encode(), digest_size=8).digest(), "little", signed=True) for g, c in members.items() if c > 1}
        found += [(h, names[g]) for (_, h), g in zip(held, where) if g in names]
    return pa.table({"hash": pa.array([h for h, _ in found], pa.int64()), "grouped": pa.array([g for _, g in found], pa.int64())})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for leaf, h, t in zip(*(batch.column(c).to_pylist() for c in ("leaf", "hash", "template"))):
            tokens = t.split(" ")
            for i, (a, b) in enumerate(blocks(len(tokens))):
                name = hashlib.blake2b(" ".join([str(leaf), str(i), *tokens[a:b]]).encode(), digest_size=8).digest()
                found.append((h, int.from_bytes(name, "little", signed=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["hash", "key"])


def likely(templates: DataFrame) -> DataFrame:
    """The templates that can be in a group with others: those that have a block in common with another of their leaf.

    A template without ``<*>`` only joins a group whose first member equals it in a
    block.  One with it may join for places that were generalised, so it stays.
    """
    keys = templates.select("leaf", "hash", "template").mapInArrow(_keys, "hash long, key long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    wild = templates.filter(F.array_contains(F.split("template", " "), WILD)).select("hash")
    return templates.join(keys.join(shared, "key").select("hash").union(wild).distinct(), "hash", "left_semi")


def _least(min_docs: int, long_lines: tuple[int, int] | None) -> Column:
    """Documents from which on a template of n tokens recurs."""
    if not long_lines:
        return F.lit(min_docs)
    tokens, docs = long_lines
    return F.when(F.col("n") >= tokens, F.lit(min(docs, min_docs))).otherwise(F.lit(min_docs))


def parse(docs: DataFrame, counted: DataFrame, least: Column) -> DataFrame:
    """(hash, grouped) of templates that share a group with others; each leaf is parsed as a whole."""
    open_ = counted.filter(F.col("n") >= LEAST_ALIKE)
    leaves = open_.groupBy("leaf", "n").agg(F.sum("docs").alias("all"), F.count("*").alias("templates"))  # a leaf has one n
    busy = leaves.filter((F.col("all") >= least) & (F.col("templates") > 1)).drop("n")
    taken = durable(open_.join(busy, "leaf").select("leaf", (F.col("templates") > LEAF_TEMPLATES).alias("large"), "hash", "docs", "at.doc_id", "at.text_hash", "at.line"), "busy")
    # the wording of a template comes from the first line that has it; few lines are needed as a rule,
    # and then their documents are found by a broadcast of checked size
    places = taken.select("doc_id", "text_hash").distinct()
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    sources = docs.select(F.col("doc_id").cast("long"), "text", text.alias("text_hash"))
    sources = sources.join(places.withColumnsRenamed({"doc_id": "id", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left_semi")
    worded = lines(sources).groupBy("hash").agg(F.min("template").alias("template"))
    rows = taken.join(worded, "hash").select("leaf", "large", "hash", "template", "docs")
    if not taken.filter("large").isEmpty():
        rows = durable(rows, "worded")
        rows = rows.filter("not large").unionByName(likely(rows.filter("large")))
    return rows.drop("large").groupBy("leaf").applyInArrow(_node, "hash long, grouped long")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, long_lines: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines to drop (doc_id, text_hash, at: their numbers), and the groups behind them (grouped, docs, first)."""
    ship(docs.sparkSession)
    least = _least(min_docs, long_lines)
    thin = durable(lines(docs).select("doc_id", "text_hash", "line", "leaf", "n", "hash"), "lines")
    # lines, and not yet documents, are counted here: an upper bound that decides what is looked at
    counted = durable(thin.groupBy("hash", "leaf", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "text_hash", "line")).alias("at")), "templates")
    joined = durable(parse(docs, counted, least), "groups")
    # templates that can matter: those often enough by themselves, and those that share a group
    often = counted.filter(F.col("docs") >= least).select("hash")
    named = joined.select("hash").union(often).distinct()
    named = durable(named.join(joined, "hash", "left").select("hash", F.coalesce("grouped", "hash").alias("grouped")), "named")
    placed = durable(thin.join(named, "hash").select("doc_id", "text_hash", "line", "n", "grouped"), "placed")
    once = placed.groupBy("grouped", "doc_id").agg(F.max("n").alias("n"))  # the lines of a group are of one length
    groups = once.groupBy("grouped").agg(F.max("n").alias("n"), F.count("*").alias("docs"), F.min("doc_id").alias("first")).filter(F.col("docs") >= least)
    groups = durable(groups.drop("n"), "recurring")
    discard(thin, counted, joined, named)
    drop = (
        placed.join(groups, "grouped")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("line").alias("at"))
    )
    return drop, groups


def strip(docs: DataFrame, min_docs: int = MIN_DOCS, long_lines: tuple[int, int] | None = None) -> DataFrame:
    """docs with recurring lines taken out of text, and three columns more.

    ``line_count``, lines of the text; ``lines_dropped``; ``had_words``, whether
    the whole text had a word.  Lines are what stands between newlines.  A null
    text stays null; an empty one stays empty; rows with the same doc_id and text
    lose the same lines; rows without a doc_id count as one document, which
    comes after all others and is never the one that keeps a line unless it is
    the only one; an empty table gives no rows; other columns stay as they are.

    ``long_lines``, as (tokens, documents): lines of so many tokens recur from so
    many documents on, since a long line in two documents is no coincidence.
    """
    id_, hash_, gone_id, gone_hash, at = (fresh(docs, x) for x in ("line_id", "line_hash", "gone_id", "gone_hash", "gone_at"))
    with scope() as end:
        drop = durable(recurring(docs, min_docs, long_lines)[0], "drop")
        end(drop)
    # texts only move where the lines to drop are too many to be sent to them
    size = drop.agg(F.count("*") + F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.withColumns({hash_: key, id_: F.col("doc_id").cast("long")})
    gone = drop.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash), F.sort_array("at").alias(at))
    both = marked.join(F.broadcast(gone) if size <= BROADCAST_ROWS else gone, F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(hash_) == F.col(gone_hash)), "left")
    split = F.split(F.col("text"), "\n")
    kept = F.array_join(let(split, lambda s: F.filter(s, lambda _, i: ~F.array_contains(F.col(at), i))), "\n")
    return both.select(
        *[docs[c] if c != "text" else F.when(F.col(at).isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("line_count"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("lines_dropped"),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("had_words"),
    )
