"""Learned decision lists over text statistics.

Statistics of whole texts are Spark expressions.  A list of rules is learned
from labelled rows by sequential covering: a rule is grown as a conjunction of
thresholds by information gain, pruned on rows set apart, and taken while it
stays precise there; the rows it covers leave, and the next rule is grown.  The
list is emitted as one ordered conditional expression.  Nothing on this path
runs Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.exprs import let, words
from strataloom.session import durable, scope

#: Labelled rows that a fit may collect; those with the smallest hash of doc_id are taken.
FIT_ROWS = 20_000
MIN_PRECISION = 0.95
MIN_COVER = 5
THRESHOLDS = 64
SYMBOLS = r"[#*$%&|<>]"


def _covered(starts: Column) -> Column:
    """Words in 3-word windows that start at the sorted positions ``starts``."""
    return F.aggregate(
        F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def _repeat_words(w: Column) -> Column:
    def positions(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

    def counted(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: let(positions(s), _covered))
        )

    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashed, counted))


def statistics(text: Column) -> Column:
    """A struct of statistics of a whole text; a null text counts as an empty one.

    n_words; word_chars, code points in words; n_symbols; n_lines, lines with a
    word; n_dup_lines, those equal to an earlier one; n_repeat_words, words in
    3-word windows found twice or more; n_upper, capital letters.
    """
    known = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(known, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return let(
            lines,
            lambda at: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(known, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                F.size(at).cast("long").alias("n_lines"),
                (F.size(at) - F.size(F.array_distinct(at))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.regexp_count(known, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            ),
        )

    return let(words(known), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What the rules look at: ratios that do not depend on the length of a text, and its length."""
    part = lambda a, b: F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))
    return {
        "symbol_share": part("n_symbols", "word_chars"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "upper_share": part("n_upper", "word_chars"),
        "word_length": part("word_chars", "n_words"),
        "n_words": s["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


def _cuts(rows: list[dict], feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(middles) <= THRESHOLDS:
        return middles
    # the widest gaps and evenly spread ranks: a gap is where two kinds of text come apart
    wide = sorted(range(len(middles)), key=lambda i: values[i] - values[i + 1])[: THRESHOLDS // 2]
    even = [i * (len(middles) - 1) // (THRESHOLDS // 2) for i in range(THRESHOLDS // 2 + 1)]
    return [middles[i] for i in sorted({*wide, *even})]


def _split(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict], names: list[str]) -> list[Test]:
    rule: list[Test] = []
    while True:
        bad, good = _split(rows)
        if not bad or not good:
            return rule
        best, gain = None, 1e-9
        for name in names:
            ordered = sorted((r[name], r["bad"]) for r in rows)
            cuts, at, below = _cuts(rows, name), 0, 0
            for cut in cuts:
                while at < len(ordered) and ordered[at][0] <= cut:
                    below += ordered[at][1]
                    at += 1
                for above, b, n in ((False, below, at), (True, bad - below, len(ordered) - at)):
                    if b:
                        now = b * (math.log2(b / n) - math.log2(bad / (bad + good)))
                        if now > gain:
                            best, gain = Test(name, above, cut), now
        if best is None:
            return rule
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]


def _precision(rule: list[Test], rows: list[dict]) -> tuple[float, int]:
    hit = [r for r in rows if all(t.holds(r) for t in rule)]
    bad, good = _split(hit)
    return (bad / len(hit) if hit else 0.0), bad


def learn(rows: list[dict], names: list[str], min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[list[Test]]:
    """Rules for rejecting, in order.  rows: features, ``bad`` (0 or 1) and ``apart`` (set apart for pruning)."""
    rules: list[list[Test]] = []
    grow, prune = [r for r in rows if not r["apart"]], [r for r in rows if r["apart"]]
    while True:
        rule = _grow(grow, names)
        if not rule:
            return rules
        value = lambda x: (2 * _precision(x, prune)[0] - 1) * math.log1p(_precision(x, prune)[1])
        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule = rule[:-1]
        precision, cover = _precision(rule, prune)
        if precision < min_precision or cover < min_cover:
            return rules
        rules.append(rule)
        grow = [r for r in grow if not all(t.holds(r) for t in rule)]
        prune = [r for r in prune if not all(t.holds(r) for t in rule)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[Test]]:
    """Learn rejection rules from at most ``rows`` labelled documents that pass the base limits.

    A document with several labels is good if one says so, and of several rows
    with one doc_id the least text is taken, so that copies of rows change
    nothing; null labels and labels without a document are left out; without both
    kinds of rows there are no rules.
    """
    taken = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    s = F.col("s")
    columns = features(s)
    with scope() as end:
        # written before they are measured, or the statistics would be pushed below the join to all documents
        few = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
        few = durable(few, "fit")  # at most ``rows``
        found = (
            few.select("doc_id", "quality", statistics(F.col("text")).alias("s"))
            .filter(~base_failed(s))
            .select((F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"), *[c.alias(n) for n, c in columns.items()])
            .orderBy("bad", *columns)
            .collect()
        )
        end()
    return learn([r.asDict() for r in found], list(columns))


def verdict(s: Column, rules: list[list[Test]]) -> Column:
    """True where a text with statistics ``s`` is kept: an ordered conditional expression."""
    columns, chain = features(s), F.when(base_failed(s), F.lit(False))
    for rule in rules:
        test = rule[0].column(columns)
        for more in rule[1:]:
            test = test & more.column(columns)
        chain = chain.when(test, F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """One row per row of docs: doc_id, statistics, base_failed, kept.

    A null text counts as an empty one, which fails the base limits; repeated
    rows are judged each for itself; a null doc_id stays null; an empty table
    gives no rows; columns other than doc_id and text are not used.
    """
    s = F.col("s")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return docs.select("doc_id", statistics(F.col("text")).alias("s")).select(
        "doc_id", *[s[n].alias(n) for n in names], base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept")
    )


def keep(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return docs.filter(let(statistics(F.col("text")), lambda s: verdict(s, rules)))
