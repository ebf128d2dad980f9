"""Secret scan: named patterns, and sliding-window entropy over candidate strings.

All of it is one Spark expression a text.  Positions come from splitting a text
at a pattern: the pieces between matches and the matches themselves alternate,
so running sums of their lengths are the bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.exprs import let, prefix_sums

# The named patterns and the least length of a secret in each.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
#: A greedy run that is too short cannot hold a longer one, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Candidate strings for entropy, and the window in which it is measured.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WIDTH = 20
#: Character class, its pattern, and the bits a character that make a window suspicious.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Strings that look random and are no secrets: identifiers in 8-4-4-4-12 form, plain numbers,
#: names and paths without digits, names of one case with separators, stand-ins.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"^[a-z]+([-_/=][a-z]+|[-_/=][0-9]+)*$",
    r"^[A-Z]+([-_/=][A-Z]+|[-_/=][0-9]+)*$",
    r"(?i)example|sample|dummy|placeholder|redacted|changeme|x{6,}|0{8,}|12345678",
)
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _matches(text: Column, pattern: str) -> Column:
    """Bounds of the leftmost non-overlapping matches: array of (start, end, index from 0)."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def bounds(g: Column, m: Column) -> Column:
        both = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: a + b)
        return let(prefix_sums(both), lambda ends: F.zip_with(ends, m, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))))

    return let(lengths(gaps), lambda g: let(lengths(found), lambda m: bounds(g, m)))


def _spans(text: Column, pattern: str, rank: int, length: int = 0) -> Column:
    """Spans of one kind; with ``length``, only those whose second group has so many characters."""
    place = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))
    if length:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        long = lambda at: let(values, lambda v: F.filter(at, lambda _, i: F.length(v[i]) >= length))
        got = F.transform(let(_matches(text, pattern), long), place)
    else:
        got = F.transform(_matches(text, pattern), place)
    return F.when(text.rlike(pattern), got).otherwise(F.array().cast(SPAN))


def window_range(candidate: Column, width: int, bits: Column) -> Column:
    """(first, last) start, from 0, of the windows of a candidate whose entropy reaches ``bits``; nulls without one.

    The counts of the characters (ASCII) are kept while the window slides, as a
    string with one character a count, and with them the sum of n log2 n: only
    the counts of the character that leaves and of the one that enters change.
    """
    limit = width * (math.log2(width) - bits)  # entropy >= bits: the sum is at most this
    part = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])

    def moved(held: Column, total: Column, char: Column, by: int) -> Column:
        """The counts and the sum once ``char`` has entered (by 1) or left (by -1)."""
        at = F.ascii(char) + 1
        return let(
            F.ascii(F.substr(held, at, F.lit(1))) - 65,
            lambda n: F.struct(F.overlay(held, F.char(n + 65 + by), at, F.lit(1)).alias("held"), (total - F.get(part, n) + F.get(part, n + by)).alias("sum")),
        )

    def step(state: Column, i: Column) -> Column:
        gone = lambda: moved(state["held"], state["sum"], F.substr(candidate, i - width + 1, F.lit(1)), -1)
        left = F.when(i >= width, gone()).otherwise(F.struct(state["held"].alias("held"), state["sum"].alias("sum")))
        full = lambda s: (i >= width - 1) & (s["sum"] <= limit)
        start = i - (width - 1)
        return let(
            let(left, lambda s: moved(s["held"], s["sum"], F.substr(candidate, i + 1, F.lit(1)), 1)),
            lambda s: F.struct(
                s["held"].alias("held"),
                s["sum"].alias("sum"),
                F.when(full(s), F.coalesce(state["first"], start)).otherwise(state["first"]).alias("first"),
                F.when(full(s), start).otherwise(state["last"]).alias("last"),
            ),
        )

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit("A" * 128).alias("held"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy(text: Column, base: Column) -> Column:
    """Spans of candidates that are random enough, not allowed, and apart from the base spans."""
    bits = lambda c: F.coalesce(*[F.when(c.rlike(p), F.lit(b)) for _, p, b in CLASSES], F.lit(99.0))
    allowed = lambda c: c.rlike("|".join(f"(?:{p})" for p in ALLOWED))

    def judged(at: Column) -> Column:
        free = ~F.exists(base, lambda b: (b["start"] < at["end"]) & (at["start"] < b["end"]))
        text_of = F.substr(text, (at["start"] + 1).cast("int"), (at["end"] - at["start"]).cast("int"))
        none = F.lit(None).cast("struct<first:int,last:int>")
        got = let(text_of, lambda c: F.when(free & ~allowed(c), window_range(c, WIDTH, bits(c))).otherwise(none))
        return let(got, lambda r: F.struct((at["start"] + r["first"]).alias("start"), F.lit(3).alias("rank"), (at["start"] + r["last"] + WIDTH).alias("end")))

    spans = F.filter(F.transform(_matches(text, CANDIDATE), judged), lambda x: x["start"].isNotNull())
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(SPAN))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Find secrets in every whole text (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as
    kind:start:end by start, then kind, joined by commas) and spans (all spans in
    that form).  Positions count code points, ends are exclusive.  A null text
    is an empty one; repeated rows are scanned each for itself; a null doc_id
    stays null; an empty table gives no rows; other columns are not used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = let(
        text,
        lambda t: F.struct(_spans(t, ASSIGN, 0, ASSIGN_LENGTH).alias("assign"), _spans(t, ACCESS, 1).alias("access"), _spans(t, HEX, 2).alias("hex")),
    )
    b = F.col("base")
    named = F.concat(b["assign"], b["access"], b["hex"])
    return (
        docs.select("doc_id", text.alias("text"), base.alias("base"))
        .select("doc_id", "base", let(named, lambda n: F.struct(n.alias("named"), _entropy(F.col("text"), n).alias("more"))).alias("all"))
        .select(
            "doc_id",
            *[F.size(b[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            F.sha2(_text(F.col("all.named")), 256).alias("base_sha256"),
            _text(F.concat(F.col("all.named"), F.col("all.more"))).alias("spans"),
        )
    )
