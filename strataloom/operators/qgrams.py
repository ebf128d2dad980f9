"""Candidate search by q-grams: an inverted index, a prefix and a count filter, and a bit-parallel check.

Two strings that are alike share many of their runs of q characters.  Runs are
numbered where a string has them several times, so sharing is a matter of sets.
If n runs of a query have to share at least t, one of its n - t + 1 rarest is
shared: only those meet the index.  What meets is counted in full, and only what
shares enough is compared.  No pair is left out that a bound does not exclude.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import ship


def grams(values: DataFrame, column: str, size: Column) -> DataFrame:
    """(column, grams): the numbered runs of ``size`` characters of each distinct value that is not null."""
    one = values.filter(F.col(column).isNotNull()).select(column, size.cast("int").alias("__g")).distinct()
    starts = F.when(F.length(column) >= F.col("__g"), F.sequence(F.lit(1), F.length(column) - F.col("__g") + 1))
    runs = one.select(column, "__g", F.explode(starts).alias("__i")).select(column, "__g", F.substr(F.col(column), F.col("__i"), F.col("__g")).alias("__r"))
    counted = runs.groupBy(column, "__g", "__r").agg(F.count("*").cast("int").alias("__n"))
    numbered = counted.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return numbered.groupBy(column, F.col("__g").alias("size")).agg(F.sort_array(F.collect_set(F.concat_ws("\u0001", "__r", "__k"))).alias("grams"))


def candidates(asked: DataFrame, values: DataFrame, q: str, v: str, size: Column, least: Column, enough: Column) -> DataFrame:
    """(q, v): pairs of distinct strings that share enough q-grams.

    ``size``: how many characters the runs of a query have, by an expression over
    q (one of a few numbers); ``least``: how many of them any match shares, 1 or
    more, over q; ``enough``: how many a match with v shares, over q and v.
    """
    ask = grams(asked, q, size).withColumn("least", F.greatest(least.cast("int"), F.lit(1))).filter(F.size("grams") >= F.col("least"))
    sizes = asked.select(size.cast("int").alias("size")).distinct()
    known = grams(values.select(v).distinct().crossJoin(F.broadcast(sizes)), v, F.col("size"))  # a handful of sizes
    index = known.select(v, "size", F.explode("grams").alias("gram"))
    often = index.groupBy("size", "gram").agg(F.count("*").alias("often"))
    mine = ask.select(q, "size", "least", F.size("grams").alias("held"), F.explode("grams").alias("gram")).join(often, ["size", "gram"])
    # runs that no value has are the rarest of all: they take places of the prefix and meet nothing
    absent = F.col("held") - F.count("*").over(Window.partitionBy(q))
    place = F.row_number().over(Window.partitionBy(q).orderBy("often", "gram")) + absent
    prefix = mine.withColumn("place", place).filter(F.col("place") <= F.col("held") - F.col("least") + 1).select(q, "size", "gram")
    met = prefix.join(index, ["size", "gram"]).select(q, v).distinct()
    both = met.join(ask.select(q, "size", F.col("grams").alias("__a")), q).join(known.select(v, "size", F.col("grams").alias("__b")), [v, "size"])
    return both.filter(F.size(F.array_intersect("__a", "__b")) >= enough).select(q, v)


def within_edits(most: Callable[[int], int], inside: bool):
    """Errors of q against v, or against the best part of v (``inside``), for pairs of at most most(len(q)) errors.

    Myers' bit vectors: a column of the table of edit distances is two numbers,
    and each character of v moves it on by a few operations.
    """

    def errors(q: str, v: str, masks: dict[str, int]) -> int:
        m = len(q)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best = score
        for c in v:
            hit = masks.get(c, 0)
            d0 = ((((hit & up) + up) ^ up) | hit | down) & full
            plus, minus = (down | ~(d0 | up)) & full, d0 & up
            score += bool(plus & top) - bool(minus & top)
            plus = (plus << 1 | (0 if inside else 1)) & full
            minus = minus << 1 & full
            up, down = (minus | ~(d0 | plus)) & full, d0 & plus
            best = min(best, score)
        return best if inside else score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, masks = None, {}
        for batch in batches:
            q, v = (batch.column(i).to_pylist() for i in (0, 1))
            found = []
            for a, b in zip(q, v):
                if a != last:
                    last, masks = a, {}
                    for i, c in enumerate(a):
                        masks[c] = masks.get(c, 0) | 1 << i
                e = errors(a, b, masks) if a else (0 if inside else len(b))
                found.append(e if e <= most(len(a)) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int32())], [*batch.schema.names, "errors"])

    return run


def alike(asked: DataFrame, values: DataFrame, q: str, v: str, share: float | None = None, edits: int | None = None, inside: bool = False) -> DataFrame:
    """(q, v, errors): distinct strings within ``edits`` edits, or ``share`` of the length of q.

    ``inside``: q against the part of v that it is nearest to.  Null and empty
    strings match nothing; nor does, for parts of v, a q of at most ``edits``
    characters, which any part is near to.  Every edit spoils at most as many runs
    as a run has characters, so of the n - size + 1 runs of the longer string (of q,
    for parts of v) all but size * edits are shared; the runs are of two characters
    where that leaves one of q, or else of one.  A q no longer than its edits is
    held against the strings of the lengths that it can become.
    """
    ship(asked.sparkSession)
    asked = asked.select(q).filter(F.length(q) > 0).distinct()
    most = (lambda m: edits) if edits is not None else (lambda m: int(m * share + 1e-9))
    limit = F.lit(edits) if edits is not None else F.floor(F.length(q) * share + 1e-9)
    left = lambda n, size: n - size + 1 - size * limit
    size = F.when(left(F.length(q), 2) >= 1, 2).otherwise(1)
    longer = F.length(q) if inside else F.greatest(F.length(q), F.length(v))
    pairs = candidates(asked.filter(F.length(q) > limit), values, q, v, size, left(F.length(q), size), left(longer, F.col("size")))
    if edits is not None and not inside:
        short = asked.filter(F.length(q) <= limit).select(q, F.explode(F.sequence(F.lit(1), F.length(q) + edits)).alias("__n"))
        pairs = pairs.unionByName(short.join(values.filter(F.length(v) > 0).select(v, F.length(v).alias("__n")).distinct(), "__n").select(q, v))
    if not inside:
        pairs = pairs.filter(F.abs(F.length(q) - F.length(v)) <= limit)
    return pairs.select(q, v).mapInArrow(within_edits(most, inside), f"{q} string, {v} string, errors int").filter("errors is not null")
