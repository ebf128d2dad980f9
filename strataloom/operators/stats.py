"""Robust statistics, information measures and fits as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import discard, durable

#: Cells into which a range of values is cut while a rank is looked for, and rows that one task may sort then.
CELLS, SORTED_ROWS = 4_096, 200_000
#: Rows of a key up to which one task may hold its values, which is faster.
HELD_ROWS = 1_000_000


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Exact linearly interpolated percentiles of each key: keys, and a column for each of ``shares``.

    Rows are counted in cells of value, of which only the ones with the wanted
    ranks are looked at again, cut finer until they are small; those are sorted.
    No task holds the values of a key of more than HELD_ROWS; the result does not
    depend on that, but for rounding.  Above that, the values are written once:
    ranks and cells of one scan are looked up in the next, and values that are
    computed again from sums may differ in their last bits.  Infinite values rank before or behind all
    others and are counted, not cut; between one and a finite value lies an
    infinite one, between both NaN.  Nulls and NaN are left out, as are keys
    without other values.
    """
    known = rows.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    most = known.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= HELD_ROWS:
        got = known.groupBy(*keys).agg(*[F.percentile("v", F.lit(q)).alias(k) for k, q in shares.items()], F.count("*").alias("n"))
        return got.filter("n > 0").drop("n")
    inf = float("inf")
    written = known = durable(known, "values")
    finite = (F.col("v") > -inf) & (F.col("v") < inf)
    sides = [F.count_if(F.col("v") == -inf).alias("below"), F.count_if(F.col("v") == inf).alias("over")]
    ends = durable(known.groupBy(*keys).agg(F.count("*").alias("n"), *sides, F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi")), "ends")
    known = known.filter(finite)
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.lit(q).alias("q")) for k, q in shares.items()]))
    places = ends.select(*keys, "n", "below", "over", "lo", "hi", asked.alias("a")).withColumn("at", (F.col("n") - 1) * F.col("a.q"))
    ranks = places.select(*keys, "n", "below", "over", "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    ranks = ranks.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("n") - F.col("over")))
    ranks = ranks.select(*keys, "lo", "hi", F.col("below").alias("before"), (F.col("n") - F.col("below") - F.col("over")).alias("c"), "rank")
    made: list[DataFrame] = []
    span = [*keys, "lo", "hi", "before"]

    def within() -> DataFrame:
        """Rows in the range of a wanted rank, with that range."""
        ranges = F.broadcast(ranks.select(*span).distinct().withColumnsRenamed({k: f"k_{k}" for k in keys}))  # few rows a key
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], F.col("v").between(F.col("lo"), F.col("hi")))
        return known.join(ranges, same).select(*span, "v")

    many = lambda table, c: not table.filter((F.col("lo") < F.col("hi")) & (F.col(c) > SORTED_ROWS)).isEmpty()
    more = many(ends, "n")
    while more:
        cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
        counted = within().groupBy(*span, cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*span).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cut = counted.withColumn("upto", F.col("before") + upto).withColumnsRenamed({c: f"r_{c}" for c in span})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in span])
        here = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - cut["c"])
        finer = ranks.drop("c").join(cut, same & here).select(*keys, F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("c")).alias("before"), "c", "rank")
        ranks = durable(finer, "ranks")
        more = many(ranks, "c")
        discard(*made)
        made = [ranks]
    held = within().groupBy(*span, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*span).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    cut = held.withColumn("upto", F.col("before") + upto).withColumnsRenamed({c: f"r_{c}" for c in span})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in span])
    found = ranks.drop("c").join(cut, same & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select(*keys, "rank", "v")
    found = durable(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values")), "found")
    discard(written, *made)
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    value_at = lambda place: F.when(place < F.col("below"), -inf).when(place >= F.col("n") - F.col("over"), inf).otherwise(F.try_element_at("values", place.cast("long")))

    def taken(q: float) -> Column:
        lower, upper = value_at(F.floor(at(q))), value_at(F.ceil(at(q)))
        part = at(q) - F.floor(at(q))
        return F.when(lower == upper, lower).otherwise((1 - part) * lower + part * upper)

    other = found.withColumnsRenamed({k: f"k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], F.lit(True))
    return ends.join(other, same, "left").select(*keys, *[taken(q).alias(k) for k, q in shares.items()])


def exact_quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """One percentile of all rows; null without rows."""
    got = percentiles(rows, value, {"q": share}).first()
    return got and got[0]


def robust_window(rows: DataFrame, value: str, low: float, high: float, *keys: str) -> DataFrame:
    """Exact interpolated percentiles of the positive values of each key."""
    return percentiles(rows.filter(F.col(value) > 0), value, {"lo": low, "hi": high}, *keys)


def quantise(value: Column, lo: Column, hi: Column) -> Column:
    """Clip to 0..255 and cut off, not round."""
    return F.floor(F.least(F.greatest((value - lo) / (hi - lo) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((F.least(F.greatest(value, lo), hi) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def mutual_information(rows: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """(H(a) + H(b)) / H(a, b) over two-dimensional bins between the 0.5 and 99.5 percentiles."""
    ends = percentiles(rows, a, {f"{a}_lo": 0.005, f"{a}_hi": 0.995}).crossJoin(percentiles(rows, b, {f"{b}_lo": 0.005, f"{b}_hi": 0.995}))  # one row each
    binned = rows.crossJoin(F.broadcast(ends)).select(*[bin_of(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).alias(f"bin_{c}") for c in (a, b)])
    joint = binned.groupBy(f"bin_{a}", f"bin_{b}").agg(F.count("*").alias("n"))  # at most bins * bins rows from here on
    entropy = lambda df: df.select((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    one = lambda c: entropy(joint.groupBy(f"bin_{c}").agg(F.sum("n").alias("n")))
    parts = one(a).withColumnRenamed("h", "ha").crossJoin(one(b).withColumnRenamed("h", "hb")).crossJoin(entropy(joint).withColumnRenamed("h", "hab"))
    return parts.select(((F.col("ha") + F.col("hb")) / F.col("hab")).alias("nmi"))


def clipped_fit(rows: DataFrame, x: str, y: str, times: float, key: str) -> DataFrame:
    """Least-squares line of each key, fitted again without residuals beyond ``times`` median deviations."""
    fit = lambda df, tag: df.groupBy(key).agg(F.regr_slope(y, x).alias(f"slope{tag}"), F.regr_intercept(y, x).alias(f"intercept{tag}"), F.count("*").alias(f"n{tag}"))
    first = fit(rows, "1")
    left = durable(rows.join(first, key).select(key, x, y, (F.col(y) - F.col("slope1") * F.col(x) - F.col("intercept1")).alias("r")), "residuals")
    middle = percentiles(left, "r", {"m": 0.5}, key)
    away = left.join(middle, key).withColumn("away", F.abs(F.col("r") - F.col("m")))
    spread = middle.join(percentiles(away, "away", {"mad": 0.5}, key), key)
    kept = left.join(spread, key).filter(F.abs(F.col("r") - F.col("m")) <= times * F.col("mad"))
    return fit(kept, "2").join(first, key).select(key, "slope1", "slope2", "n1", "n2")
