"""Resampling along a line with holes, frames of a line, and grids around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of an interpolated value that may come from missing rows; more makes a hole.
HOLE = 0.01


def along(rows: DataFrame, keys: list[str], arc: str, value: str, step: float, gap: float) -> DataFrame:
    """(keys, k, value): ``value`` at the places k * step between the first and last ``arc`` of each key.

    Between two neighbours in order of arc the value is linear.  It is null (a
    hole) where they lie more than ``gap`` apart, unless the place is one of them,
    or where more than HOLE of it would come from a row without a value; up to
    that a missing value counts as 0.  Rows with a null arc are left out; of rows
    with one arc the mean counts.  A segment makes the places that lie on it, so
    nothing is joined.
    """
    one = rows.filter(F.col(arc).isNotNull()).groupBy(*keys, F.col(arc).cast("double").alias("__s")).agg(F.avg(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__s")
    seg = one.withColumns({"__t": F.lead("__s").over(w), "__u": F.lead("__v").over(w), "__last": F.lead("__s").over(w).isNull()})
    first = F.ceil(F.col("__s") / step - 1e-9).cast("long")
    # the last row makes its own place, the others all before the next row's
    beyond = F.when(F.col("__last"), F.floor(F.col("__s") / step + 1e-9).cast("long") + 1).otherwise(F.ceil(F.col("__t") / step - 1e-9).cast("long"))
    at = seg.filter(beyond > first).withColumn("k", F.explode(F.sequence(first, beyond - 1)))
    part = F.when(F.col("__last"), F.lit(0.0)).otherwise(F.greatest((F.col("k") * step - F.col("__s")) / (F.col("__t") - F.col("__s")), F.lit(0.0)))
    far = ~F.col("__last") & (F.col("__t") - F.col("__s") > gap) & (F.abs(part) > 1e-9)
    missing = F.when(F.col("__v").isNull(), 1 - part).otherwise(0.0) + F.when(F.col("__u").isNull(), part).otherwise(0.0)
    got = (1 - part) * F.coalesce("__v", F.lit(0.0)) + part * F.coalesce("__u", F.lit(0.0))
    return at.select(*keys, "k", F.when(far | (missing > HOLE), F.lit(None)).otherwise(got).alias("value"))


def frames(knots: DataFrame, keys: list[str], order: str, axes: list[str], step: float) -> DataFrame:
    """(keys, n, s, axes, t0.., r0.., a0..): a line at every ``step`` of its arc, with a frame at each place.

    t is the unit tangent by central differences, r the unit vector across t and
    the second axis, a the third one; null where the line runs along that axis.
    Knots of a key come in ``order``; knots that do not move on are passed over.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    seg = knots.withColumns({f"__{x}": F.lead(x).over(w) for x in axes})
    size = F.sqrt(sum((F.col(f"__{x}") - F.col(x)) ** 2 for x in axes))
    seg = seg.withColumn("__len", F.coalesce(size, F.lit(0.0)))
    seg = seg.withColumn("__s", F.coalesce(F.sum("__len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).filter("__len > 0")
    place = lambda c: F.ceil(c / step - 1e-9).cast("long")
    lo, hi = place(F.col("__s")), place(F.col("__s") + F.col("__len")) - 1
    at = seg.filter(hi >= lo).withColumn("n", F.explode(F.sequence(lo, hi)))
    part = (F.col("n") * step - F.col("__s")) / F.col("__len")
    line = at.select(*keys, "n", (F.col("n") * step).alias("s"), *[(F.col(x) + (F.col(f"__{x}") - F.col(x)) * part).alias(x) for x in axes])
    v = Window.partitionBy(*keys).orderBy("n")
    slope = lambda x: F.coalesce((F.lead(x).over(v) - F.lag(x).over(v)) / 2, F.lead(x).over(v) - F.col(x), F.col(x) - F.lag(x).over(v))
    line = line.withColumns({f"t{i}": slope(x) for i, x in enumerate(axes)})
    norm = lambda *c: F.nullif(F.sqrt(sum(F.col(x) * F.col(x) for x in c)), F.lit(0.0))
    line = line.withColumn("__n", norm("t0", "t1", "t2")).withColumns({f"t{i}": F.col(f"t{i}") / F.col("__n") for i in range(3)})
    line = line.withColumn("__m", norm("t0", "t2")).withColumns({"r0": -F.col("t2") / F.col("__m"), "r1": F.when(F.col("__m").isNotNull(), F.lit(0.0)), "r2": F.col("t0") / F.col("__m")})
    t, r = ([F.col(f"{c}{i}") for i in range(3)] for c in "tr")
    across = [r[1] * t[2] - r[2] * t[1], r[2] * t[0] - r[0] * t[2], r[0] * t[1] - r[1] * t[0]]
    return line.withColumns({f"a{i}": c for i, c in enumerate(across)}).select(*keys, "n", "s", *axes, *[f"{c}{i}" for c in "tra" for i in range(3)])


def lattice(line: DataFrame, axes: list[str], offsets: list[float]) -> DataFrame:
    """line with u, v and world0..2: the points at offsets u along r and v along a from each of its places."""
    each = lambda name: F.explode(F.array(*[F.lit(float(o)) for o in offsets])).alias(name)
    spread = line.select("*", each("u")).select("*", each("v"))
    return spread.withColumns({f"world{i}": F.col(x) + F.col("u") * F.col(f"r{i}") + F.col("v") * F.col(f"a{i}") for i, x in enumerate(axes)})


def sampled(points: DataFrame, keys: list[str], point: list[str], grid: DataFrame, cell: list[str], value: str, corners) -> DataFrame:
    """(keys, value): the grid between its cells, from the eight around each point; null where more than HOLE of it is missing.

    One join meets the cells that are touched; ``corners`` makes them of a point.
    """
    around = points.select(*keys, F.inline(corners([F.col(p) for p in point]))).withColumnsRenamed(dict(zip("ijk", cell)))
    met = around.filter("weight > 0").join(grid.select(*cell, F.col(value).alias("__v")), cell, "left")
    held = met.groupBy(*keys).agg(F.sum(F.col("weight") * F.coalesce("__v", F.lit(0.0))).alias("__sum"), F.sum(F.when(F.col("__v").isNull(), F.col("weight")).otherwise(0.0)).alias("__gone"))
    return held.select(*keys, F.when(F.col("__gone") <= HOLE, F.col("__sum")).alias("value"))


def faded(r: Column, full: float, fade: float) -> Column:
    """1 up to ``full`` from the line, 0 from ``fade`` on, linear between."""
    return F.greatest(F.least((fade - r) / (fade - full), F.lit(1.0)), F.lit(0.0))
