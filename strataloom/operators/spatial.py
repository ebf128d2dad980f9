"""Range, as-of, nearest and radius joins that deal rows out by cells, and grid operators."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators import nearest as blocked
from strataloom.session import durable


def paint(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """rows with the id of the last band (by ord) with lo <= value < hi.

    bands is a parameter table of a few rows: it becomes one sorted array, which
    every row searches without a join.
    """
    few = bands.agg(F.sort_array(F.collect_list(F.struct((-F.col("ord")).alias("o"), "id", "lo", "hi"))).alias("bands"))
    inside = F.filter("bands", lambda b: (F.col(value) >= b["lo"]) & (F.col(value) < b["hi"]))
    return rows.crossJoin(F.broadcast(few)).withColumn("id", F.get(inside, F.lit(0))["id"]).drop("bands")


def as_of(left: DataFrame, right: DataFrame, at: str, since: str, keep: list[str], ranges: int | None = None) -> DataFrame:
    """left with the columns ``keep`` of the row of right with the largest ``since`` up to ``at``; inner.

    Rows of both sides are sorted into ``ranges`` parts of about one size (by
    default as many as the session has shuffle partitions), also where one value
    of ``at`` has most rows; each part is one ordered pass that may spill, and
    gets the last row of right of the parts before it, one row a part.  Of equal
    ``since`` the largest ``keep`` counts; rows of left with a null ``at``, or
    before all of right, are left out; rows of right with a null ``since`` are
    never found.
    """
    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = left.filter(F.col(at).isNotNull()).select(F.col(at).alias("__t"), F.struct(*left.columns).alias("__row"))
    known = right.filter(F.col(since).isNotNull()).select(F.col(since).alias("__t"), F.struct(*keep).alias("__v"))
    # known rows come before those asked at the same place, whose own order is free and spreads them
    both = known.unionByName(asked, allowMissingColumns=True).withColumns({"__asks": F.col("__row").isNotNull(), "__tie": F.xxhash64("__row")})
    order = ["__t", "__asks", "__v", "__tie"]
    parts = durable(both.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()), "as_of")
    last = parts.filter("not __asks").groupBy("__part").agg(F.max(F.struct("__t", "__v")).alias("__last"))
    held = last.select("__part", F.col("__last.__v").alias("__before")).orderBy("__part").collect()  # at most ``ranges`` rows
    before, carried = None, []
    found = {r["__part"]: r["__before"] for r in held}
    for i in range(ranges):
        if before is not None:
            carried.append((i, before))
        before = found.get(i, before)
    carry = spark.createDataFrame(carried, parts.select(F.col("__part").alias("__p"), F.col("__v").alias("__before")).schema)
    inside = F.last("__v", True).over(Window.partitionBy("__part").orderBy(*order[:3]).rowsBetween(Window.unboundedPreceding, 0))
    got = parts.select("__part", "__asks", "__row", inside.alias("__in")).filter("__asks").join(F.broadcast(carry), F.col("__part") == F.col("__p"), "left")
    got = got.withColumn("__f", F.coalesce("__in", "__before")).filter(F.col("__f").isNotNull())
    return got.select(*[F.col(f"__row.{c}").alias(c) for c in left.columns if c not in keep], *[F.col(f"__f.{k}").alias(k) for k in keep])


def cells(point: list[Column], size: float) -> list[Column]:
    return [F.floor(p / size).cast("long") for p in point]


def radius_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, axes: list[str], radius: float) -> DataFrame:
    """(key_a, key_b, distance) of points within ``radius``: b is put into its cell and those around it."""
    offsets = F.array(*[F.struct(*[F.lit(o).alias(x) for o, x in zip(step, axes)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    names = [f"c_{x}" for x in axes]
    left = a.select(F.col(key_a), *[F.col(x).alias(f"a_{x}") for x in axes], *[c.alias(n) for c, n in zip(cells([F.col(x) for x in axes], radius), names)])
    spread = b.select(F.col(key_b), *[F.col(x).alias(f"b_{x}") for x in axes], F.explode(offsets).alias("o"))
    right = spread.select(key_b, *[f"b_{x}" for x in axes], *[(F.floor(F.col(f"b_{x}") / radius).cast("long") + F.col(f"o.{x}")).alias(n) for x, n in zip(axes, names)])
    distance = F.sqrt(sum((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in axes))
    return left.join(right, names).withColumn("distance", distance).filter(F.col("distance") <= radius).select(key_a, key_b, "distance")


def nearest(points: DataFrame, refs: DataFrame, key: str, ref: str, axes: list[str], radius: float | None = None) -> DataFrame:
    """The nearest row of refs for each point, or only one within ``radius``; the smaller ref on ties.

    Without a radius, blocks of equal count are searched (operators/nearest.py).
    Points and refs with a null or a number that is not finite are left out;
    without refs there are no rows.
    """
    if radius is None:
        return blocked.nearest(points, refs, key, ref, axes)
    near = radius_pairs(points, refs, key, ref, axes, radius)
    return near.groupBy(key).agg(F.min(F.struct("distance", ref)).alias("m")).select(key, F.col(f"m.{ref}").alias(ref), F.col("m.distance").alias("distance"))


def affine(point: list[Column], matrix: list[list[float]]) -> list[Column]:
    """The point under a matrix with one row a result axis and the shift in the last column."""
    return [sum(m * p for m, p in zip(row, point)) + row[-1] for row in matrix]


def corners(point: list[Column]) -> Column:
    """The eight grid cells around a point with their trilinear weights: array of (i, j, k, weight)."""
    out = []
    for step in itertools.product((0, 1), repeat=3):
        at = [F.floor(p).cast("int") + s for p, s in zip(point, step)]
        weight = F.lit(1.0)
        for p, s in zip(point, step):
            part = p - F.floor(p)
            weight = weight * (part if s else 1 - part)
        out.append(F.struct(at[0].alias("i"), at[1].alias("j"), at[2].alias("k"), weight.alias("weight")))
    return F.array(*out)


def dilate(grid: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the set and those that share a face with one."""
    steps = [tuple(0 for _ in axes)] + [tuple(s if i == j else 0 for j in range(len(axes))) for i in range(len(axes)) for s in (-1, 1)]
    moved = F.explode(F.array(*[F.struct(*[(F.col(x) + s).alias(x) for x, s in zip(axes, step)]) for step in steps]))
    return grid.select(moved.alias("c")).select("c.*").distinct()


def erode(grid: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the set whose neighbours across faces are all in it."""
    steps = [tuple(s if i == j else 0 for j in range(len(axes))) for i in range(len(axes)) for s in (-1, 1)]
    moved = grid.select(F.explode(F.array(*[F.struct(*[(F.col(x) + s).alias(x) for x, s in zip(axes, step)]) for step in steps])).alias("c")).select("c.*")
    full = moved.groupBy(*axes).agg(F.count("*").alias("n")).filter(F.col("n") == len(steps)).drop("n")
    return grid.distinct().join(full, axes, "left_semi")
