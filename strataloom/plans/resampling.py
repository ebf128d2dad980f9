"""Straightened and curved resampling, grids around a line, welded points and filled holes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import graphs, holes, resampling, spatial, stats
from strataloom.plans.registry import query
from strataloom.session import durable
from strataloom.sources.tables import table

#: Hours between places, hours beyond which two rows have a hole between them, and keys that a mean needs.
STEP, GAP, SUPPORT = 12.0, 72.0, 3

_STRAIGHT_SQL = f"""e AS (SELECT user_id, epoch(ts - min(ts) OVER (PARTITION BY user_id)) / 3600.0 AS s, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
    a AS (SELECT user_id, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.95) AS p FROM e WHERE v IS NOT NULL GROUP BY user_id),
    o AS (SELECT user_id, s, avg((v - c) * 0.5 / greatest(p - c, 1e-6) + 0.5) AS v FROM e LEFT JOIN a USING (user_id) GROUP BY user_id, s),
    l AS (SELECT *, lead(s) OVER w AS t, lead(v) OVER w AS u FROM o WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    k AS (SELECT *, unnest(CASE WHEN t IS NULL THEN generate_series(CAST(ceil(s / {STEP} - 1e-9) AS BIGINT), CAST(floor(s / {STEP} + 1e-9) AS BIGINT)) ELSE generate_series(CAST(ceil(s / {STEP} - 1e-9) AS BIGINT), CAST(ceil(t / {STEP} - 1e-9) AS BIGINT) - 1) END) AS k FROM l),
    f AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE greatest((k * {STEP} - s) / (t - s), 0) END AS f FROM k),
    r AS (SELECT user_id, k, CASE WHEN (t - s > {GAP} AND abs(f) > 1e-9) OR (CASE WHEN v IS NULL THEN 1 - f ELSE 0 END + CASE WHEN u IS NULL THEN f ELSE 0 END) > 0.01 THEN NULL ELSE (1 - f) * coalesce(v, 0) + f * coalesce(u, 0) END AS value FROM f)"""


def _straightened(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = (micros - F.min(micros).over(Window.partitionBy("user_id"))) / 3.6e9
    rows = table(spark, sf_dir, "events").select("user_id", hours.alias("s"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    ends = stats.percentiles(rows, "v", {"c": 0.5, "p": 0.95}, "user_id")
    level = (F.col("v") - F.col("c")) * 0.5 / F.greatest(F.col("p") - F.col("c"), F.lit(1e-6)) + 0.5
    return resampling.along(rows.join(ends, "user_id", "left").select("user_id", "s", level.alias("v")), ["user_id"], "s", "v", STEP, GAP)


@query("GEO10", f"WITH {_STRAIGHT_SQL} SELECT user_id, k, round(value, 6) AS value FROM r")
def straightened(spark, sf_dir):
    """Each user's values at even places along their own time axis, levelled by two percentiles; holes stay empty.

    A row of type error has no value; no value is read over more than GAP hours.
    """
    return _straightened(spark, sf_dir).select("user_id", "k", F.round("value", 6).alias("value"))


@query("GEO10 AGG19", f"WITH {_STRAIGHT_SQL} SELECT k, count(value) AS n, round(CASE WHEN count(value) >= {SUPPORT} THEN avg(value) END, 6) AS mean FROM r GROUP BY k")
def straightened_mean(spark, sf_dir):
    """The mean of all users at each place of the common axis, where enough have a value."""
    n = F.count("value")
    return _straightened(spark, sf_dir).groupBy("k").agg(n.alias("n"), F.round(F.when(n >= SUPPORT, F.avg("value")), 6).alias("mean"))


#: A stated line through the raster of line items, the arc between its places, the offsets around it, and the tube's two radii.
KNOTS = ((2.0, 1.2, 0.5), (12.0, 2.5, 2.0), (25.0, 4.0, 3.5), (38.0, 4.8, 5.0), (48.0, 6.5, 7.5))
ALONG, OFFSETS = 0.5, (-1.0, -0.5, 0.0, 0.5, 1.0)
FULL, FADE = 1.0, 2.0
_CELL = ["i", "j", "k"]

_RASTER_SQL = "SELECT CAST(floor(l_quantity) AS INTEGER) AS i, l_linenumber AS j, CAST(floor(l_tax * 100) AS INTEGER) AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3"
_LINE_SQL = f"""kn(o, x, y, z) AS (VALUES {", ".join(f"({o}, {x}, {y}, {z})" for o, (x, y, z) in enumerate(KNOTS))}),
    s0 AS (SELECT o, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, lead(x::DOUBLE) OVER w AS x1, lead(y::DOUBLE) OVER w AS y1, lead(z::DOUBLE) OVER w AS z1 FROM kn WINDOW w AS (ORDER BY o)),
    s1 AS (SELECT *, coalesce(sqrt((x1 - x) ** 2 + (y1 - y) ** 2 + (z1 - z) ** 2), 0) AS len FROM s0), s2 AS (SELECT *, coalesce(sum(len) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM s1),
    s3 AS (SELECT *, unnest(generate_series(CAST(ceil(s / {ALONG} - 1e-9) AS BIGINT), CAST(ceil((s + len) / {ALONG} - 1e-9) AS BIGINT) - 1)) AS n FROM s2 WHERE len > 0),
    s4 AS (SELECT n, x + (x1 - x) * (n * {ALONG} - s) / len AS x, y + (y1 - y) * (n * {ALONG} - s) / len AS y, z + (z1 - z) * (n * {ALONG} - s) / len AS z FROM s3),
    s5 AS (SELECT n, x, y, z, {", ".join(f"coalesce((lead({a}) OVER w - lag({a}) OVER w) / 2, lead({a}) OVER w - {a}, {a} - lag({a}) OVER w) AS d{a}" for a in "xyz")} FROM s4 WINDOW w AS (ORDER BY n)),
    s6 AS (SELECT n, x, y, z, dx / m AS tx, dy / m AS ty, dz / m AS tz FROM (SELECT *, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS m FROM s5)),
    ln AS (SELECT *, -rz * ty AS ax, rz * tx - rx * tz AS ay, rx * ty AS az FROM (SELECT *, -tz / sqrt(tx ** 2 + tz ** 2) AS rx, tx / sqrt(tx ** 2 + tz ** 2) AS rz FROM s6))"""


def _raster(spark, sf_dir):
    at = [F.floor("l_quantity").cast("int").alias("i"), F.col("l_linenumber").alias("j"), F.floor(F.col("l_tax") * 100).cast("int").alias("k")]
    return table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.avg("l_extendedprice").alias("v"))


def _line(spark):
    knots = spark.createDataFrame([(0, o, *p) for o, p in enumerate(KNOTS)], "line int, o int, x double, y double, z double")
    return durable(resampling.frames(knots, ["line"], "o", ["x", "y", "z"], ALONG), "line")  # else each of its columns is worked out at every use


@query(
    "GEO09 JON27 WIN03",
    f"""WITH g AS ({_RASTER_SQL}), {_LINE_SQL}, o(o) AS (VALUES {", ".join(f"({o})" for o in OFFSETS)}),
    p AS (SELECT n, u.o::DOUBLE AS u, v.o::DOUBLE AS v, x + u.o * rx + v.o * ax AS x, y + v.o * ay AS y, z + u.o * rz + v.o * az AS z FROM ln, o u, o v),
    c AS (SELECT n, u, v, CAST(floor(x) AS INTEGER) + a.s AS i, CAST(floor(y) AS INTEGER) + b.s AS j, CAST(floor(z) AS INTEGER) + d.s AS k,
      (CASE a.s WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b.s WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE d.s WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w
      FROM p, (VALUES (0), (1)) a(s), (VALUES (0), (1)) b(s), (VALUES (0), (1)) d(s))
    SELECT n, u, c.v, round(CASE WHEN sum(w) FILTER (WHERE g.v IS NULL AND w > 0) > 0.01 THEN NULL ELSE sum(w * coalesce(g.v, 0)) END, 5) AS value FROM c LEFT JOIN g USING (i, j, k) GROUP BY n, u, c.v""",
)
def curved_reformat(spark, sf_dir):
    """The raster read on a lattice that follows a line: frames along it, offsets across it, eight cells around each point."""
    points = resampling.lattice(_line(spark), ["x", "y", "z"], list(OFFSETS))
    got = resampling.sampled(points, ["n", "u", "v"], ["world0", "world1", "world2"], _raster(spark, sf_dir), _CELL, "v", spatial.corners)
    return got.select("n", "u", "v", F.round("value", 5).alias("value"))


@query(
    "JON20 GEO09",
    f"""WITH g AS ({_RASTER_SQL}), {_LINE_SQL},
    d AS (SELECT i, j, k, n, i - x AS dx, j - y AS dy, k - z AS dz, tx, ty, tz, rx, rz, ax, ay, az, row_number() OVER (PARTITION BY i, j, k ORDER BY round((i - x) ** 2 + (j - y) ** 2 + (k - z) ** 2, 9), n) AS r FROM g, ln WHERE (i - x) ** 2 + (j - y) ** 2 + (k - z) ** 2 <= {FADE**2}),
    t AS (SELECT i, j, k, n * {ALONG} + dx * tx + dy * ty + dz * tz AS arc, dx * rx + dz * rz AS u, dx * ax + dy * ay + dz * az AS v FROM d WHERE r = 1)
    SELECT i, j, k, round(arc, 5) AS arc, round(u, 5) AS u, round(v, 5) AS v, round(greatest(least(({FADE} - sqrt(u * u + v * v)) / {FADE - FULL}, 1), 0), 5) AS fade FROM t WHERE u * u + v * v <= {FADE**2}""",
)
def tube_grid(spark, sf_dir):
    """Cells of the raster around a line: arc of the foot, offsets along the frame there, and a weight that fades with distance."""
    line = _line(spark)
    cells = _raster(spark, sf_dir).select(*_CELL, *[F.col(c).cast("double").alias(a) for c, a in zip(_CELL, "xyz")]).withColumn("cell", F.struct(*_CELL))
    met = spatial.radius_pairs(cells.select("cell", "x", "y", "z"), line.select("n", "x", "y", "z"), "cell", "n", ["x", "y", "z"], FADE)
    foot = met.groupBy("cell").agg(F.min(F.struct(F.round(F.col("distance") ** 2, 9).alias("d"), "n")).alias("m")).select("cell.*", F.col("m.n").alias("n"))
    at = foot.join(line, "n")
    delta = [F.col(c) - F.col(a) for c, a in zip(_CELL, "xyz")]
    along = lambda c: sum(d * F.col(f"{c}{i}") for i, d in enumerate(delta))
    rows = at.select(*_CELL, (F.col("s") + along("t")).alias("arc"), along("r").alias("u"), along("a").alias("v")).filter(F.col("u") ** 2 + F.col("v") ** 2 <= FADE**2)
    fade = resampling.faded(F.sqrt(F.col("u") ** 2 + F.col("v") ** 2), FULL, FADE)
    return rows.select(*_CELL, *[F.round(c, 5).alias(c) for c in ("arc", "u", "v")], F.round(fade, 5).alias("fade"))


#: How near points of two owners lie to be welded.
WELD = 0.4
_POINTS_SQL = "SELECT o_orderkey AS id, o_orderpriority AS owner, o_totalprice / 1999.7 AS x, (epoch(o_orderdate) / 86400) % 365 / 9.7 AS y FROM orders"


@query(
    "JON21",
    f"""WITH RECURSIVE p AS ({_POINTS_SQL}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x BETWEEN b.x - {WELD} AND b.x + {WELD} WHERE a.owner <> b.owner AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {WELD**2}),
    r(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), c AS (SELECT n AS id, min(m) AS component FROM r GROUP BY n),
    s AS (SELECT component, count(*) AS n, avg(x) AS x, avg(y) AS y FROM c JOIN p USING (id) GROUP BY component)
    SELECT p.id, coalesce(component, p.id) AS component, coalesce(n, 1) AS n, round(coalesce(s.x, p.x), 6) AS x, round(coalesce(s.y, p.y), 6) AS y FROM p LEFT JOIN c USING (id) LEFT JOIN s USING (component)""",
)
def welded(spark, sf_dir):
    """Points of different owners that lie close are one group, with all that links reach, and move to its mean."""
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), (F.col("o_totalprice") / 1999.7).alias("x"), (day % 365 / 9.7).alias("y"))
    return graphs.welded(p, "id", "owner", ["x", "y"], WELD).select("id", "component", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SOLID_SQL = "SELECT CAST(floor(l_quantity) AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(floor(l_tax * 100) AS BIGINT) AS k FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > (SELECT count(*) / 3150.0 * 0.8 FROM lineitem)"


@query(
    "GEO20 GEO05",
    f"""WITH RECURSIVE s AS ({_SOLID_SQL}), b AS (SELECT min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1, min(k) - 1 AS k0, max(k) + 1 AS k1 FROM s),
    g AS (SELECT i.i, j.j, k.k FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM b) i, (SELECT unnest(generate_series(j0, j1)) AS j FROM b) j, (SELECT unnest(generate_series(k0, k1)) AS k FROM b) k ANTI JOIN s ON s.i = i.i AND s.j = j.j AND s.k = k.k),
    o(i, j, k) AS (SELECT i0, j0, k0 FROM b UNION SELECT g.i, g.j, g.k FROM o JOIN g ON abs(g.i - o.i) + abs(g.j - o.j) + abs(g.k - o.k) = 1)
    SELECT i, j, k FROM g ANTI JOIN o USING (i, j, k)""",
)
def enclosed_cells(spark, sf_dir):
    """Cells outside a set that no way across faces leads out of: what filling its holes adds."""
    lines = table(spark, sf_dir, "lineitem")
    least = lines.agg((F.count("*") / 3150.0 * 0.8).alias("least"))
    solid = lines.groupBy(F.floor("l_quantity").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.floor(F.col("l_tax") * 100).alias("k")).agg(F.count("*").alias("n"))
    solid = solid.crossJoin(F.broadcast(least)).filter("n > least").select(*_CELL)  # one row
    return holes.enclosed(solid, _CELL)
