"""Fits, interpolation, polylines and their frames, ramps, profiles, grids of cells and shells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strataloom.operators import fits, graphs, paths, spatial, stats
from strataloom.plans.registry import query
from strataloom.session import durable
from strataloom.sources.tables import table

AXES = ["x", "y", "z"]
AXIS = ["i", "j", "k"]
_LINES = "SELECT l_linestatus AS g, l_extendedprice / 1000 AS d, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_partkey / 100.0 AS e, l_suppkey / 10.0 AS f FROM lineitem"


def _lines(spark, sf_dir):
    """Line items as points with three axes and three measures."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_linestatus").alias("g"), (c("l_extendedprice") / 1000).alias("d"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("z"), (c("l_partkey") / 100.0).alias("e"), (c("l_suppkey") / 10.0).alias("f")
    )


def _plane_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT g, n, ky, kz, md - ky * my - kz * mz AS k0 FROM (SELECT *, (syd * szz - szd * syz) / (syy * szz - syz * syz) AS ky, (szd * syy - syd * syz) / (syy * szz - syz * syz) AS kz
    FROM (SELECT g, count(*) AS n, avg(d) AS md, avg(y) AS my, avg(x) AS mz, var_pop(y) AS syy, var_pop(x) AS szz, covar_pop(y, x) AS syz, covar_pop(y, d) AS syd, covar_pop(x, d) AS szd FROM {rows} GROUP BY g)))"""


@query(
    "AGG24",
    f"""WITH p AS ({_LINES}), {_plane_sql("a", "p")}, r AS (SELECT p.*, d - ky * y - kz * x - k0 AS r FROM p JOIN a USING (g)), m AS (SELECT g, median(r) AS m FROM r GROUP BY g),
    s AS (SELECT g, m, median(abs(r - m)) AS mad FROM r JOIN m USING (g) GROUP BY g, m), k AS (SELECT r.* FROM r JOIN s USING (g) WHERE abs(r - m) <= greatest(1.5 * mad, 0.5)), {_plane_sql("b", "k")}
    SELECT g, a.n AS n1, b.n AS n2, round(CASE WHEN b.n >= 20 THEN b.ky ELSE a.ky END, 5) AS ky, round(CASE WHEN b.n >= 20 THEN b.kz ELSE a.kz END, 5) AS kz, round(CASE WHEN b.n >= 20 THEN b.k0 ELSE a.k0 END, 4) AS k0 FROM a JOIN b USING (g)""",
)
def plane_fit(spark, sf_dir):
    """A least-squares plane of each group, fitted again without residuals beyond 1.5 median deviations where 20 rows are left."""

    def fit(rows, tag):
        s = rows.groupBy("g").agg(F.count("*").alias(f"n{tag}"), F.avg("d").alias("md"), F.avg("y").alias("my"), F.avg("x").alias("mz"), F.var_pop("y").alias("syy"), F.var_pop("x").alias("szz"), F.covar_pop("y", "x").alias("syz"), F.covar_pop("y", "d").alias("syd"), F.covar_pop("x", "d").alias("szd"))
        det = F.col("syy") * F.col("szz") - F.col("syz") * F.col("syz")
        s = s.withColumn(f"ky{tag}", (F.col("syd") * F.col("szz") - F.col("szd") * F.col("syz")) / det).withColumn(f"kz{tag}", (F.col("szd") * F.col("syy") - F.col("syd") * F.col("syz")) / det)
        return s.select("g", f"n{tag}", f"ky{tag}", f"kz{tag}", (F.col("md") - F.col(f"ky{tag}") * F.col("my") - F.col(f"kz{tag}") * F.col("mz")).alias(f"k0{tag}"))

    rows = _lines(spark, sf_dir).select("g", "d", "x", "y")
    first = durable(fit(rows, "1"), "plane")  # a row a group: sums made again may differ in their last bits
    left = rows.join(first, "g").withColumn("r", F.col("d") - F.col("ky1") * F.col("y") - F.col("kz1") * F.col("x") - F.col("k01"))
    middle = durable(stats.percentiles(left, "r", {"m": 0.5}, "g"), "middle")
    away = left.join(middle, "g").withColumn("away", F.abs(F.col("r") - F.col("m")))
    spread = stats.percentiles(away, "away", {"mad": 0.5}, "g")
    second = fit(away.join(spread, "g").filter(F.col("away") <= F.greatest(1.5 * F.col("mad"), F.lit(0.5))).select("g", "d", "x", "y"), "2")
    pick = lambda c: F.when(F.col("n2") >= 20, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    return first.join(second, "g").select("g", "n1", "n2", F.round(pick("ky"), 5).alias("ky"), F.round(pick("kz"), 5).alias("kz"), F.round(pick("k0"), 4).alias("k0"))


def _affine_sql() -> str:
    cov = [f"covar_pop({a}, {b}) AS s{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]
    rows = []
    for t in "def":
        n = [f"s{t}{a}" for a in "xyz"]
        minor = lambda a, b: f"(s{''.join(sorted(a))} * s{''.join(sorted(b))})"
        cof = {("x", "x"): ("yy", "zz", "yz", "yz"), ("x", "y"): ("xz", "yz", "xy", "zz"), ("x", "z"): ("xy", "yz", "xz", "yy"), ("y", "y"): ("xx", "zz", "xz", "xz"), ("y", "z"): ("xy", "xz", "xx", "yz"), ("z", "z"): ("xx", "yy", "xy", "xy")}
        adj = lambda a, b: "({} - {})".format(minor(*cof[tuple(sorted((a, b)))][:2]), minor(*cof[tuple(sorted((a, b)))][2:]))
        det = f"(sxx * {adj('x', 'x')} + sxy * {adj('x', 'y')} + sxz * {adj('x', 'z')})"
        k = ["(" + " + ".join(f"{n[i]} * {adj(a, b)}" for i, b in enumerate("xyz")) + f") / {det}" for a in "xyz"]
        rows.append(f"SELECT '{t}' AS target, {k[0]} AS kx, {k[1]} AS ky, {k[2]} AS kz, m{t} AS m, mx, my, mz FROM s")
    return f"WITH p AS ({_LINES}), s AS (SELECT {', '.join(f'avg({a}) AS m{a}' for a in 'xyzdef')}, {', '.join(cov)}, {', '.join(f'covar_pop({t}, {a}) AS s{t}{a}' for t in 'def' for a in 'xyz')} FROM p) SELECT target, round(kx, 5) AS kx, round(ky, 5) AS ky, round(kz, 5) AS kz, round(m - kx * mx - ky * my - kz * mz, 4) AS shift FROM ({' UNION ALL '.join(rows)})"


@query("AGG25", _affine_sql())
def affine_fit(spark, sf_dir):
    """The affine map of three axes to three measures by least squares: twelve numbers from sums over all rows."""
    rows, targets = _lines(spark, sf_dir), ["d", "e", "f"]
    one = lambda a, b: F.covar_pop(a, b)
    sums = rows.agg(*[F.avg(c).alias(f"m{c}") for c in (*AXES, *targets)], *[one(a, b).alias(f"s{a}{b}") for a in AXES for b in AXES], *[one(t, a).alias(f"s{t}{a}") for t in targets for a in AXES])
    got = sums.first()
    if got["mx"] is None:
        return spark.createDataFrame([], "target string, kx double, ky double, kz double, shift double")
    gram = np.array([[got[f"s{a}{b}"] for b in AXES] for a in AXES])
    cross = np.array([[got[f"s{t}{a}"] for a in AXES] for t in targets])
    k = np.linalg.lstsq(gram, cross.T, rcond=None)[0].T
    shift = np.array([got[f"m{t}"] for t in targets]) - k @ np.array([got[f"m{a}"] for a in AXES])
    made = [(t, *(round(float(v), 5) for v in row), round(float(s), 4)) for t, row, s in zip(targets, k, shift)]
    return spark.createDataFrame(made, "target string, kx double, ky double, kz double, shift double")


def _vectors(spark, sf_dir):
    """The first three components of the vectors, as points."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(AXES)])


@query("AGG26")
def similarity_fit(spark, sf_dir):
    """The similarity (and the rigid map of scale 1) that takes points turned, stretched and disturbed back to where they were."""
    v = _vectors(spark, sf_dir)
    turn = [[0.8 * 1.5, -0.6 * 1.5, 0.0, 0.25], [0.6 * 1.5, 0.8 * 1.5, 0.0, -0.5], [0.0, 0.0, 1.5, 1.0]]
    noise = [(F.pmod(F.col("vec_id") * (7 + i), F.lit(11)) - 5) / 1000 for i in range(3)]
    to = [c + n for c, n in zip(spatial.affine([F.col(a) for a in AXES], turn), noise)]
    rows = v.select(*[F.col(a) for a in AXES], *[c.alias(f"t_{a}") for a, c in zip(AXES, to)])
    out = []
    for name, scale in (("similarity", None), ("rigid", 1.0)):
        matrix = fits.similarity(rows, AXES, [f"t_{a}" for a in AXES], scale)
        out += [(name, a, *(round(float(x), 6) for x in row)) for a, row in zip(AXES, matrix)]
    return spark.createDataFrame(out, "fit string, axis string, kx double, ky double, kz double, shift double")


@query("JON22")
def icp_fit(spark, sf_dir):
    """Points fitted to a shifted and slightly turned copy of half of them, by nearest points and trimmed similarity fits."""
    v = _vectors(spark, sf_dir)
    turn = [[0.9998, -0.02, 0.0, 0.004], [0.02, 0.9998, 0.0, -0.003], [0.0, 0.0, 1.0, 0.002]]
    target = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("ref"), *[c.alias(a) for a, c in zip(AXES, spatial.affine([F.col(a) for a in AXES], turn))])
    matrix, rms = fits.icp(v.select("vec_id", *AXES), target, "vec_id", "ref", AXES, 3)
    return spark.createDataFrame([(a, *(round(float(x), 6) for x in row), round(float(rms or 0.0), 6)) for a, row in zip(AXES, matrix)], "axis string, kx double, ky double, kz double, shift double, rms double")


@query(
    "JON33",
    """WITH k AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, value FROM events WHERE event_type = 'view'), q AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s FROM events WHERE event_type = 'purchase'),
    b AS (SELECT q.event_id, k.s AS s0, k.value AS v0 FROM q ASOF JOIN k ON q.user_id = k.user_id AND q.s >= k.s), a AS (SELECT q.event_id, k.s AS s1, k.value AS v1 FROM q ASOF JOIN k ON q.user_id = k.user_id AND q.s <= k.s)
    SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR s1 = s0 THEN v0 ELSE v0 + (v1 - v0) * (q.s - s0) / (s1 - s0) END, 4) AS value FROM q LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id) WHERE v0 IS NOT NULL OR v1 IS NOT NULL""",
)
def bracketed_value(spark, sf_dir):
    """At each event of one kind the value between the events of another kind around it; the end values beyond them."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase")).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    knot = F.when(F.col("event_type") == "view", F.struct("s", "value"))
    w = Window.partitionBy("user_id")
    before = F.last(knot, True).over(w.orderBy("s", F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(knot, True).over(w.orderBy(F.desc("s"), F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0))
    rows = e.select("event_id", "event_type", "s", before.alias("b"), after.alias("a")).filter("event_type = 'purchase'")
    b, a = F.col("b"), F.col("a")
    between = b["value"] + (a["value"] - b["value"]) * (F.col("s") - b["s"]) / (a["s"] - b["s"])
    value = F.when(b.isNull(), a["value"]).when(a.isNull() | (a["s"] == b["s"]), b["value"]).otherwise(between)
    return rows.filter(b.isNotNull() | a.isNotNull()).select("event_id", F.round(value, 4).alias("value"))


#: Knots of a monotone curve.
KNOTS = ((5.0, 0.0), (10.0, 2.0), (18.0, 2.5), (30.0, 9.0), (41.0, 9.0), (48.0, 12.0))


@query(
    "MTH04",
    f"""WITH k(i, x, y) AS (VALUES {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(KNOTS))}), s AS (SELECT i, x, y, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, lead(y) OVER w AS y1 FROM k WINDOW w AS (ORDER BY i)),
    p AS (SELECT *, lag(h) OVER (ORDER BY i) AS hp, lag(d) OVER (ORDER BY i) AS dp FROM s), m AS (SELECT *, CASE WHEN h IS NULL OR hp IS NULL OR dp * d <= 0 THEN 0 ELSE 3 * (hp + h) * dp * d / ((2 * hp + h) * d + (hp + 2 * h) * dp) END AS m FROM p),
    c AS (SELECT *, lead(m) OVER (ORDER BY i) AS m1 FROM m), q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity, 5.0), 48.0) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((2 * t ** 3 - 3 * t ** 2 + 1) * y + (t ** 3 - 2 * t ** 2 + t) * h * m + (-2 * t ** 3 + 3 * t ** 2) * y1 + (t ** 3 - t ** 2) * h * m1, 5) AS mapped FROM (SELECT *, (v - x) / h AS t FROM q JOIN c ON h IS NOT NULL AND (v > x OR i = 0) AND v <= x + h)""",
)
def monotone_map(spark, sf_dir):
    """A monotone cubic through knots with flat ends, constant beyond them; tangents are weighted harmonic means of the slopes."""
    x, y = (np.array(v) for v in zip(*KNOTS))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w0, w1 = 2 * h[i - 1] + h[i], h[i - 1] + 2 * h[i]
            m[i] = (w0 + w1) / (w0 / d[i - 1] + w1 / d[i])
    v = F.least(F.greatest("l_quantity", F.lit(float(x[0]))), F.lit(float(x[-1])))

    def piece(i: int) -> Column:
        t = (v - float(x[i])) / float(h[i])
        c0, c1 = float(y[i]), float(h[i] * m[i])
        c2, c3 = float(3 * (y[i + 1] - y[i]) - h[i] * (2 * m[i] + m[i + 1])), float(2 * (y[i] - y[i + 1]) + h[i] * (m[i] + m[i + 1]))
        return c0 + t * (c1 + t * (c2 + t * c3))

    curve = F.when(v <= float(x[1]), piece(0))
    for i in range(1, len(h)):
        curve = curve.when(v <= float(x[i + 1]), piece(i))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(curve, 5).alias("mapped"))


_LINE_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2.0 AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM events"


def _polyline(spark, sf_dir):
    """Each user's events in order as the points of a line."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", i.alias("i"), F.col("value").alias("x"), (i * 2.0).alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))


def _segments(points):
    """Points with the next one, the length to it and the arc up to it."""
    w = Window.partitionBy("user_id").orderBy("i")
    rows = points.withColumns({f"{a}1": F.lead(a).over(w) for a in AXES})
    size = F.sqrt(sum((F.col(f"{a}1") - F.col(a)) ** 2 for a in AXES))
    rows = rows.withColumn("len", F.coalesce(size, F.lit(0.0)))
    return rows.withColumn("s", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


_SEGMENTS_SQL = f"""p AS ({_LINE_SQL}), n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    l AS (SELECT *, coalesce(sqrt((x1 - x) ** 2 + (y1 - y) ** 2 + (z1 - z) ** 2), 0) AS len FROM n), g AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)"""


@query(
    "WIN01",
    f"""WITH {_SEGMENTS_SQL}, k AS (SELECT *, unnest(generate_series(CAST(ceil(s / 25.0 - 1e-9) AS BIGINT), CAST(ceil((s + len) / 25.0 - 1e-9) AS BIGINT) - 1)) AS k FROM g WHERE len > 0)
    SELECT user_id, k, round(x + (x1 - x) * (k * 25.0 - s) / len, 4) AS x, round(y + (y1 - y) * (k * 25.0 - s) / len, 4) AS y, round(z + (z1 - z) * (k * 25.0 - s) / len, 4) AS z FROM k""",
)
def arc_resample(spark, sf_dir):
    """Points every 25 units of arc along each line: a segment makes those that lie on it, so no join is needed."""
    rows = _segments(_polyline(spark, sf_dir)).filter("len > 0")
    step = lambda c: F.ceil(c / 25.0 - 1e-9).cast("long")
    lo, hi = step(F.col("s")), step(F.col("s") + F.col("len")) - 1
    at = rows.filter(hi >= lo).withColumn("k", F.explode(F.sequence(lo, hi)))
    part = (F.col("k") * 25.0 - F.col("s")) / F.col("len")
    return at.select("user_id", "k", *[F.round(F.col(a) + (F.col(f"{a}1") - F.col(a)) * part, 4).alias(a) for a in AXES])


@query(
    "WIN03",
    f"""WITH p AS ({_LINE_SQL}), t AS (SELECT user_id, i, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w) AS x, coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w) AS y, coalesce((lead(z) OVER w - lag(z) OVER w) / 2, lead(z) OVER w - z, z - lag(z) OVER w) AS z FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    u AS (SELECT user_id, i, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, nullif(sqrt(x * x + y * y + z * z), 0) AS n FROM t)), r AS (SELECT *, -z / m AS rx, x / m AS rz FROM (SELECT *, nullif(sqrt(z * z + x * x), 0) AS m FROM u))
    SELECT user_id, i, round(x, 5) AS tx, round(y, 5) AS ty, round(z, 5) AS tz, round(rx, 5) AS rx, round(rz, 5) AS rz, round(-rz * y, 5) AS ax, round(rz * x - rx * z, 5) AS ay, round(rx * y, 5) AS az FROM r""",
)
def moving_frame(spark, sf_dir):
    """Unit tangent by central differences, the unit vector across it and the y axis, and the third one; null where a norm is 0."""
    w = Window.partitionBy("user_id").orderBy("i")
    ahead, back = (lambda a: F.lead(a).over(w)), (lambda a: F.lag(a).over(w))
    slope = lambda a: F.coalesce((ahead(a) - back(a)) / 2, ahead(a) - F.col(a), F.col(a) - back(a))
    rows = _polyline(spark, sf_dir).select("user_id", "i", *[slope(a).alias(a) for a in AXES])
    norm = lambda *c: F.nullif(F.sqrt(sum(F.col(x) * F.col(x) for x in c)), F.lit(0.0))
    rows = rows.withColumn("n", norm(*AXES)).select("user_id", "i", *[(F.col(a) / F.col("n")).alias(a) for a in AXES])
    x, y, z = (F.col(a) for a in AXES)
    rows = rows.withColumn("m", norm("x", "z")).withColumns({"rx": -z / F.col("m"), "rz": x / F.col("m")})
    rx, rz = F.col("rx"), F.col("rz")
    cut = lambda c, name: F.round(c, 5).alias(name)
    return rows.select("user_id", "i", cut(x, "tx"), cut(y, "ty"), cut(z, "tz"), cut(rx, "rx"), cut(rz, "rz"), cut(-rz * y, "ax"), cut(rz * x - rx * z, "ay"), cut(rx * y, "az"))


@query(
    "WIN13",
    "SELECT user_id, event_id, round(value * t * t * (3 - 2 * t), 6) AS tapered FROM (SELECT *, least(greatest((row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) / 4.0, 0), 1) AS t FROM events)",
)
def trailing_taper(spark, sf_dir):
    """Weights that fall smoothly to nothing over the last four rows of each key."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, sf_dir, "events").withColumn("t", F.least((last - 1) / 4.0, F.lit(1.0)))
    t = F.col("t")
    return rows.select("user_id", "event_id", F.round(F.col("value") * t * t * (3 - 2 * t), 6).alias("tapered"))


#: Blocks of levels in order, and the limit beyond which none is made.
BLOCKS = ("click", "error", "purchase", "view")
LIMIT = 320.0


@query(
    "WIN14",
    f"""WITH b(block, j) AS (VALUES {", ".join(f"('{b}', {j})" for j, b in enumerate(BLOCKS))}), e AS (SELECT user_id, block, j, max(value) * (j + 1) AS fin, count(*) FILTER (WHERE value <= 50) AS todo, max(value) FILTER (WHERE value <= 5) AS measured FROM events JOIN b ON block = event_type GROUP BY 1, 2, 3),
    c AS (SELECT *, greatest(coalesce(max(measured) OVER (PARTITION BY user_id), 0), coalesce(max(fin) OVER (PARTITION BY user_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cur FROM e),
    l AS (SELECT *, unnest(generate_series(0, todo - 1)) AS i, (fin - cur) / todo AS step FROM c WHERE fin > cur + 1e-6 AND todo > 0)
    SELECT user_id, block, i, round(cur + i * step, 5) AS lo, round(least(cur + (i + 1) * step, {LIMIT}), 5) AS hi FROM l WHERE cur + i * step < {LIMIT}""",
)
def allotted_bands(spark, sf_dir):
    """What is left of each block up to its landmark, shared out evenly among its levels; a cursor passes the farthest landmark so far."""
    number = F.array_position(F.array(*[F.lit(b) for b in BLOCKS]), F.col("event_type")) - 1
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*BLOCKS)).groupBy("user_id", F.col("event_type").alias("block"), number.alias("j"))
    e = e.agg((F.max("value")).alias("top"), F.count_if(F.col("value") <= 50).alias("todo"), F.max(F.when(F.col("value") <= 5, F.col("value"))).alias("measured")).withColumn("fin", F.col("top") * (F.col("j") + 1))
    w = Window.partitionBy("user_id")
    before = F.max("fin").over(w.orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    rows = e.withColumn("at", F.greatest(F.coalesce(F.max("measured").over(w), F.lit(0.0)), F.coalesce(before, F.lit(0.0))))
    rows = rows.filter((F.col("fin") > F.col("at") + 1e-6) & (F.col("todo") > 0)).withColumn("step", (F.col("fin") - F.col("at")) / F.col("todo"))
    level = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("todo") - 1)))
    lo = F.col("at") + F.col("i") * F.col("step")
    return level.filter(lo < LIMIT).select("user_id", "block", "i", F.round(lo, 5).alias("lo"), F.round(F.least(lo + F.col("step"), F.lit(LIMIT)), 5).alias("hi"))


@query("WIN16")
def ordered_names(spark, sf_dir):
    """Five names put in order on the days of each user: values seen there, less what gaps depart from the height of a name."""
    e = table(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    rows = e.groupBy("user_id", day.alias("place")).agg(F.sum(F.col("value") / 100).alias("score")).filter("place >= 0")
    return paths.assigned(rows, "user_id", "place", "score", heights=(4, 6, 5, 7), names=("n0", "n1", "n2", "n3", "n4"), spread=0.25)


_NARROW, _WIDE = 2.0, 12.0
_REACH = 48


@query(
    "WIN17",
    f"""WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT a.user_id, a.event_id, round(sum(b.value * exp(-((a.i - b.i) ** 2) / (2 * {_NARROW} * {_NARROW}))) / sum(exp(-((a.i - b.i) ** 2) / (2 * {_NARROW} * {_NARROW}))) - sum(b.value * exp(-((a.i - b.i) ** 2) / (2 * {_WIDE} * {_WIDE}))) / sum(exp(-((a.i - b.i) ** 2) / (2 * {_WIDE} * {_WIDE}))), 5) AS band
    FROM p a JOIN p b ON a.user_id = b.user_id AND abs(a.i - b.i) <= {_REACH} GROUP BY 1, 2""",
)
def band_pass(spark, sf_dir):
    """A profile smoothed narrowly less the same smoothed widely; weights are scaled to what lies inside at the ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    around = F.collect_list("value").over(w.rowsBetween(-_REACH, _REACH))
    before = F.least(F.row_number().over(w) - 1, F.lit(_REACH))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", around.alias("v"), before.cast("int").alias("mid"))

    def smooth(sigma: float) -> Column:
        kernel = F.array(*[F.lit(math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(_REACH + 1)])
        weight = F.transform("v", lambda _, j: F.get(kernel, F.abs(j - F.col("mid"))))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return total(F.zip_with("v", weight, lambda x, y: x * y)) / total(weight)

    return rows.select("user_id", "event_id", F.round(smooth(_NARROW) - smooth(_WIDE), 5).alias("band"))


@query(
    "WIN21",
    f"""WITH {_SEGMENTS_SQL}, e AS (SELECT user_id, -1 AS side, x AS px, y AS py, z AS pz, (x - x1) / len AS dx, (y - y1) / len AS dy, (z - z1) / len AS dz, 0.0 AS s FROM g WHERE i = 1 AND len > 0
      UNION ALL SELECT user_id, 1, x1, y1, z1, (x1 - x) / len, (y1 - y) / len, (z1 - z) / len, s + len FROM g q WHERE len > 0 AND i + 1 = (SELECT max(i) FROM g r WHERE r.user_id = q.user_id))
    SELECT user_id, side, k, round(px + k * 0.25 * dx, 5) AS x, round(py + k * 0.25 * dy, 5) AS y, round(pz + k * 0.25 * dz, 5) AS z, round(s + side * k * 0.25, 5) AS arc FROM e, (SELECT unnest(generate_series(1, 8)) AS k)""",
)
def extended_line(spark, sf_dir):
    """Eight points beyond each end of a line, straight on along its end tangents."""
    count = F.max("i").over(Window.partitionBy("user_id"))
    ends = _segments(_polyline(spark, sf_dir)).withColumn("n", count).filter("len > 0")
    unit = lambda a: (F.col(f"{a}1") - F.col(a)) / F.col("len")
    first = ends.filter("i = 1").select("user_id", F.lit(-1).alias("side"), *[F.col(a).alias(f"p{a}") for a in AXES], *[(-unit(a)).alias(f"d{a}") for a in AXES], F.lit(0.0).alias("s"))
    final = ends.filter("i + 1 = n").select("user_id", F.lit(1).alias("side"), *[F.col(f"{a}1").alias(f"p{a}") for a in AXES], *[unit(a).alias(f"d{a}") for a in AXES], (F.col("s") + F.col("len")).alias("s"))
    out = first.unionByName(final).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return out.select("user_id", "side", "k", *[F.round(F.col(f"p{a}") + F.col("k") * 0.25 * F.col(f"d{a}"), 5).alias(a) for a in AXES], F.round(F.col("s") + F.col("side") * F.col("k") * 0.25, 5).alias("arc"))


@query(
    "MTH09",
    f"""WITH p AS ({_LINE_SQL}), q AS (SELECT user_id, i, x, y, coalesce(lag(x) OVER w, 2 * x - lead(x) OVER w) AS x0, coalesce(lag(y) OVER w, 2 * y - lead(y) OVER w) AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, coalesce(lead(x, 2) OVER w, 2 * lead(x) OVER w - x) AS x3, coalesce(lead(y, 2) OVER w, 2 * lead(y) OVER w - y) AS y3, count(*) OVER (PARTITION BY user_id) AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    t AS (SELECT *, greatest(sqrt(sqrt((x - x0) ** 2 + (y - y0) ** 2)), 1e-6) AS t1, greatest(sqrt(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 1e-6) AS d2, greatest(sqrt(sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)), 1e-6) AS d3 FROM q WHERE x2 IS NOT NULL AND n >= 3),
    u AS (SELECT *, t1 + d2 AS t2, t1 + d2 + d3 AS t3, t1 + d2 * j / 4.0 AS u FROM t, (SELECT unnest(generate_series(0, 3)) AS j)),
    a AS (SELECT *, (t1 - u) / t1 * x0 + u / t1 * x AS ax1, (t2 - u) / (t2 - t1) * x + (u - t1) / (t2 - t1) * x2 AS ax2, (t3 - u) / (t3 - t2) * x2 + (u - t2) / (t3 - t2) * x3 AS ax3, (t1 - u) / t1 * y0 + u / t1 * y AS ay1, (t2 - u) / (t2 - t1) * y + (u - t1) / (t2 - t1) * y2 AS ay2, (t3 - u) / (t3 - t2) * y2 + (u - t2) / (t3 - t2) * y3 AS ay3 FROM u),
    b AS (SELECT *, (t2 - u) / t2 * ax1 + u / t2 * ax2 AS bx1, (t3 - u) / (t3 - t1) * ax2 + (u - t1) / (t3 - t1) * ax3 AS bx2, (t2 - u) / t2 * ay1 + u / t2 * ay2 AS by1, (t3 - u) / (t3 - t1) * ay2 + (u - t1) / (t3 - t1) * ay3 AS by2 FROM a)
    SELECT user_id, i, j, round((t2 - u) / (t2 - t1) * bx1 + (u - t1) / (t2 - t1) * bx2, 4) AS x, round((t2 - u) / (t2 - t1) * by1 + (u - t1) / (t2 - t1) * by2, 4) AS y FROM b""",
)
def smooth_line(spark, sf_dir):
    """A centripetal spline through the points of each line of three or more, four points a segment."""
    w = Window.partitionBy("user_id").orderBy("i")
    at = {}
    for a in ("x", "y"):
        after = F.lead(a).over(w)
        at |= {f"{a}0": F.coalesce(F.lag(a).over(w), 2 * F.col(a) - after), f"{a}2": after, f"{a}3": F.coalesce(F.lead(a, 2).over(w), 2 * after - F.col(a))}
    rows = _polyline(spark, sf_dir).withColumns({**at, "n": F.count("*").over(Window.partitionBy("user_id"))}).filter("x2 is not null and n >= 3")
    gap = lambda p, q: F.greatest(F.sqrt(F.sqrt((F.col(f"x{p}") - F.col(f"x{q}")) ** 2 + (F.col(f"y{p}") - F.col(f"y{q}")) ** 2)), F.lit(1e-6))
    rows = rows.withColumns({"t1": gap("", "0"), "d2": gap("2", ""), "d3": gap("3", "2")}).withColumns({"t2": F.expr("t1 + d2"), "t3": F.expr("t1 + d2 + d3")})
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("u", F.expr("t1 + d2 * j / 4.0D"))
    u, t1, t2, t3 = (F.col(c) for c in ("u", "t1", "t2", "t3"))
    zero = F.lit(0.0)
    mix = lambda p, q, s, e: (e - u) / (e - s) * p + (u - s) / (e - s) * q

    def curve(a: str) -> Column:
        p = [F.col(f"{a}0"), F.col(a), F.col(f"{a}2"), F.col(f"{a}3")]
        a1, a2, a3 = mix(p[0], p[1], zero, t1), mix(p[1], p[2], t1, t2), mix(p[2], p[3], t2, t3)
        return mix(mix(a1, a2, zero, t2), mix(a2, a3, t1, t3), t1, t2)

    return rows.select("user_id", "i", "j", F.round(curve("x"), 4).alias("x"), F.round(curve("y"), 4).alias("y"))


@query("MTH07", "SELECT DISTINCT p_size, printf('#%02X%02X%02X', CAST(round_even(32 + (250 - 32) * t, 0) AS INTEGER), CAST(round_even(64 + (9 - 64) * t, 0) AS INTEGER), CAST(round_even(128 + (171 - 128) * t, 0) AS INTEGER)) AS colour FROM (SELECT p_size, (p_size - 1) / 49.0 AS t FROM part)")
def colour_ramp(spark, sf_dir):
    """The colour of each size on a straight line between two colours, halves rounded to even."""
    t = (F.col("p_size") - 1) / 49.0
    parts = [F.bround(a + (b - a) * t, 0).cast("int") for a, b in ((0x20, 0xFA), (0x40, 0x09), (0x80, 0xAB))]
    return table(spark, sf_dir, "part").select("p_size", F.format_string("#%02X%02X%02X", *parts).alias("colour")).distinct()


@query(
    "MTH12",
    f"""WITH {_SEGMENTS_SQL}, t AS (SELECT user_id, sum(len) / 2 AS arc FROM g GROUP BY user_id)
    SELECT user_id, round(arc, 4) AS arc, round(x + (x1 - x) * (arc - s) / len, 4) AS x, round(y + (y1 - y) * (arc - s) / len, 4) AS y, round(z + (z1 - z) * (arc - s) / len, 4) AS z, round((x1 - x) / len, 5) AS nx, round((y1 - y) / len, 5) AS ny, round((z1 - z) / len, 5) AS nz FROM g JOIN t USING (user_id) WHERE len > 0 AND s <= arc AND arc < s + len""",
)
def cut_planes(spark, sf_dir):
    """The plane across each line at half its arc: the point there and the unit tangent."""
    rows = _segments(_polyline(spark, sf_dir))
    arc = F.sum("len").over(Window.partitionBy("user_id")) / 2
    at = rows.withColumn("arc", arc).filter("len > 0 and s <= arc and arc < s + len")
    part = (F.col("arc") - F.col("s")) / F.col("len")
    point = [F.round(F.col(a) + (F.col(f"{a}1") - F.col(a)) * part, 4).alias(a) for a in AXES]
    return at.select("user_id", F.round("arc", 4).alias("arc"), *point, *[F.round((F.col(f"{a}1") - F.col(a)) / F.col("len"), 5).alias(f"n{a}") for a in AXES])


#: The points of a stated line, for projections onto it.
TRACK = ((0.0, 0.0), (15.0, 4.0), (30.0, 3.0), (52.0, 9.0))


def _track() -> list[tuple]:
    out, s = [], 0.0
    for (x0, y0), (x1, y1) in zip(TRACK, TRACK[1:]):
        size = math.hypot(x1 - x0, y1 - y0)
        out.append((x0, y0, x1 - x0, y1 - y0, size, s))
        s += size
    return out


@query(
    "JON44 JON19",
    f"""WITH t(x0, y0, dx, dy, len, s) AS (VALUES {", ".join(str(r) for r in _track())}), p AS (SELECT DISTINCT l_quantity AS x, round(l_discount * 100, 0) AS y FROM lineitem),
    m AS (SELECT p.x, p.y, least(greatest(((p.x - x0) * dx + (p.y - y0) * dy) / (len * len), 0), 1) AS t, t.* FROM p, t), d AS (SELECT x, y, s, s + t * len AS arc, (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 AS d2, (dx * (y - y0) - dy * (x - x0)) / len AS side FROM m)
    SELECT x, y, round(arg_min(arc, (round(d2, 9), round(arc, 6), s)), 5) AS arc, round(sqrt(min(d2)), 5) AS distance, round(arg_min(side, (round(d2, 9), round(arc, 6), s)), 5) AS side FROM d GROUP BY x, y""",
)
def arc_of_points(spark, sf_dir):
    """Each point's place on a stated line: arc, distance, and signed offset from the nearest segment."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y")).distinct()
    found = []
    for x0, y0, dx, dy, size, s in _track():
        x, y = F.col("x") - x0, F.col("y") - y0
        t = F.least(F.greatest((x * dx + y * dy) / (size * size), F.lit(0.0)), F.lit(1.0))
        d2 = (x - t * dx) ** 2 + (y - t * dy) ** 2
        found.append(F.struct(F.round(d2, 9).alias("r"), F.round(s + t * size, 6).alias("near"), F.lit(s).alias("s"), (s + t * size).alias("arc"), d2.alias("d2"), ((dx * y - dy * x) / size).alias("side")))
    best = p.withColumn("b", F.array_min(F.array(*found)))
    return best.select("x", "y", F.round("b.arc", 5).alias("arc"), F.round(F.sqrt("b.d2"), 5).alias("distance"), F.round("b.side", 5).alias("side"))


_CELLS = "SELECT DISTINCT p_size AS i, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS j, CAST(p_partkey % 6 AS INTEGER) AS k FROM part WHERE p_partkey % 13 < 4"


def _grid(spark, sf_dir):
    """A sparse set of cells of a three-dimensional grid."""
    return table(spark, sf_dir, "part").filter("p_partkey % 13 < 4").select(F.col("p_size").alias("i"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("j"), (F.col("p_partkey") % 6).cast("int").alias("k")).distinct()


@query(
    "AGG28 GEO03",
    f"""WITH RECURSIVE c AS (SELECT *, (i * 100 + j) * 10 + k AS id FROM ({_CELLS})), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.id <> b.id),
    r(n, m) AS (SELECT id, id FROM c UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), s AS (SELECT component, count(*) AS size FROM (SELECT n, min(m) AS component FROM r GROUP BY n) GROUP BY component)
    SELECT component, size FROM s WHERE size >= greatest(3, 0.02 * (SELECT max(size) FROM s))""",
)
def grid_components(spark, sf_dir):
    """Components of cells that touch in any of 26 directions, without those below a least size and a share of the largest."""
    cells = _grid(spark, sf_dir).withColumn("id", (F.col("i") * 100 + F.col("j")) * 10 + F.col("k"))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("k") + c).alias("k")) for a, b, c in steps]))
    edges = cells.select(F.col("id").alias("a"), around.alias("n")).select("a", "n.*").join(cells.withColumnRenamed("id", "b"), AXIS).select("a", "b")
    size = graphs.connected(cells.select("id"), edges, "id").groupBy("component").agg(F.count("*").alias("size"))
    most = size.agg(F.max("size").alias("most"))
    return size.crossJoin(F.broadcast(most)).filter(F.col("size") >= F.greatest(F.lit(3), 0.02 * F.col("most"))).select("component", "size")


@query(
    "GEO02",
    f"""WITH c AS ({_CELLS}), g AS (SELECT i, j, k, EXISTS (SELECT 1 FROM c WHERE c.i = a.i AND c.j = b.j AND c.k = d.k) AS inside FROM (SELECT unnest(generate_series(0, 51)) AS i) a, (SELECT unnest(generate_series(0, 26)) AS j) b, (SELECT unnest(generate_series(-1, 6)) AS k) d),
    m AS (SELECT a.i, a.j, a.k, a.inside, min((a.i - b.i) ** 2 + (a.j - b.j) ** 2 + (a.k - b.k) ** 2) AS d2 FROM g a JOIN g b ON a.inside <> b.inside GROUP BY ALL)
    SELECT i, j, k, round(CASE WHEN inside THEN -sqrt(d2) ELSE sqrt(d2) END, 6) AS distance FROM m""",
)
def distance_field(spark, sf_dir):
    """The distance of each cell of a box to the nearest cell of the other side of a boundary, negative inside."""
    held = _grid(spark, sf_dir).withColumn("inside", F.lit(True))
    box = spark.range(0, 52 * 27 * 8).select((F.col("id") % 52).cast("int").alias("i"), (F.floor(F.col("id") / 52) % 27).cast("int").alias("j"), (F.floor(F.col("id") / (52 * 27)) - 1).cast("int").alias("k"), "id")
    g = box.join(held, AXIS, "left").withColumn("inside", F.coalesce("inside", F.lit(False))).select("id", *AXIS, *[F.col(a).cast("double").alias(f"c_{a}") for a in AXIS], "inside")
    axes = [f"c_{a}" for a in AXIS]
    side = lambda yes: g.filter(F.col("inside") if yes else ~F.col("inside"))
    other = lambda yes: spatial.nearest(side(yes).select("id", *axes), side(not yes).select(F.col("id").alias("ref"), *axes), "id", "ref", axes).select("id", (F.col("distance") * (-1 if yes else 1)).alias("d"))
    return g.join(other(True).unionByName(other(False)), "id").select(*AXIS, F.round("d", 6).alias("distance"))


#: Corners of the faces of a shell, turned outwards: the last four corners make a second shell.
FACES = ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3), (4, 6, 5), (4, 5, 7), (4, 7, 6), (5, 6, 7))


def _corner(n: str, shift: str, size: str, brand: str) -> str:
    return f"CASE {n} % 4 WHEN 1 THEN [{shift} + {size}, 0.0, 0.0] WHEN 2 THEN [{shift}, {brand}, 0.0] WHEN 3 THEN [{shift}, 0.0, 3.0] ELSE [{shift}, 0.0, 0.0] END"


@query(
    "AGG38",
    f"""WITH m AS (SELECT p_partkey AS mesh, CAST(p_size AS DOUBLE) AS size, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS brand FROM part), f(face, a, b, c) AS (VALUES {", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(FACES))}),
    t AS (SELECT mesh, face, a, b, c, a // 4 AS shell, {_corner("a", "(a // 4) * 100.0", "size", "brand")} AS p, {_corner("b", "(b // 4) * 100.0", "size", "brand")} AS q, {_corner("c", "(c // 4) * 100.0", "size", "brand")} AS r FROM m, f WHERE NOT (mesh % 7 = 0 AND face = 5)),
    o AS (SELECT *, [avg(p[1] + q[1] + r[1]) OVER w / 3, avg(p[2] + q[2] + r[2]) OVER w / 3, avg(p[3] + q[3] + r[3]) OVER w / 3] AS o FROM t WINDOW w AS (PARTITION BY mesh, shell)),
    v AS (SELECT mesh, shell, ((p[1] - o[1]) * ((q[2] - o[2]) * (r[3] - o[3]) - (q[3] - o[3]) * (r[2] - o[2])) - (p[2] - o[2]) * ((q[1] - o[1]) * (r[3] - o[3]) - (q[3] - o[3]) * (r[1] - o[1])) + (p[3] - o[3]) * ((q[1] - o[1]) * (r[2] - o[2]) - (q[2] - o[2]) * (r[1] - o[1]))) / 6 AS v,
      sqrt(((q[2] - p[2]) * (r[3] - p[3]) - (q[3] - p[3]) * (r[2] - p[2])) ** 2 + ((q[3] - p[3]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[3] - p[3])) ** 2 + ((q[1] - p[1]) * (r[2] - p[2]) - (q[2] - p[2]) * (r[1] - p[1])) ** 2) / 2 AS s FROM o),
    e AS (SELECT mesh, shell, count(*) AS open FROM (SELECT mesh, shell, x, y FROM (SELECT mesh, shell, unnest([least(a, b), least(b, c), least(a, c)]) AS x, unnest([greatest(a, b), greatest(b, c), greatest(a, c)]) AS y FROM t) GROUP BY ALL HAVING count(*) = 1) GROUP BY mesh, shell)
    SELECT mesh, mesh * 10 + shell * 4 AS shell, count(*) AS faces, round(sum(v), 4) AS volume, round(sum(s), 4) AS area, coalesce(any_value(open), 0) = 0 AND count(*) >= 4 AS closed FROM v LEFT JOIN e USING (mesh, shell) GROUP BY mesh, v.shell""",
)
def shell_volumes(spark, sf_dir):
    """Shells of faces that share edges: signed volume about the shell's centre, area, and whether no edge is open.

    Every table grows with the faces, so that no side of a join is broadcast.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh"), F.col("p_size").cast("double").alias("size"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("brand"))
    face = F.explode(F.array(*[F.struct(F.lit(i).alias("face"), *[F.lit(v).alias(n) for n, v in zip("abc", f)]) for i, f in enumerate(FACES)]))
    faces = part.withColumn("f", face).select("mesh", "size", "brand", "f.*").filter("not (mesh % 7 = 0 and face = 5)").withColumn("id", F.col("mesh") * 10 + F.col("face"))
    edge = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))]))
    edges = faces.select("mesh", "id", edge.alias("e")).select("mesh", "id", "e.*").groupBy("mesh", "u", "v").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    groups = graphs.connected(faces.select("id"), edges.filter("n > 1").select("a", "b"), "id").withColumnRenamed("component", "shell").hint("merge")
    open_ = edges.filter("n = 1").join(groups.withColumnRenamed("id", "a"), "a").groupBy("shell").agg(F.count("*").alias("open"))

    def corner(n: str) -> list[Column]:
        shift = F.floor(F.col(n) / 4) * 100.0
        at = F.col(n) % 4
        return [F.when(at == 1, shift + F.col("size")).otherwise(shift), F.when(at == 2, F.col("brand")).otherwise(F.lit(0.0)), F.when(at == 3, F.lit(3.0)).otherwise(F.lit(0.0))]

    rows = faces.select("id", "mesh", *[c.alias(f"{n}{x}") for n in "abc" for x, c in zip(AXES, corner(n))]).join(groups, "id")
    centre = rows.groupBy("shell").agg(*[(F.avg(sum(F.col(f"{n}{x}") for n in "abc")) / 3).alias(f"o{x}") for x in AXES])
    rows = rows.join(centre.hint("merge"), "shell")
    less = lambda n, m: [F.col(f"{n}{x}") - F.col(f"{m}{x}") for x in AXES]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    volume = sum(p * q for p, q in zip(less("a", "o"), cross(less("b", "o"), less("c", "o")))) / 6
    area = F.sqrt(sum(x * x for x in cross(less("b", "a"), less("c", "a")))) / 2
    got = rows.groupBy("mesh", "shell").agg(F.count("*").alias("faces"), F.round(F.sum(volume), 4).alias("volume"), F.round(F.sum(area), 4).alias("area"))
    return got.join(open_.hint("merge"), "shell", "left").select("mesh", "shell", "faces", "volume", "area", ((F.coalesce("open", F.lit(0)) == 0) & (F.col("faces") >= 4)).alias("closed"))


@query("SET08 MTH02", "SELECT l_returnflag, min(lo) AS lo, max(hi) AS hi, min(jlo) AS jlo, max(jhi) AS jhi FROM (SELECT l_returnflag, l_linestatus, l_linenumber, min(l_quantity) - 0.5 AS lo, max(l_quantity) + 0.5 AS hi, min(l_discount) * 100 - 0.5 AS jlo, max(l_discount) * 100 + 0.5 AS jhi FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def box_union(spark, sf_dir):
    """The box around the boxes of several grids, each with half a cell around its points."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber")
    boxes = rows.agg((F.min("l_quantity") - 0.5).alias("lo"), (F.max("l_quantity") + 0.5).alias("hi"), (F.min("l_discount") * 100 - 0.5).alias("jlo"), (F.max("l_discount") * 100 + 0.5).alias("jhi"))
    return boxes.groupBy("l_returnflag").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("jlo").alias("jlo"), F.max("jhi").alias("jhi"))


@query(
    "SRC30",
    """WITH v AS (SELECT label AS mesh, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    n AS (SELECT DISTINCT label AS mesh, 1.0 + label AS s, label / 2.0 AS t FROM embeddings WHERE label % 5 <> 4),
    w AS (SELECT v.mesh, coalesce(s, 1) * x + coalesce(t, 0) AS x, y - coalesce(t, 0) * z AS y, z + coalesce(s, 0) AS z FROM v LEFT JOIN n USING (mesh))
    SELECT mesh, count(*) AS vertices, count(*) // 3 AS triangles, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM w GROUP BY mesh""",
)
def mesh_bounds(spark, sf_dir):
    """Counts and the box in the world of each mesh, whose node's matrix places its vertices; without a node they stay."""
    e = table(spark, sf_dir, "embeddings")
    vertices = e.select(F.col("label").alias("mesh"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    half = F.col("label") / 2.0
    rows = [[1.0 + F.col("label"), F.lit(0.0), F.lit(0.0), half], [F.lit(0.0), F.lit(1.0), -half, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0), 1.0 + F.col("label")]]
    nodes = e.filter("label % 5 <> 4").select(F.col("label").alias("mesh"), F.array(*[F.array(*r) for r in rows]).alias("matrix")).distinct()
    point = [F.col(a) for a in "xyz"]
    placed = lambda r: sum((F.col("matrix")[r][i] * p for i, p in enumerate(point)), F.col("matrix")[r][3])
    world = vertices.join(nodes, "mesh", "left").select("mesh", *[F.when(F.col("matrix").isNull(), p).otherwise(placed(r)).alias(a) for r, (a, p) in enumerate(zip("xyz", point))])
    box = [F.round(f(a), 6).alias(f"{name}_{a}") for a in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return world.groupBy("mesh").agg(F.count("*").alias("vertices"), F.floor(F.count("*") / 3).alias("triangles"), *box)
