"""Grids, affine maps, nearest neighbours, interpolation and components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import graphs, spatial
from strataloom.plans.registry import query
from strataloom.sources.tables import table

AXES = ["x", "y", "z"]


def _points(spark, sf_dir):
    """Line items as points: quantity, discount and tax on comparable scales."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


@query(
    "JON19 JON20",
    """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS ref, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM v a, v b WHERE a.label % 2 = 0 AND b.label % 2 = 1)
    SELECT vec_id, arg_min(ref, (d, ref)) AS ref, round(min(d), 6) AS distance FROM p GROUP BY vec_id""",
)
def nearest_vector(spark, sf_dir):
    """The nearest point of the other half for every point (of the first three components), however far it is."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(AXES)])
    refs = v.filter("label % 2 = 1").withColumnRenamed("vec_id", "ref")
    near = spatial.nearest(v.filter("label % 2 = 0"), refs, "vec_id", "ref", AXES)
    return near.select("vec_id", "ref", F.round("distance", 6).alias("distance"))


@query(
    "JON21 JON43",
    """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
    SELECT a.label, count(*) AS pairs, count(DISTINCT a.vec_id) AS points FROM v a JOIN v b ON a.label <> b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.05 GROUP BY a.label""",
)
def radius_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(AXES)])
    near = spatial.radius_pairs(v, v.withColumnRenamed("vec_id", "other"), "vec_id", "other", AXES, 0.05)
    labels = v.select("vec_id", "label")
    both = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("other"), F.col("label").alias("l2")), "other").filter("label <> l2")
    return both.groupBy("label").agg(F.count("*").alias("pairs"), F.countDistinct("vec_id").alias("points"))


@query(
    "AGG28",
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey * 100 + CAST(c_custkey % 20 AS INTEGER) AS a, c_nationkey * 100 + CAST((c_custkey * 7) % 20 AS INTEGER) AS b FROM customer WHERE c_acctbal < 0),
    bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM bi UNION SELECT r.n, bi.b FROM r JOIN bi ON bi.a = r.m)
    SELECT component, count(*) AS size FROM (SELECT n, min(m) AS component FROM r GROUP BY n) GROUP BY component""",
)
def component_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    base = F.col("c_nationkey") * 100
    edges = c.select((base + (F.col("c_custkey") % 20).cast("int")).alias("a"), (base + ((F.col("c_custkey") * 7) % 20).cast("int")).alias("b")).distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return graphs.connected(nodes, edges, "node").groupBy("component").agg(F.count("*").alias("size"))


@query(
    "JON25 MTH01 MTH02 FLT05 AGG39",
    """WITH g AS (SELECT CAST(round_even((l_quantity - 1.0) / 2.0, 0) AS INTEGER) AS i, CAST(round_even(l_discount * 100 / 1.5, 0) AS INTEGER) AS j FROM lineitem), lut AS (SELECT p_size % 25 AS i, p_size // 8 AS j, max(p_partkey) AS label FROM part GROUP BY 1, 2)
    SELECT i, j, label, count(*) AS n FROM g LEFT JOIN lut USING (i, j) WHERE i BETWEEN 2 AND 20 GROUP BY i, j, label""",
)
def cell_lookup(spark, sf_dir):
    """Points to cells by an affine map, half-even rounding, then labels by cell; an inclusive slab on one axis."""
    at = spatial.affine([(F.col("l_quantity") - 1.0) / 2.0, F.col("l_discount") * 100 / 1.5], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    cell = [F.rint(a).cast("int").alias(n) for a, n in zip(at, "ij")]
    grid = table(spark, sf_dir, "lineitem").select(*cell)
    lut = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 25).alias("i"), F.floor(F.col("p_size") / 8).cast("int").alias("j")).agg(F.max("p_partkey").alias("label"))
    return grid.filter("i between 2 and 20").join(lut, ["i", "j"], "left").groupBy("i", "j", "label").agg(F.count("*").alias("n"))


@query(
    "JON27 JON26 GEO08",
    """WITH g AS (SELECT CAST(floor(l_quantity) AS INTEGER) AS i, l_linenumber AS j, CAST(floor(l_tax * 100) AS INTEGER) AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
    p AS (SELECT p_partkey, p_size * 0.9 + 0.25 AS x, 1 + p_size % 6 + 0.5 AS y, p_size % 8 + 0.75 AS z FROM part),
    c AS (SELECT p_partkey, CAST(floor(x) AS INTEGER) + a.s AS i, CAST(floor(y) AS INTEGER) + b.s AS j, CAST(floor(z) AS INTEGER) + d.s AS k,
      (CASE a.s WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b.s WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE d.s WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w
      FROM p, (VALUES (0), (1)) a(s), (VALUES (0), (1)) b(s), (VALUES (0), (1)) d(s))
    SELECT p_partkey, round(sum(w * coalesce(v, 0)), 8) AS value FROM c LEFT JOIN g USING (i, j, k) GROUP BY p_partkey""",
)
def trilinear(spark, sf_dir):
    """A value between grid cells from the eight around it; cells outside count as 0."""
    lines = table(spark, sf_dir, "lineitem")
    grid = lines.groupBy(F.floor("l_quantity").cast("int").alias("i"), F.col("l_linenumber").alias("j"), F.floor(F.col("l_tax") * 100).cast("int").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    point = [F.col("p_size") * 0.9 + 0.25, 1 + F.col("p_size") % 6 + 0.5, F.col("p_size") % 8 + 0.75]
    around = table(spark, sf_dir, "part").select("p_partkey", F.inline(spatial.corners(point)))
    return around.join(grid, ["i", "j", "k"], "left").groupBy("p_partkey").agg(F.round(F.sum(F.col("weight") * F.coalesce("v", F.lit(0.0))), 8).alias("value"))


@query(
    "JON32 FLT16 FLT24",
    """WITH s(x0, y0, x1, y1) AS (VALUES (0.0, 0.0, 20.0, 4.0), (20.0, 4.0, 30.0, 10.0), (30.0, 10.0, 50.0, 0.0)),
    d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount * 100 AS y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, least(greatest(((l_quantity - x0) * (x1 - x0) + (l_discount * 100 - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0), 1) AS t FROM lineitem, s)
    SELECT l_orderkey, l_linenumber, l_partkey, x, round(min(sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2)), 6) AS distance FROM d GROUP BY 1, 2, 3, 4""",
)
def polyline_distance(spark, sf_dir):
    """The least distance to a polyline given as parameters: one expression a row, no join."""
    knots = [(0.0, 0.0), (20.0, 4.0), (30.0, 10.0), (50.0, 0.0)]
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    each = []
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        dx, dy = x1 - x0, y1 - y0
        t = F.least(F.greatest(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        each.append(F.sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"), F.least(*each).alias("d"))
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "x").agg(F.round(F.min("d"), 6).alias("distance"))


_GRID = "WITH g AS (SELECT DISTINCT CAST(floor(l_quantity) AS BIGINT) AS u, CAST(floor(l_extendedprice / 1500) AS BIGINT) AS v FROM lineitem WHERE l_discount > 0.07)"


def _grid(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_discount > 0.07")
    return lines.select(F.floor("l_quantity").alias("u"), F.floor(F.col("l_extendedprice") / 1500).alias("v")).distinct()


@query(
    "JON41 JON45",
    _GRID + " SELECT u, v FROM g WHERE NOT (EXISTS (SELECT 1 FROM g b WHERE b.u = g.u + 1 AND b.v = g.v) AND EXISTS (SELECT 1 FROM g b WHERE b.u = g.u - 1 AND b.v = g.v) AND EXISTS (SELECT 1 FROM g b WHERE b.u = g.u AND b.v = g.v + 1) AND EXISTS (SELECT 1 FROM g b WHERE b.u = g.u AND b.v = g.v - 1))",
)
def neighbour_edges(spark, sf_dir):
    """Cells of a set with a neighbour outside it."""
    grid = _grid(spark, sf_dir)
    return grid.join(spatial.erode(grid, ["u", "v"]), ["u", "v"], "left_anti")


@query(
    "GEO05 GEO07",
    _GRID + """, d AS (SELECT DISTINCT u + a AS u, v + b AS v FROM g, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)),
    c AS (SELECT d.u, d.v FROM d WHERE (SELECT count(*) FROM d n WHERE (n.u = d.u AND abs(n.v - d.v) = 1) OR (n.v = d.v AND abs(n.u - d.u) = 1)) = 4) SELECT u, v, NOT EXISTS (SELECT 1 FROM g WHERE g.u = c.u AND g.v = c.v) AS filled FROM c""",
)
def closing(spark, sf_dir):
    """Morphological closing of a set of cells, telling the filled ones."""
    grid = _grid(spark, sf_dir)
    closed = spatial.erode(spatial.dilate(grid, ["u", "v"]), ["u", "v"])
    return closed.join(grid.withColumn("own", F.lit(True)), ["u", "v"], "left").select("u", "v", F.col("own").isNull().alias("filled"))


@query("FLT23 MTH08", "SELECT l_returnflag, count(*) AS n, round(cbrt(sum(l_tax) * 3 / (4 * pi())), 6) AS axis FROM lineitem WHERE ((l_quantity - 25) / 12) ** 2 + ((l_discount * 100 - 5) / 3) ** 2 + ((l_tax * 100 - 4) / 4) ** 2 <= 1 GROUP BY 1")
def ellipsoid_members(spark, sf_dir):
    inside = ((F.col("l_quantity") - 25) / 12) ** 2 + ((F.col("l_discount") * 100 - 5) / 3) ** 2 + ((F.col("l_tax") * 100 - 4) / 4) ** 2 <= 1
    return table(spark, sf_dir, "lineitem").filter(inside).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.cbrt(F.sum("l_tax") * 3 / (4 * F.pi())), 6).alias("axis"))


@query(
    "FLT06 GEO16 AGG43",
    "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice < 50000, abs(o_totalprice - 100000), o_orderkey)) AS picked FROM orders WHERE o_totalprice BETWEEN 20000 AND 200000 GROUP BY o_custkey",
)
def pick_nearest(spark, sf_dir):
    """The nearest hit, solid ones before translucent ones."""
    order = F.struct((F.col("o_totalprice") < 50000).alias("t"), F.abs(F.col("o_totalprice") - 100000).alias("d"), "o_orderkey")
    return table(spark, sf_dir, "orders").filter("o_totalprice between 20000 and 200000").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("picked"))
