"""Registered regions and anchor kinds over the points of line items, each in one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import plugins
from strataloom.plans.registry import query
from strataloom.sources.tables import table

AXES = ["x", "y", "z"]
_POINTS_SQL = "SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_suppkey AS label, l_extendedprice / 1000 AS level FROM lineitem"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), F.col("l_suppkey").alias("label"), (F.col("l_extendedprice") / 1000).alias("level")
    )


def regions() -> plugins.Registry:
    """A slab, a half space and a ball, each with its checks."""
    r = plugins.standard()
    r.region("slab", ("low", lambda at: at["x"] < 12), ("central", lambda at: at["y"] > 6))(lambda margin: F.col("x").between(5 + margin, 15 - margin))
    r.region("half", ("beyond", lambda at: at["x"] > 25))(lambda margin: 2 * F.col("x") + F.col("y") - F.col("z") > 60 + margin)
    r.region("ball", ("wide", lambda at: at["n"] > 10**9), least=20)(lambda margin: (F.col("x") - 25) ** 2 + (F.col("y") - 5) ** 2 + (F.col("z") - 4) ** 2 <= (4 - margin) ** 2)
    r.region("nowhere", ("never", lambda at: at["x"] > 0))(lambda margin: F.col("x") < -1)
    return r


def anchor_kinds() -> plugins.Registry:
    """Rows by label, by level, by a mask of two sides; a fourth kind shows that registering is all it takes."""
    r = plugins.standard()
    r.kind("labels")(lambda labels: F.col("label").isin(*labels))
    r.kind("level")(lambda threshold=0.5: F.col("level") >= threshold)
    r.kind("mask")(lambda side, threshold: (F.col("level") >= threshold) & (F.col("x") < 25 if side == "l" else F.col("x") >= 25))
    r.kind("shell")(lambda inner, outer: F.sqrt((F.col("x") - 25) ** 2 + (F.col("y") - 5) ** 2).between(inner, outer))
    return r


SOURCES = {
    "a": {"kind": "labels", "labels": (1, 3, 5), "rules": {"x": "min", "z": "middle"}},
    "b": {"kind": "level", "threshold": 60.0, "rules": {"y": "max"}},
    "c": {"kind": "mask", "side": "l", "threshold": 20.0, "rules": {"x": "quarter"}},
    "d": {"kind": "shell", "inner": 3.0, "outer": 9.0},
}


def _region_sql(name: str, inside: str, checks: dict[str, str], least: int = 1) -> str:
    failed = ", ".join(f"CASE WHEN n >= {least} AND NOT coalesce({c}, false) THEN '{k}' END" for k, c in checks.items())
    return f"SELECT '{name}' AS region, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, concat_ws(',', CASE WHEN n < {least} THEN 'rows' END, {failed}) AS failed FROM (SELECT count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p WHERE {inside})"


@query(
    "UDF01",
    f"WITH p AS ({_POINTS_SQL}) "
    + " UNION ALL ".join(
        [
            _region_sql("slab", "x BETWEEN 5.5 AND 14.5", {"low": "x < 12", "central": "y > 6"}),
            _region_sql("half", "2 * x + y - z > 60.5", {"beyond": "x > 25"}),
            _region_sql("ball", "(x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 <= 12.25", {"wide": "n > 1000000000"}, 20),
            _region_sql("nowhere", "x < -1", {"never": "x > 0"}),
        ]
    ),
)
def plugin_regions(spark, sf_dir):
    """Registered regions with their centroids and the checks that do not hold, in one scan whatever is registered."""
    found = regions().select(_points(spark, sf_dir), AXES, margin=0.5)
    return found.select("region", "n", *[F.round(a, 6).alias(a) for a in AXES], "failed")


@query(
    "UDF02 AGG21",
    f"""WITH p AS ({_POINTS_SQL}), a AS (SELECT 'a' AS anchor, count(*) AS n, min(x) AS x, avg(y) AS y, (min(z) + max(z)) / 2 AS z FROM p WHERE label IN (1, 3, 5)
    UNION ALL SELECT 'b', count(*), avg(x), max(y), avg(z) FROM p WHERE level >= 60 UNION ALL SELECT 'c', count(*), min(x) + 0.25 * (max(x) - min(x)), avg(y), avg(z) FROM p WHERE level >= 20 AND x < 25
    UNION ALL SELECT 'd', count(*), avg(x), avg(y), avg(z) FROM p WHERE sqrt((x - 25) ** 2 + (y - 5) ** 2) BETWEEN 3 AND 9) SELECT anchor, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM a""",
)
def plugin_anchors(spark, sf_dir):
    """Places of anchors whose kinds and rules are registered, in one scan."""
    found = anchor_kinds().anchors(_points(spark, sf_dir), SOURCES, AXES)
    return found.select("anchor", "n", *[F.round(a, 6).alias(a) for a in AXES])
