"""Integrity checks as relations of violations: an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task groups, at some 200 bytes each.
TASK_ROWS = 1 << 19


def missing_keys(facts: DataFrame, keys: DataFrame, key: str, ref: str) -> DataFrame:
    """Rows of facts whose key no row of keys has; a null key is a violation."""
    return facts.join(keys.select(F.col(ref).alias("__ref")).distinct(), F.col(key) == F.col("__ref"), "left_anti")


def unused_keys(keys: DataFrame, facts: DataFrame, key: str, ref: str) -> DataFrame:
    return missing_keys(keys, facts, key, ref)


def missing_counts(facts: DataFrame, refs: DataFrame, *keys: str) -> DataFrame:
    """Each key of facts that no row of refs has, with its number of rows n; a null in a key is a violation.

    Both sides meet in one grouping, without a sort of either.  Its tasks are as many as the rows
    ask for, whatever the session would merge, so one task's memory stays when the tables grow.
    """
    own, known = facts.select(*keys, F.lit(True).alias("own")), refs.select(*keys, F.lit(False).alias("own"))
    tasks = max(1, -(-own.union(known).count() // TASK_ROWS))
    groups = own.union(known.dropna()).repartition(tasks, *keys).groupBy(*keys)
    return groups.agg(F.count_if("own").alias("n"), F.bool_and("own").alias("missing")).filter("missing").drop("missing")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def broken_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule, a predicate that must hold, that is false or null."""
    found = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(found).alias("rule"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two relations on the same keys that are missing on a side or differ."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), keys, "full_outer")
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unknown").when(~F.col("a").eqNullSafe(F.col("b")), "stale")
    return both.withColumn("state", state).filter(F.col("state").isNotNull()).select(*keys, "state")


def thresholds(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metrics (metric, value) against limits (metric, low, high): pass, fail or unmeasured, one row per limit."""
    ok = F.when(F.col("value").isNull(), "unmeasured").when(F.col("value").between(F.col("low"), F.col("high")), "pass").otherwise("fail")
    return limits.join(metrics, "metric", "left").select("metric", "value", ok.alias("result"))
