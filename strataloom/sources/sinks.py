"""Writers that gate, carry over, upsert and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A relation of violations was not empty."""


def gated(rows: DataFrame, violations: DataFrame, path: str) -> None:
    """Write rows only if there are no violations; the gate is evaluated first."""
    some = violations.limit(5).collect()
    if some:
        raise GateError(f"not written: {some}")
    rows.write.mode("overwrite").parquet(path)


def bundle(rows: DataFrame, path: str, *by: str) -> None:
    """One folder for each edition, language or batch."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that are not in old or differ from it, null-safely."""
    names = [c for c in new.columns if c != key]
    before = old.select(F.col(key), F.struct(*names).alias("__old"))
    both = new.join(before, key, "left")
    return both.filter(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.struct(*names))).select(*new.columns)


def carried_over(report: DataFrame, previous: DataFrame, key: str, column: str) -> DataFrame:
    """A new report with a reviewer's column from the previous one, empty where there was none."""
    return report.join(previous.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("")))


def verified_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("verified") & (F.col("title") != "") & (F.size("authors") > 0))


def linear(i, j, k, dims: tuple[int, int, int]):
    """The place of a cell in an x-fastest volume."""
    return i + dims[0] * (j + dims[1] * k)
