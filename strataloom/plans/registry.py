"""All queries of the library outside the corpus subpackage.

A plan module registers functions (spark, sf_dir) -> DataFrame with the
inventory rows they stand for and, where SQL can say the same, DuckDB SQL.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PLANS = ("aggregates", "gates", "geometry", "integrity", "joins", "linkage", "ordered", "overrides", "plugins", "records", "resampling", "rules", "search", "spatial", "state", "texts", "writing")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    rows: tuple[str, ...]
    sql: str | None


_FOUND: dict[str, Query] = {}


def query(rows: str, sql: str | None = None):
    """Register a function under its name; rows: the inventory ids, by spaces."""

    def keep(run):
        if run.__name__ in _FOUND and _FOUND[run.__name__].run.__module__ != run.__module__:
            raise ValueError(f"two queries are named {run.__name__}")
        _FOUND[run.__name__] = Query(run, tuple(rows.split()), sql)
        return run

    return keep


def found() -> dict[str, Query]:
    for name in PLANS:
        importlib.import_module(f"strataloom.plans.{name}")
    return dict(_FOUND)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in found().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in found().items() if q.sql}
