"""Regions and anchors by registration: plug-ins make expressions, and all of them run in one pass.

A region is a predicate over rows with named checks on what it selects; an anchor
kind makes a predicate of a source's settings, and a rule says which place of the
rows it selects is meant.  Whatever is registered, a table is scanned once: each
plug-in becomes conditional aggregates of one aggregation, and checks are
expressions over its one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """``inside`` picks rows; each check is (label, condition over n and the centroid's columns)."""

    inside: Callable[..., Column]
    checks: tuple[tuple[str, Callable[[dict[str, Column]], Column]], ...] = ()
    least: int = 1


@dataclass
class Registry:
    """Plug-ins by name; a name is given once."""

    regions: dict[str, Region] = field(default_factory=dict)
    kinds: dict[str, Callable[..., Column]] = field(default_factory=dict)
    rules: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def region(self, name: str, *checks, least: int = 1):
        return lambda f: self._put(self.regions, name, Region(f, tuple(checks), least)) and f

    def kind(self, name: str):
        """A function of a source's settings that makes the predicate of its rows."""
        return lambda f: self._put(self.kinds, name, f) and f

    def rule(self, name: str):
        """A function (value, predicate) that makes the aggregate of a place."""
        return lambda f: self._put(self.rules, name, f) and f

    @staticmethod
    def _put(held: dict, name: str, made):
        if name in held:
            raise ValueError(f"{name} is registered already")
        held[name] = made
        return made

    def select(self, rows: DataFrame, axes: list[str], **context) -> DataFrame:
        """(region, n, axes, failed) for every region: rows inside, their centroid, and labels of the checks that do not hold.

        ``context`` goes to each region's predicate.  A region of fewer than its
        least rows fails the check "rows" and no other; a check that is null fails.
        """
        if not self.regions:
            raise ValueError("no region is registered")
        measures = []
        for name, r in self.regions.items():
            inside = r.inside(**context)
            measures.append(F.struct(F.lit(name).alias("region"), F.count_if(inside).alias("n"), *[F.avg(F.when(inside, F.col(a))).alias(a) for a in axes]).alias(name))
        one = rows.agg(*measures)
        told = []
        for name, r in self.regions.items():
            at = {c: F.col(f"`{name}`.`{c}`") for c in ("n", *axes)}
            few = at["n"] < r.least
            failed = [F.when(~few & ~F.coalesce(condition(at), F.lit(False)), F.lit(label)) for label, condition in r.checks]
            labels = F.array_compact(F.array(F.when(few, F.lit("rows")), *failed))
            told.append(F.struct(F.lit(name).alias("region"), at["n"].alias("n"), *[at[a].alias(a) for a in axes], F.array_join(labels, ",").alias("failed")))
        return one.select(F.inline(F.array(*told)))

    def anchors(self, rows: DataFrame, sources: dict[str, dict], axes: list[str]) -> DataFrame:
        """(anchor, n, axes) of named sources: each has a kind, that kind's settings, and a rule for each axis (centroid if not named)."""
        measures = []
        for name, source in sources.items():
            settings = {k: v for k, v in source.items() if k not in ("kind", "rules")}
            if source["kind"] not in self.kinds:
                raise ValueError(f"{name}: unknown kind {source['kind']!r}")
            inside = self.kinds[source["kind"]](**settings)
            rules = source.get("rules", {})
            unknown = {r for r in rules.values() if r not in self.rules}
            if unknown:
                raise ValueError(f"{name}: unknown rules {sorted(unknown)}")
            places = [self.rules[rules.get(a, "centroid")](F.col(a), inside).alias(a) for a in axes]
            measures.append(F.struct(F.lit(name).alias("anchor"), F.count_if(inside).alias("n"), *places).alias(name))
        return rows.agg(*measures).select(F.inline(F.array(*[F.col(f"`{n}`") for n in sources])))


def standard() -> Registry:
    """A registry with the rules for places, and no regions or kinds."""
    r = Registry()
    of = lambda f: lambda value, inside: f(F.when(inside, value))
    for name, f in (("centroid", F.avg), ("min", F.min), ("max", F.max)):
        r.rule(name)(of(f))
    r.rule("middle")(lambda value, inside: (F.min(F.when(inside, value)) + F.max(F.when(inside, value))) / 2)
    r.rule("quarter")(lambda value, inside: F.min(F.when(inside, value)) + 0.25 * (F.max(F.when(inside, value)) - F.min(F.when(inside, value))))
    return r
