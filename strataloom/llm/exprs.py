"""Small building blocks for expressions that run row by row inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLOCK = 256


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that docs does not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it in a loop."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """For each element the sum of it and all before it, by blocks: n * BLOCK + (n / BLOCK)**2 steps."""

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        pieces = F.transform(numbers, lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return let(pieces, inner)

    def inner(p: Column) -> Column:
        sums = F.transform(p, total)
        return let(sums, lambda s: F.flatten(F.transform(p, lambda piece, k: let(total(F.slice(s, F.lit(1), k)), lambda base: F.transform(piece, lambda _, i: base + total(F.slice(piece, F.lit(1), i + 1)))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(blocks(v)))
