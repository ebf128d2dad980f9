"""Operators on ordered rows: numbering by ranges, and state carried through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import durable, ship


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a number from 1, without gaps, in ``order``, which must be total.

    Rows are dealt out by ranges and numbered within them; one count a range
    gives each its first number.
    """
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = durable(rows.repartitionByRange(count, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return ranges.withColumn("__i", local).join(F.broadcast(sizes.drop("__n")), "__part").withColumn(name, F.col("__base") + F.col("__i")).drop("__part", "__i", "__base")


def streamed(rows: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Pass the rows of each key in order through ``step``, a factory of (row -> output row) with its own state.

    Keys are dealt out by hash and rows sorted within partitions, so a key
    streams through in batches and is never held as a whole.
    """
    ship(rows.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, advance, first = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[key] != known:
                    known, advance, first = row[key], step(), False
                out.append(advance(row))
            if out:
                yield pa.RecordBatch.from_pylist([{n: o[n] for n in names} for o in out], schema=_arrow(schema))

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(count, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def budget(size: str, most: int) -> Callable:
    """Batch numbers: a row that would carry the sum of the batch over ``most`` opens the next one."""

    def start():
        state = {"batch": 0, "total": None}

        def advance(row: dict) -> dict:
            n = row[size] or 0
            if state["total"] is not None and state["total"] + n > most:
                state["batch"] += 1
                state["total"] = n
            else:
                state["total"] = (state["total"] or 0) + n
            return {**row, "batch": state["batch"]}

        return advance

    return start


def parents(depth: str, key: str) -> Callable:
    """The key of the last earlier row with a smaller depth, or null."""

    def start():
        stack: list[tuple] = []

        def advance(row: dict) -> dict:
            while stack and stack[-1][0] >= row[depth]:
                stack.pop()
            out = {**row, "parent": stack[-1][1] if stack else None}
            stack.append((row[depth], row[key]))
            return out

        return advance

    return start
