"""Row numbers over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import durable


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: their place from 0 in ``order`` (nulls first; rows equal in it in any order).

    Rows are cut into as many ranges as the session has shuffle partitions, each is
    numbered by itself, and one row a range says how many lie before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tie = F.xxhash64(*rows.columns)  # so that a value that most rows have is cut too
    held = durable(rows.withColumn("__tie", tie).repartitionByRange(parts, *order, "__tie").withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie"))
    found = held.withColumn("__i", inside).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return found.withColumn(name, F.col("__before") + F.col("__i") - 1).select(*rows.columns, name)
