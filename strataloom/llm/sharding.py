"""Jump consistent hashing of stable keys to shards.

The shard of a key follows from the key and the number of shards alone: there
is no ring table, and going from n to n + 1 shards moves about one key in n + 1,
each into the new shard.  The hash is the published one (a 64-bit linear
congruential generator whose high bits choose the next jump), evaluated for a
column at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import durable, ship


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys into 0 .. shards - 1."""
    key = keys.astype(np.uint64).copy()
    bucket = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def _place(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            columns = list(batch.columns) + [pa.array(jump(keys, n), pa.int32()) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard", "grown_shard"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each shard within one sorted partition."""
    seen: dict[int, int] = {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        rank = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            mine = shard == s
            n = int(mine.sum())
            rank[mine] = np.arange(seen.get(int(s), 0), seen.get(int(s), 0) + n)
            seen[int(s)] = seen.get(int(s), 0) + n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put rows (doc_id, text) into shards by jump consistent hashing of doc_id.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law 'key', shard, slot
    and grown_shard (the shard with one more).  Slots number a shard's rows from
    0 without gaps in order of doc_id, size and text_crc32; rows equal in these
    take neighbouring slots in either order.  A null doc_id hashes as -1 and
    comes first; a null text counts as an empty one; an empty table gives no
    rows; other columns are left alone.

    Texts are read once and leave the plan at once.  The thin rows are range
    partitioned on the slot order, where a row number spreads equal keys, so no
    shard, key or copy has to fit in a task; a table of one row per partition
    and shard then gives each partition its first slot.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    kinds = "doc_id long, size long, text_crc32 long, row long, shard int, grown_shard int"
    placed = durable(thin.mapInArrow(_place(shards), kinds), "placed")
    keys = ["shard", "doc_id", "size", "text_crc32", "row"]
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = placed.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    ranked = durable(ordered.mapInArrow(_ranked, kinds + ", rank long").withColumn("part", F.spark_partition_id()), "ranked")
    held = ranked.groupBy("part", "shard").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranked.join(F.broadcast(first), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), "grown_shard"
    )
