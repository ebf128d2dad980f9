"""Operators that keep state with timers, and a join of two streams, on Structured Streaming.

State lives in the checkpoint, so a query that stops goes on where it was.  The
batch forms beside them say the same of a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where Spark keeps keyed state that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, set so that queries started from now on can keep maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Debounced(StatefulProcessor):
    """Events after which a key rests for ``pause`` milliseconds.

    An event waits until the watermark is past its pause; by then every event that
    can follow within it is known, in whatever order they came.  State holds the
    events of a key that still wait, and one timer for each.
    """

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "value double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            at = round(r["ts"].replace(tzinfo=r["ts"].tzinfo or UTC).timestamp() * 1_000_000)
            self.waiting.updateValue((at, r["event_id"]), (r["value"],))
            self.handle.registerTimer(at // 1000 + self.pause + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((*k, *v) for k, v in self.waiting.iterator())
        for i, (at, event, value) in enumerate(held):
            if at // 1000 + self.pause + 1 > due:
                break
            follower = next((later for later, *_ in held[i + 1 :] if later > at), None)
            last_of_its_time = i + 1 == len(held) or held[i + 1][0] > at
            if last_of_its_time and (follower is None or follower - at > self.pause * 1000):
                yield Row(user_id=key[0], event_id=event, ts=datetime.fromtimestamp(at / 1_000_000, UTC), value=value)
            self.waiting.removeKey((at, event))

    def close(self) -> None:
        pass


def debounced(events: DataFrame, pause: int, late: str) -> DataFrame:
    """(user_id, event_id, ts, value): a stream's events that no other one of their user follows within ``pause`` milliseconds."""
    with_state(events.sparkSession)
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    kinds = "user_id long, event_id long, ts timestamp, value double"
    return rows.groupBy("user_id").transformWithState(statefulProcessor=Debounced(pause), outputStructType=kinds, outputMode="Append", timeMode="EventTime")


def debounced_table(events: DataFrame, pause: int) -> DataFrame:
    """The same of a whole table: of events at one time the one of largest event_id."""
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    micros = F.unix_micros("ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rest = F.coalesce(F.lead(micros).over(w) - micros > pause * 1000, F.lit(True))
    return rows.withColumn("rest", rest).filter("rest").drop("rest")


def followed(first: DataFrame, then: DataFrame, within: str, late: str) -> DataFrame:
    """(user_id, event_id, then_id): events of one stream with those of another that follow them within a time.

    Both are watermarked, so Spark forgets rows that nothing can follow any more;
    on tables the same expression joins all rows.
    """
    side = lambda df, tag: df.select(F.col("user_id").alias(f"{tag}_user"), F.col("event_id").alias(f"{tag}_id"), F.col("ts").cast("timestamp").alias(f"{tag}_ts")).withWatermark(f"{tag}_ts", late)
    a, b = side(first, "a"), side(then, "b")
    meets = F.expr(f"a_user = b_user and b_ts > a_ts and b_ts <= a_ts + interval {within}")
    return a.join(b, meets).select(F.col("a_user").alias("user_id"), F.col("a_id").alias("event_id"), F.col("b_id").alias("then_id"))
