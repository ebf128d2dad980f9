"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by Spark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """One row per run of a user's events without a pause of ``gap``: debounce on a stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("last")).select("user_id", F.col("w.start").alias("start"), "n", "last")


def latest(events: DataFrame) -> DataFrame:
    """The latest value by key; a slower earlier result does not win.  For update or complete output."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
