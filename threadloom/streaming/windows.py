"""Event-time windows, the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, lateness: str = "10 minutes") -> DataFrame:
    w = _late(events, lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str, step: str, lateness: str = "10 minutes") -> DataFrame:
    w = _late(events, lateness).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    w = _late(events, lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Each key once while its state lives: exactly-once evidence, with the watermark as its time to live."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
