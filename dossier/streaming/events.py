"""Trace aggregates over an event stream; the same expressions run on a batch frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, event_type, value, k of the events table or stream."""
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def unique_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per window and type: count, errors, mean value; late events up to ``delay`` count."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "errors", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events parted by ``gap``."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select("user_id", F.col("s.start").alias("session_start"), "n", "total")
