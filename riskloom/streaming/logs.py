"""Structured Streaming over append-only logs (an extension: batch is the base)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """First arrival of each event_id; state older than the delay is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly_slots(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
