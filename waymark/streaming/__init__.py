"""Streaming versions of history statistics; an extension without a model to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Commits and authors per file and window of event time; rows later than ``late`` drop out."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "file").agg(F.count(F.lit(1)).alias("commits"), F.approx_count_distinct("author").alias("authors"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of changes by an author."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "author").agg(F.count(F.lit(1)).alias("changes"))


def running_stats(events: DataFrame) -> DataFrame:
    """File statistics that grow with the stream (complete or update mode)."""
    return events.groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"))
