"""Event-time windows that run alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], aggs: list[Column], time: str = "ts", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by window and keys; on a stream ``late`` is the watermark that bounds its state."""
    if events.isStreaming and late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(window.alias("w"), *keys).agg(*aggs).withColumn("window_start", F.col("w.start")).drop("w")


def sessions(events: DataFrame, gap: str, keys: list[str], aggs: list[Column], time: str = "ts", late: str | None = None) -> DataFrame:
    """Aggregates by session: a key's events no further apart than ``gap``."""
    if events.isStreaming and late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs).withColumn("session_start", F.col("w.start")).withColumn("session_end", F.col("w.end")).drop("w")
