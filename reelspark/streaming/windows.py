"""Event-time windows over a stream of events; an addition to the container operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a zoned type


def counted(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", by: Column | None = None) -> DataFrame:
    """start, end, key, n, total of tumbling or sliding windows."""
    key = (F.col("event_type") if by is None else by).alias("key")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "key", "n", "total")


def summed(events: DataFrame, width: str) -> DataFrame:
    """start, end, key, n, sum of a finite table's tumbling windows; nothing is late."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("key"))
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("sum")).select(F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "key", "n", "sum")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """start, end, user_id, n of sessions that end after a gap."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "user_id", "n")
