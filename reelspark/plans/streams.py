"""Streaming queries, run to the end of what is there; their results are read from what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.plans import ordered  # noqa: F401  registers the SQL used below
from reelspark.plans.registry import SQL, query
from reelspark.session import shared_path
from reelspark.streaming import progress, upsert, windows


def _stream(t):
    """events as a file stream: its files, whether the table is one file or a folder of them."""
    events = t.events
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{t._folder}/events.parquet*")


def _at():
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("at")


def _run(writer, name: str, t):
    writer.option("checkpointLocation", shared_path(t.spark, name)).trigger(availableNow=True).start().awaitTermination()


@query(SQL["ema_smoothing"])
def stream_progress(t):
    """Smoothed speeds kept as state; the last row of each job."""
    rows = _stream(t).select(F.col("user_id").cast("string").alias("key"), F.lit("audio").alias("stage"), _at(), F.col("event_id").alias("n"), F.when(F.col("value") > 5, F.col("value")).alias("speed"))
    path = shared_path(t.spark, "progress")
    _run(progress.smoothed(rows).writeStream.outputMode("append").format("parquet").option("path", path), "progress-state", t)
    last = t.spark.read.parquet(path).groupBy("key").agg(F.max_by("ema", "n").alias("ema"), F.max("n").alias("n"))
    return last.select(F.col("key").cast("long").alias("user_id"), "n", F.round("ema", 6).alias("ema"))


@query(SQL["latest_per_key"])
def stream_latest(t):
    """State of each key by upserts, a version for each batch."""
    table = upsert.LatestTable(t.spark, shared_path(t.spark, "latest"), ["user_id"], ["at", "event_id"])
    seen: list[int] = []

    def apply(batch, n):
        table.apply(batch, n)
        seen.append(n)

    _run(_stream(t).select("user_id", _at(), "event_id", "event_type").writeStream.foreachBatch(apply), "latest-state", t)
    return table.read(max(seen)).select("user_id", "event_id", "event_type")


@query("""
SELECT (epoch_us(ts) // 86400000000 * 86400000000)::BIGINT AS start, ((epoch_us(ts) // 86400000000 + 1) * 86400000000)::BIGINT AS "end", event_type AS key, count(*)::BIGINT AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def stream_windows(t):
    """An addition: day windows of all events, in any order; each batch's sums are written, and added up by window when read."""
    path = shared_path(t.spark, "windows")

    def apply(batch, n):
        windows.summed(batch, "1 day").write.mode("overwrite").parquet(f"{path}/batch={n}")  # a batch that is run again replaces its own

    _run(_stream(t).writeStream.foreachBatch(apply), "windows-state", t)
    parts = t.spark.read.schema("start long, end long, key string, n long, sum double").parquet(path)
    return parts.groupBy("start", "end", "key").agg(F.sum("n").alias("n"), F.round(F.sum("sum"), 4).alias("total"))


@query("""
SELECT CASE WHEN grouping(event_type) = 0 THEN event_type ELSE 'all' END AS event_type, CASE WHEN grouping(d) = 0 THEN d ELSE -1 END::BIGINT AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users
FROM (SELECT *, epoch_us(ts) // 86400000000 AS d FROM events) GROUP BY CUBE (event_type, d)""")
def cube_counts(t):
    """An addition: counts by type and day with all subtotals."""
    rows = t.events.withColumn("d", F.expr("unix_micros(cast(ts AS timestamp)) div 86400000000"))
    out = rows.cube("event_type", "d").agg(F.grouping("event_type").alias("g1"), F.grouping("d").alias("g2"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select(F.when(F.col("g1") == 0, F.col("event_type")).otherwise("all").alias("event_type"), F.when(F.col("g2") == 0, F.col("d")).otherwise(-1).cast("long").alias("day"), "n", "users")
