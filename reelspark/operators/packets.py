"""Packet-size analytics: reports, nearest-rank percentiles, histograms, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Percentiles, lower bounds of the histogram's buckets, its end, thresholds and the share that draws a warning.
PERCENTILES = (50, 90, 95, 99)
BUCKETS = (0, 2048, 5120, 10240, 15360, 20480, 30720, 40960)
LAST, THRESHOLDS, WARN_UP_TO, WARN_PERCENT = 999999, (10240, 15360, 20480, 30720, 40960), 15360, 10.0


def _places(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """Distinct sizes of each group with their counts, the count up to them and the group's count.

    Only one row for each distinct size reaches the window: sizes of packets are
    bounded by the page, so a window holds at most 524,288 rows however many
    packets there are, and counting combines before the exchange.
    """
    counts = df.where(F.col(size).isNotNull()).groupBy(*by, F.col(size).alias("size")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return counts.withColumn("upto", F.sum("n").over(w.orderBy("size"))).withColumn("total", F.sum("n").over(w))


def _rank(p: int):
    return F.least(F.col("total") - 1, F.floor(F.col("total") * p / 100))


def percentiles(df: DataFrame, size: str, by: list[str] = (), ps=PERCENTILES) -> DataFrame:
    """One row for each group and percentile: the size at place min(n - 1, floor(n p / 100)) of the sorted sizes."""
    places = _places(df, list(by), size)
    values = places.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > _rank(p), F.col("size"))).cast("long").alias(f"p{p}") for p in ps))
    pairs = F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.col(f"p{p}").alias("value")) for p in ps)))
    return values.select(*by, pairs.alias("x")).select(*by, "x.p", "x.value").where("value IS NOT NULL")


def report(df: DataFrame, size: str, by: list[str] = ()) -> DataFrame:
    """count, min, max, avg and nearest-rank percentiles of each group."""
    places = _places(df, list(by), size)
    return places.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n_packets"),
        F.min("size").cast("long").alias("min_size"),
        F.max("size").cast("long").alias("max_size"),
        F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 6).alias("avg_size"),
        *(F.min(F.when(F.col("upto") > _rank(p), F.col("size"))).cast("long").alias(f"p{p}") for p in PERCENTILES),
    )


def histogram(df: DataFrame, size: str) -> DataFrame:
    """lo, hi, n of every bucket, empty ones too; sizes from LAST on are in none."""
    place = F.lit(None).cast("int")
    for k, lo in enumerate(BUCKETS):
        place = F.when((F.col(size) >= lo) & (F.col(size) < (*BUCKETS, LAST)[k + 1]), k).otherwise(place)
    counts = df.groupBy(place.alias("k")).agg(F.count("*").alias("n"))
    bounds = df.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(BUCKETS, (*BUCKETS[1:], LAST), strict=True))], "k int, lo long, hi long")
    return bounds.join(counts, "k", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def thresholds(df: DataFrame, size: str) -> DataFrame:
    """threshold, n_over, pct, warn: one pass with a conditional count for each threshold."""
    counts = df.agg(F.count(size).alias("n"), *(F.count(F.when(F.col(size) >= t, 1)).alias(f"t{t}") for t in THRESHOLDS))
    rows = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{t}").alias("n_over")) for t in THRESHOLDS)))
    pct = F.when(F.col("n") > 0, F.col("n_over") * 100.0 / F.col("n")).otherwise(0.0)
    out = counts.select("n", rows.alias("x")).select("x.*", pct.alias("share"))
    return out.select("threshold", "n_over", F.round("share", 6).alias("pct"), ((F.col("threshold") <= WARN_UP_TO) & (F.col("share") > WARN_PERCENT)).alias("warn"))


def largest_first(df: DataFrame, size: str, order: str, by: list[str], *carry: str) -> DataFrame:
    """The row of the largest size of each group; of equals the first in order."""
    best = F.max(F.struct(F.col(size).alias("size"), (-F.col(order)).alias("back"), *carry)).alias("best")
    return df.groupBy(*by).agg(best).select(*by, (-F.col("best.back")).alias(order), F.col("best.size").cast("long").alias("size"), *(f"best.{c}" for c in carry))
