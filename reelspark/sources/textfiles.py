"""Subtitles, chapters, manifests and settings from lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions import strings as S
from reelspark.operators import windows


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 1), line of all text files under path; a file is a row, so sidecars stay whole."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r\n|\r|\n"))).select("file", (F.col("pos") + 1).cast("long").alias("n"), F.col("col").alias("line"))


def cues(rows: DataFrame) -> DataFrame:
    """file, cue, start_ms, end_ms, text of subtitle lines(file, n, line): a time line opens a cue, a blank one closes it, numbers alone are skipped."""
    start, end = (S.parse_cue_time(F.trim(F.split_part(F.col("line"), F.lit("-->"), F.lit(k)))) for k in (1, 2))
    opens = F.col("line").contains("-->")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where(~F.col("line").rlike(r"^\s*\d+\s*$")).withColumn("_cue", F.sum(opens.cast("long")).over(w))
    times = marked.where(opens).select("file", F.col("_cue").alias("cue"), start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")
    texts = windows.cues(rows.where(~F.col("line").rlike(r"^\s*\d+\s*$")), ["file"], "n", opens, F.trim("line") == "", "line")
    return times.join(texts, ["file", "cue"]).withColumn("text", S.strip_tags(F.col("text")))


def chapters(rows: DataFrame) -> DataFrame:
    """file, n, seconds, label of chapter lines: comments and bad lines are skipped, empty labels numbered."""
    clean = rows.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    time = F.regexp_extract(F.trim("line"), r"^([^|\s]+)[|\s]*(.*)$", 1)
    parsed = clean.withColumn("seconds", S.parse_seconds(time)).withColumn("label", F.trim(F.regexp_extract(F.trim("line"), r"^([^|\s]+)[|\s]*(.*)$", 2))).where("seconds IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("file").orderBy("n"))
    return parsed.select("file", "n", "seconds", F.when(F.col("label") == "", F.concat(F.lit("Chapter "), number.cast("string"))).otherwise(F.col("label")).alias("label"))


def manifest(rows: DataFrame) -> DataFrame:
    """file, n, block, key, value of key=value lines with the [block] that they stand in."""
    block = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    inside = windows.fill_forward(rows, ["file"], ["n"], block, "block")
    pair = inside.where(F.col("line").rlike(r"^\s*[^#=\[]+=")).select("file", "n", "block", F.split_part("line", F.lit("="), F.lit(1)).alias("key"), F.regexp_replace("line", r"^[^=]*=", "").alias("value"))
    return pair.select("file", "n", "block", F.trim("key").alias("key"), F.trim("value").alias("value"))


def settings(rows: DataFrame, limits: dict[str, tuple[int, int, int]]) -> DataFrame:
    """file, key, value of known keys, clamped to (low, high); the default stands in for what is missing or no number. The last line of a key counts."""
    known = rows.sparkSession.createDataFrame([(k, *v) for k, v in limits.items()], "key string, low long, high long, fallback long")
    found = manifest(rows).groupBy("file", "key").agg(F.max_by("value", "n").alias("text"))
    files = rows.select("file").distinct()
    all_ = files.crossJoin(F.broadcast(known))  # known keys: a fixed list
    number = F.col("text").try_cast("long")  # least and greatest would pass over a null
    value = F.when(number.isNull(), F.col("fallback")).otherwise(F.least(F.greatest(number, F.col("low")), F.col("high")))
    return all_.join(found, ["file", "key"], "left").select("file", "key", value.alias("value"))
