"""Operators on small tables: ties, nulls, empty tables and repeated rows."""

import math

import pytest
from pyspark.sql import functions as F

from reelspark.operators import joins, packets, windows
from reelspark.streaming import progress, upsert, windows as event_windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [[5], [3, 1, 2], list(range(101)), [7] * 20 + [9], [2, None, 4]])
def test_nearest_rank(spark, sizes):
    df = spark.createDataFrame([(s,) for s in sizes], "size long")
    known = sorted(s for s in sizes if s is not None)
    expected = [(p, known[min(len(known) - 1, math.floor(len(known) * p / 100))]) for p in packets.PERCENTILES]
    assert sorted(rows(packets.percentiles(df, "size"))) == expected


def test_packet_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "size long, k long, s string")
    assert rows(packets.percentiles(df, "size")) == [] and rows(packets.report(df, "size", ["s"])) == []
    assert [r.n for r in packets.histogram(df, "size").collect()] == [0] * 8
    assert all(r.n_over == 0 and not r.warn for r in packets.thresholds(df, "size").collect())
    assert rows(packets.largest_first(df, "size", "k", ["s"])) == []


def test_histogram_ends(spark):
    df = spark.createDataFrame([(s,) for s in (0, 2047, 2048, 40960, 999998, 999999, 5000000)], "size long")
    assert [r.n for r in packets.histogram(df, "size").orderBy("lo").collect()] == [2, 1, 0, 0, 0, 0, 0, 2]


def test_largest_first_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 3, 9, "x"), ("a", 1, 9, "y"), ("a", 0, 2, "z")], "s string, k long, size long, c string")
    assert rows(packets.largest_first(df, "size", "k", ["s"], "c")) == [("a", 1, 9, "y")]


@pytest.mark.parametrize("cell", [None, 1, 7, 100])
def test_asof_takes_equal_places_and_the_larger_tie(spark, cell):
    points = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("a", 20, 3), ("b", 5, 4)], "k string, at long, id long")
    probes = spark.createDataFrame([("a", 9), ("a", 10), ("a", 25), ("c", 1), ("b", 5), ("b", 5)], "k string, at long")
    got = joins.asof(probes, points, ["k"], "at", ["id"], "id", cell)
    assert rows(got) == [("a", 10, 2), ("a", 25, 3), ("a", 9, None), ("b", 5, 4), ("b", 5, 4), ("c", 1, None)]


def test_interval_is_half_open_and_takes_the_first(spark):
    spans = spark.createDataFrame([("a", 0, 100, "x"), ("a", 50, 60, "y"), ("a", 100, 100, "empty"), ("a", 200, 4000, "long")], "k string, start long, stop long, name string")
    points = spark.createDataFrame([(1, "a", 55), (2, "a", 100), (3, "a", 3999), (4, "b", 55), (5, "a", 0)], "id long, k string, at long")
    got = joins.interval(points, spans, ["k"], "at", "start", "stop", ["name"], 64)
    assert [(r.id, r.span_name) for r in got.orderBy("id").collect()] == [(1, "x"), (2, None), (3, "long"), (4, None), (5, "x")]


def test_plan_status_and_owner(spark):
    planned = spark.createDataFrame([("a", 1), ("b", 2), ("n", None)], "f string, h long")
    existing = spark.createDataFrame([("b", 3), ("c", 1), ("n", None)], "f string, h long")
    assert rows(joins.plan_status(planned, existing, "f", "h")) == [("a", "added"), ("b", "changed"), ("c", "removed"), ("n", "unchanged")]
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, d string")
    assert rows(joins.first_owner(df, "d", "id").select("id", "owner")) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_tiers(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    tiers = [spark.createDataFrame([(1, 10), (2, -1)], "k long, v long"), spark.createDataFrame([(1, 11), (2, 12)], "k long, v long")]
    assert rows(joins.tiered(asked, tiers, "k", "v", lambda s: s["v"] > 0)) == [(1, 10, 1), (2, 12, 2), (3, None, None)]


def test_scan_stops_after_misses(spark):
    hits = [0, 0, 1, 0, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([(k, bool(h)) for k, h in enumerate(hits)], "n long, hit boolean").withColumn("k", F.lit(1))
    got = windows.until_misses(df, ["k"], ["n"], F.col("hit"), 3)
    assert [r.n for r in got.orderBy("n").collect()] == list(range(9))


def test_runs_and_smoothing(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "a", None, None, "a"])], "g long, n long, v string")
    assert rows(windows.runs(df, ["g"], ["n"], "v").select("number", "v", "length")) == [(1, "a", 2), (2, None, 2), (3, "a", 1)]
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, -5.0), (1, 2, 2.0), (1, 3, 4.0), (2, 0, None)], "g long, n long, x double")
    assert rows(windows.smoothed(df, ["g"], ["n"], "x").select("g", "n", "ema")) == [(1, 3, 1.9375), (2, 0, None)]


def test_progress_state_lives_between_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "key string, stage string, at long, n long, speed double"
    parts = [[("j", "video", 1, 1, 1.0)], [("j", "video", 2, 2, 2.0), ("j", "video", 3, 3, 4.0)], [("j", "audio", 4, 4, 8.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        writer = progress.smoothed(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    assert {(r.stage, r.n, r.ema) for r in spark.read.parquet(out).collect()} == {("video", 1, 1.0), ("video", 3, 1.9375), ("audio", 1, 8.0)}


def test_upserts_are_idempotent(spark, tmp_path):
    table = upsert.LatestTable(spark, str(tmp_path / "t"), ["k"], ["at"])
    a = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k long, at long, v string")
    b = spark.createDataFrame([(1, 6, "old"), (3, 1, "d")], "k long, at long, v string")
    for batch, n in ((a, 0), (b, 1), (a, 0), (b, 1)):
        table.apply(batch, n)
    assert rows(table.read(1)) == [(1, 7, "b"), (2, 1, "c"), (3, 1, "d")]


def test_event_windows_in_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_windows.counted(events, "1 day").agg(F.sum("n")).first()[0] == 1000
    assert event_windows.sessions(events, "2 hours").agg(F.sum("n")).first()[0] == 1000
    assert event_windows.counted(events, "2 days", "1 day").agg(F.sum("n")).first()[0] == 2000


def test_numbers_and_predecessors_across_cells(spark):
    from pyspark.sql import Window

    df = spark.range(300).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS k", "id * 7 % 300 AS at", "CASE WHEN id % 5 > 0 THEN id END AS v")
    w = Window.partitionBy("k").orderBy("at")
    cell = F.expr("at div 16")
    expected = df.select("k", "at", F.row_number().over(w).cast("long").alias("place"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    assert rows(windows.numbered(df, ["k"], ["at"], cell, "place", "n").select("k", "at", "place", "n")) == rows(expected)
    assert rows(windows.previous(df, ["k"], "at", "v", cell, "u").select("k", "at", "u")) == rows(df.select("k", "at", F.lag("v").over(w).alias("u")))


def test_smoothing_equals_the_recursion(spark):
    values = [(k, at, float((at * 37 + k) % 11 - 3) if at % 7 else None) for k in range(4) for at in range(k * 300)]
    df = spark.createDataFrame([*values, (9, 1, -1.0)], "k long, at long, x double")
    got = {r.k: (r.n, r.ema) for r in windows.smoothed(df, ["k"], ["at"], "x").collect()}
    for k in range(1, 4):
        ema, n = None, 0
        for _, _, x in sorted(v for v in values if v[0] == k and (v[2] or 0) > 0):
            ema, n = x if ema is None else 0.25 * x + 0.75 * ema, n + 1
        assert got[k][0] == n and abs(got[k][1] - ema) < 1e-9
    assert got[9] == (0, None)


def test_intervals_of_all_lengths(spark):
    points = [(k % 2, k * 13 % 4000 - 200) for k in range(400)]
    spans = [(k % 2, k * 97 % 3000 - 100, k * 97 % 3000 - 100 + 3**(k % 8), f"s{k}") for k in range(60)] + [(0, 5, 5, "empty"), (1, -200, 4000, "all")]
    got = joins.interval(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(spans, "k long, start long, stop long, name string"), ["k"], "at", "start", "stop", ["name"], 8)
    expected = [(k, at, min(((s, n) for g, s, e, n in spans if g == k and s <= at < e), default=(None, None))[1]) for k, at in points]
    assert rows(got.select("k", "at", "span_name")) == sorted(set(expected), key=str)


def test_upserts_begin_whole_tables_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert.LatestTable, "EVERY", 3)
    table = upsert.LatestTable(spark, str(tmp_path / "t"), ["k"], ["at"])
    for n in range(8):
        table.apply(spark.createDataFrame([(n % 4, n), (9, n)], "k long, at long"), n)
    assert rows(table.read(7)) == [(0, 4), (1, 5), (2, 6), (3, 7), (9, 7)]
    assert spark.read.parquet(table.folder(6)).count() == 5 and spark.read.parquet(table.folder(7)).count() == 2
