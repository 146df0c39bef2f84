"""Window, sort and set queries: conversations as segments, events as logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import windows
from reelspark.plans.registry import query

_US = "epoch_us(ts)"
CELL = 1 << 20  # ids to a cell, where rows of few keys are numbered


def _at(t):
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query("SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS begin, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS end FROM conversations")
def running_offsets(t):
    """Where each section of a compilation starts and ends."""
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return windows.offsets(rows, ["conv_id"], ["turn"], "size").select("conv_id", "turn", "begin", "end")


@query("""
WITH x AS (SELECT conv_id, turn, turn * 10 AS s, turn * 10 + 10 - (turn % 3 = 2)::BIGINT AS e FROM conversations), y AS (SELECT *, s - lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM x)
SELECT conv_id, turn, gap, coalesce(gap = 0, true) AND e > s AS ok FROM y""")
def contiguity_check(t):
    rows = t.conversations.select("conv_id", "turn", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + 10 - (F.col("turn") % 3 == 2).cast("long")).alias("e"))
    return windows.breaks(rows, ["conv_id"], ["turn"], "s", "e").select("conv_id", "turn", "gap", "ok")


@query("""
WITH x AS (SELECT conv_id, turn FROM conversations WHERE (conv_id % 10 > 0 OR turn <> 1) AND NOT (conv_id % 2 = 1 AND turn = 0)), y AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM x)
SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS first, coalesce(bool_and(step = 1), true) AS contiguous FROM y GROUP BY 1""")
def merge_continuity(t):
    """Segments in order, without the warm-up page of every second one; whether the pages left go up by one."""
    rows = t.conversations.where("conv_id % 10 > 0 OR turn <> 1").where("NOT (conv_id % 2 = 1 AND turn = 0)")
    return windows.sequence_gaps(rows, ["conv_id"], "turn")


@query(f"""
WITH x AS (SELECT user_id, event_id, {_US} AS us, {_US} + (value * 60000000)::BIGINT AS stop FROM events)
SELECT event_id, coalesce(us < lag(stop) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS overlaps FROM x""")
def lag_overlap(t):
    """Whether a chapter begins before the one in front of it ends."""
    rows = _at(t).withColumn("stop", F.col("at") + F.round(F.col("value") * 60_000_000).cast("long"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    return rows.select("event_id", F.coalesce(F.col("at") < F.lag("stop").over(w), F.lit(False)).alias("overlaps"))


@query("""
WITH x AS (SELECT p_brand, p_partkey, 70.0::DOUBLE * p_size / max(p_size) OVER (PARTITION BY p_brand) + 0.7 * least(p_partkey % 50, 30) + CASE WHEN p_type = 'ECONOMY' THEN 3 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 3 ELSE 0 END AS score, p_size FROM part)
SELECT p_brand, p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 6) DESC, p_size DESC, p_partkey) AS place FROM x""")
def rank_scored(t):
    """Titles by score, then duration, then position; places are unique."""
    most = t.part.groupBy("p_brand").agg(F.max("p_size").alias("most"))
    score = F.lit(70.0) * F.col("p_size") / F.col("most") + 0.7 * F.least(F.col("p_partkey") % 50, F.lit(30)) + F.when(F.col("p_type") == "ECONOMY", 3).otherwise(0) + F.when(F.col("p_name").contains("ring"), 3).otherwise(0)
    rows = t.part.join(most, "p_brand").select("p_brand", "p_partkey", "p_size", F.round(score, 6).alias("score"))
    cell = -F.floor(F.col("score") * 1000)  # scores of three decimals to a cell
    return windows.numbered(rows, ["p_brand"], [F.desc("score"), F.desc("p_size"), "p_partkey"], cell, "place").select("p_brand", "p_partkey", "score", "place")


@query(f"""
WITH x AS (SELECT user_id, event_id, {_US} AS us FROM events), y AS (SELECT *, row_number() OVER w AS frames, us - min(us) OVER (PARTITION BY user_id) AS elapsed FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, frames::BIGINT AS frames, CASE WHEN elapsed > 0 THEN round(frames * 3600000000.0::DOUBLE / elapsed, 6) END AS rate FROM y""")
def running_rate(t):
    """Frames done an hour at each completion; null at the start."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = _at(t).withColumn("frames", F.row_number().over(w).cast("long")).withColumn("elapsed", F.col("at") - F.min("at").over(Window.partitionBy("user_id")))
    return rows.select("event_id", "frames", F.when(F.col("elapsed") > 0, F.round(F.col("frames") * 3600000000.0 / F.col("elapsed"), 6)).alias("rate"))


@query(f"""
WITH x AS (SELECT user_id, list(value ORDER BY {_US}, event_id) FILTER (value > 5) AS v FROM events GROUP BY 1)
SELECT user_id, coalesce(len(v), 0)::BIGINT AS n, CASE WHEN len(v) > 0 THEN round(list_reduce(v, lambda a, b: 0.25 * b + 0.75 * a), 6) END AS ema FROM x""")
def ema_smoothing(t):
    rows = _at(t).withColumn("x", F.when(F.col("value") > 5, F.col("value")))
    out = windows.smoothed(rows, ["user_id"], ["at", "event_id"], "x")
    return out.withColumn("ema", F.round("ema", 6))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 12 = 0 AS keyframe FROM documents")
def keyframe_cadence(t):
    """The first frame of each segment and every twelfth after it."""
    rows = windows.numbered(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], F.expr(f"doc_id div {CELL}"), "place")
    return rows.select("doc_id", (F.pmod(F.col("place") - 1, F.lit(12)) == 0).alias("keyframe"))


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_US}, event_id) - 1 AS place FROM events")
def relative_index(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    return _at(t).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query(f"""
WITH x AS (SELECT user_id, event_id, {_US} AS us, event_type <> 'error' AND event_type <> 'signup' AS found FROM events),
     y AS (SELECT *, sum(found::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS hits FROM x),
     z AS (SELECT *, CASE WHEN hits > 0 THEN sum((NOT found)::INT) OVER (PARTITION BY user_id, hits ORDER BY us, event_id) ELSE 0 END AS missed FROM y),
     q AS (SELECT *, coalesce(sum((missed = 3)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT event_id, found FROM q WHERE before = 0""")
def miss_limit_scan(t):
    """A scan that ends with the third miss in a row once something was found."""
    rows = _at(t).withColumn("found", ~F.col("event_type").isin("error", "signup"))
    return windows.until_misses(rows, ["user_id"], ["at", "event_id"], F.col("found"), 3).select("event_id", "found")


@query(f"""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_US}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM events""")
def block_fill(t):
    """The block that each line of a manifest stands in."""
    return windows.fill_forward(_at(t), ["user_id"], ["at", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "block").select("event_id", "block")


@query("""
WITH x AS (SELECT event_id, event_id // 50 AS file, event_type AS line, event_type = 'view' AS s, event_type = 'error' AS z FROM events), y AS (SELECT *, sum(s::INT) OVER (PARTITION BY file ORDER BY event_id) AS cue FROM x),
     q AS (SELECT *, sum(z::INT) OVER (PARTITION BY file, cue ORDER BY event_id) AS over FROM y)
SELECT file, cue::BIGINT AS cue, string_agg(line, chr(10) ORDER BY event_id) AS text FROM q WHERE cue > 0 AND over = 0 AND NOT s GROUP BY 1, 2""")
def cue_grouping(t):
    """Lines of a cue: from a starting line to a blank one or the next start."""
    rows = t.events.select("event_id", F.expr("event_id div 50").alias("file"), F.col("event_type").alias("line"))
    return windows.cues(rows, ["file"], "event_id", F.col("line") == "view", F.col("line") == "error", "line")


@query("""
WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events),
     y AS (SELECT user_id, event_type, island, count(*) AS length, min(event_id) AS first FROM x GROUP BY 1, 2, 3)
SELECT user_id, event_type, length::BIGINT AS length, row_number() OVER (PARTITION BY user_id ORDER BY first) AS number FROM y""")
def run_length(t):
    return windows.runs(t.events, ["user_id"], ["event_id"], "event_type")


@query("""
WITH c AS (SELECT source, doc_id // 120 AS chunk, max(doc_id) AS last FROM documents GROUP BY 1, 2)
SELECT source, chunk, last, lag(last) OVER (PARTITION BY source ORDER BY chunk) AS carried FROM c""")
def carry_prev_chunk(t):
    """What a chunk takes over from the one before."""
    chunks = t.documents.groupBy("source", F.expr("doc_id div 120").alias("chunk")).agg(F.max("doc_id").alias("last"))
    return chunks.withColumn("carried", F.lag("last").over(Window.partitionBy("source").orderBy("chunk")))


@query(f"SELECT user_id, arg_max(event_id, ({_US}, event_id)) AS event_id, arg_max(event_type, ({_US}, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_key(t):
    """The state of each title after all updates; the latest counts."""
    best = F.max(F.struct("at", "event_id", "event_type")).alias("s")
    return _at(t).groupBy("user_id").agg(best).select("user_id", "s.event_id", "s.event_type")


@query("SELECT source, doc_id // 120 AS chunk, min(doc_id) AS first, count(*)::BIGINT AS frames, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1, 2")
def chunk_tumbling(t):
    return t.documents.groupBy("source", F.expr("doc_id div 120").alias("chunk")).agg(F.min("doc_id").alias("first"), F.count("*").alias("frames"), F.sum("n_chars").alias("bytes"))


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 64")
def sort_limit(t):
    """The first 64 marks in order; the feature's own cap."""
    return t.events.select("event_id", "value").orderBy("value", "event_id").limit(64)


@query(f"""
WITH x AS (SELECT user_id, event_type, max({_US}) AS us FROM events GROUP BY 1, 2) SELECT user_id, event_type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_type) AS place FROM x) WHERE place <= 3""")
def dedup_cap(t):
    """Recents: newest first, each once, three of them."""
    x = _at(t).groupBy("user_id", "event_type").agg(F.max("at").alias("at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), "event_type")
    return x.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("user_id", "event_type", "place")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 6 AS page, ((count(*) OVER (PARTITION BY conv_id) + 5) // 6)::BIGINT AS pages FROM conversations")
def pagination(t):
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", F.expr("(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) div 6").alias("page"), F.ceil(F.count("*").over(w) / 6).cast("long").alias("pages"))


@query("SELECT doc_id AS id, 'main' AS part FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT item_id, 'bonus' FROM benchmark")
def union_all(t):
    main = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit("main").alias("part"))
    return main.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("bonus").alias("part")))


@query("SELECT c_nationkey::BIGINT AS nation FROM customer WHERE c_acctbal > 500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(t):
    return t.customer.where("c_acctbal > 500").select(F.col("c_nationkey").cast("long").alias("nation")).subtract(t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long")))


@query("SELECT c_nationkey::BIGINT AS nation FROM customer WHERE c_mktsegment = 'MACHINERY' INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t):
    return t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").cast("long").alias("nation")).intersect(t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long")))
