"""Predicates, rules and choices of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import windows
from reelspark.plans.registry import query


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' AND n_chars >= 1000")
def filter_project(t):
    return t.documents.where((F.col("source") == "src3") & (F.col("n_chars") >= 1000)).select("doc_id", "source", "n_chars")


def is_sync(codec, mark, width, height, flags, size):
    """Whether a packet starts a decodable run: by codec, by the body's mark where the codec has one, by flag or raw size."""
    return (
        F.when(codec.isin("M2Y0", "M1P0"), True)
        .when(codec.isin("M2Y1", "M2Y2"), F.coalesce(mark == 1, F.lit(False)))
        .when(codec.rlike("^M[12]") & ((flags % 2) == 1), True)
        .when((codec == "RAWV") & (width * height * 2 > 0) & (size == width * height * 2), True)
        .otherwise(False)
    )


_CODEC = "CASE o_orderkey % 6 WHEN 0 THEN 'M2Y0' WHEN 1 THEN 'M2Y1' WHEN 2 THEN 'M2Y2' WHEN 3 THEN 'M1XX' WHEN 4 THEN 'RAWV' ELSE 'ABCD' END"


@query(f"""
WITH x AS (SELECT o_orderkey, {_CODEC} AS codec, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS mark, o_orderkey % 4 AS w, o_orderkey % 7 AS flags, o_custkey % 3 * 4 AS size FROM orders)
SELECT o_orderkey, codec, CASE WHEN codec IN ('M2Y0', 'M1P0') THEN true WHEN codec IN ('M2Y1', 'M2Y2') THEN coalesce(mark = 1, false) WHEN (codec LIKE 'M1%' OR codec LIKE 'M2%') AND flags % 2 = 1 THEN true
       WHEN codec = 'RAWV' AND w * 2 * 2 > 0 AND size = w * 2 * 2 THEN true ELSE false END AS sync FROM x""")
def sync_predicate(t):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", "o_custkey", F.expr(_CODEC).alias("codec"))
    return rows.select("o_orderkey", "codec", is_sync(F.col("codec"), F.when(k % 5 > 0, k % 3), k % 4, F.lit(2), k % 7, F.col("o_custkey") % 3 * 4).alias("sync"))


@query("""
SELECT event_id, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 30 THEN 'logo' WHEN d < 300 THEN 'short' WHEN d < 2700 THEN 'episode' ELSE 'feature' END AS bucket
FROM (SELECT event_id, CASE WHEN event_id % 12 > 0 THEN value * 20 END AS d FROM events)""")
def case_bucket(t):
    d = F.when(F.col("event_id") % 12 > 0, F.col("value") * 20)
    return t.events.select("event_id", F.when(d.isNull(), "unknown").when(d < 30, "logo").when(d < 300, "short").when(d < 2700, "episode").otherwise("feature").alias("bucket"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'text' WHEN lower(p_type) IN ('small') THEN 'bitmap' ELSE 'unknown' END AS kind FROM part")
def set_membership(t):
    low = F.lower("p_type")
    return t.part.select("p_partkey", F.when(low.isin("economy", "standard"), "text").when(low.isin("small"), "bitmap").otherwise("unknown").alias("kind"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'pending' ELSE event_type END AS status FROM events WHERE event_type <> 'signup' AND value > 1")
def status_coerce(t):
    """Malformed jobs are dropped; running ones become pending on load."""
    rows = t.events.where((F.col("event_type") != "signup") & (F.col("value") > 1))
    return rows.select("event_id", F.when(F.col("event_type").isin("view", "click"), "pending").otherwise(F.col("event_type")).alias("status"))


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1")
def first_pending(t):
    """The first pending job of each queue in list order."""
    return t.events.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("""
WITH r AS (SELECT p_partkey, unnest([CASE WHEN p_size % 2 = 1 THEN 'odd size' END, CASE WHEN p_size < 3 THEN 'too small' END, CASE WHEN p_retailprice > 950 THEN 'too dear' END, CASE WHEN p_name LIKE 'hot%' THEN 'hot' END]) AS message FROM part)
SELECT p_partkey, message FROM r WHERE message IS NOT NULL""")
def rule_violations(t):
    """One row for each rule that a row breaks."""
    rules = [(F.col("p_size") % 2 == 1, "odd size"), (F.col("p_size") < 3, "too small"), (F.col("p_retailprice") > 950, "too dear"), (F.col("p_name").startswith("hot"), "hot")]
    return t.part.select("p_partkey", F.explode(F.array(*(F.when(bad, message) for bad, message in rules))).alias("message")).where("message IS NOT NULL")


@query("""
WITH x AS (SELECT user_id, count(*) AS frames, max(event_id) AS last, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done FROM events GROUP BY 1),
     y AS (SELECT *, CASE WHEN done = 0 THEN 'unwatched' WHEN frames < 70 THEN 'in progress' ELSE 'watched' END AS state FROM x)
SELECT user_id, state, row_number() OVER (PARTITION BY state ORDER BY last DESC) AS place FROM y WHERE state <> 'unwatched'""")
def library_filter_sort(t):
    """Titles of the chosen states, the last played first."""
    x = t.events.groupBy("user_id").agg(F.count("*").alias("frames"), F.max("event_id").alias("last"), F.max((F.col("event_type") == "purchase").cast("int")).alias("done"))
    y = x.withColumn("state", F.when(F.col("done") == 0, "unwatched").when(F.col("frames") < 70, "in progress").otherwise("watched")).where("state <> 'unwatched'")
    return windows.numbered(y, ["state"], [F.desc("last")], -F.expr("last div 1048576"), "place").select("user_id", "state", "place")


_LINE = """CASE event_id % 5 WHEN 0 THEN concat('[video] ', cast(event_id AS {s}), ' frames (', cast(event_id % 90 AS {s}), '.5 fps)') WHEN 1 THEN concat('[audio] ', cast(event_id AS {s}))
 WHEN 2 THEN '4. Index' WHEN 3 THEN concat('warning: ', event_type) ELSE '' END"""


@query(f"""
WITH x AS (SELECT event_id, {_LINE.format(s="VARCHAR")} AS line FROM events)
SELECT event_id, CASE WHEN regexp_matches(line, '^\\[video\\] ') THEN 'video' WHEN regexp_matches(line, '^\\[audio\\] ') THEN 'audio' WHEN line = '4. Index' THEN 'index' END AS stage,
       try_cast(nullif(regexp_extract(line, '^\\[(?:video|audio)\\] ([0-9]+)', 1), '') AS BIGINT) AS current, try_cast(nullif(regexp_extract(line, '\\(([0-9.]+) fps\\)', 1), '') AS DOUBLE) AS speed FROM x""")
def log_regex(t):
    """Stage, position and speed of progress lines; nulls for lines of no stage."""
    line = F.col("line")
    rows = t.events.select("event_id", F.expr(_LINE.format(s="STRING")).alias("line"))
    found = lambda shape: F.nullif(F.regexp_extract(line, shape, 1), F.lit(""))
    stage = F.coalesce(found(r"^\[(video|audio)\] "), F.when(line == "4. Index", "index"))
    return rows.select("event_id", stage.alias("stage"), found(r"^\[(?:video|audio)\] (\d+)").try_cast("long").alias("current"), found(r"\(([\d.]+) fps\)").try_cast("double").alias("speed"))


@query("""
WITH x AS (SELECT label, vec_id, embedding[1:7] AS v, lag(embedding[1:7]) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings)
SELECT vec_id, list_bool_and([abs(v[i]::DOUBLE - u[i]::DOUBLE) <= 0.15 FOR i IN range(1, 8)]) AS similar FROM x WHERE u IS NOT NULL""")
def near_duplicate(t):
    """Whether a recipe's seven numbers are each within a tolerance of its predecessor's."""
    x = windows.previous(t.embeddings.select("label", "vec_id", F.slice("embedding", 1, 7).alias("v")), ["label"], "vec_id", "v", F.expr("vec_id div 1048576"), "u")
    near = F.forall(F.zip_with("v", "u", lambda a, b: F.abs(a.cast("double") - b.cast("double")) <= 0.15), lambda ok: ok)
    return x.where("u IS NOT NULL").select("vec_id", near.alias("similar"))
