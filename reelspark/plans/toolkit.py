"""Checks, queues and small conversions of the authoring side."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.operators import windows
from reelspark.plans.registry import query


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE coalesce(CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, true)")
def enabled_items(t):
    """Items without a mark count as enabled."""
    mark = F.when(F.col("n_nationkey") % 3 == 0, True).when(F.col("n_nationkey") % 3 == 1, False)
    return t.nation.where(F.coalesce(mark, F.lit(True))).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT o_orderkey, round(o_totalprice)::BIGINT * 10000 AS size FROM orders WHERE round(o_totalprice)::BIGINT * 10000 >= 4294967295 * 0.9")
def file_size_warning(t):
    """Files near the single-file limit of 2^32 - 1 bytes."""
    size = F.round("o_totalprice").cast("long") * 10000
    return t.orders.select("o_orderkey", size.alias("size")).where(F.col("size") >= 4294967295 * 0.9)


@query("""
WITH x AS (SELECT s_suppkey, s_nationkey % 5 AS control, s_suppkey * 37 % 360 - 180 AS dx, s_suppkey * 53 % 260 - 130 AS dy FROM supplier),
     y AS (SELECT *, 160 + dx AS cx, 120 + dy AS cy, 12 + control AS r FROM x)
SELECT s_suppkey, CASE WHEN control = 4 THEN 'unsupported' WHEN NOT (dx BETWEEN -160 AND 160 AND dy BETWEEN -120 AND 120) THEN 'out of range'
       WHEN cx < r + 3 OR cx > 320 - r - 3 OR cy < r + 3 OR cy > 240 - r - 3 THEN 'off screen' ELSE 'ok' END AS verdict FROM y""")
def layout_rules(t):
    k = F.col("s_suppkey")
    x = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 5).alias("control"), (k * 37 % 360 - 180).alias("dx"), (k * 53 % 260 - 130).alias("dy"))
    margin, cx, cy = F.col("control") + 15, F.col("dx") + 160, F.col("dy") + 120
    off = (cx < margin) | (cx > 320 - margin) | (cy < margin) | (cy > 240 - margin)
    verdict = F.when(F.col("control") == 4, "unsupported").when(~(F.col("dx").between(-160, 160) & F.col("dy").between(-120, 120)), "out of range").when(off, "off screen").otherwise("ok")
    return x.select("s_suppkey", verdict.alias("verdict"))


@query("""
WITH a AS (SELECT p_partkey, sha256(p_name || '|' || p_size::VARCHAR) AS now, sha256(p_name || '|' || (p_size + (p_partkey % 9 = 0)::INT)::VARCHAR) AS old FROM part)
SELECT p_partkey, now = old AS resumes, now AS fingerprint FROM a""")
def resume_guard(t):
    """A job resumes only if the fingerprint of its input and settings is the recorded one."""
    now = F.sha2(F.concat_ws("|", "p_name", F.col("p_size").cast("string")), 256)
    old = F.sha2(F.concat_ws("|", "p_name", (F.col("p_size") + (F.col("p_partkey") % 9 == 0).cast("int")).cast("string")), 256)
    return t.part.select("p_partkey", now.eqNullSafe(old).alias("resumes"), now.alias("fingerprint"))


@query("""
WITH a AS (SELECT c_custkey, c_nationkey AS stream FROM customer), s AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20)
SELECT c_custkey, n_name AS stream, n_name IS NULL AS missing FROM a LEFT JOIN s ON n_nationkey = stream""")
def stream_lookup(t):
    """Streams by absolute index, and which of them are not there."""
    streams = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("stream"))
    return t.customer.join(streams, "c_nationkey", "left").select("c_custkey", "stream", F.col("stream").isNull().alias("missing"))


@query("""
WITH q AS (SELECT c_nationkey AS queue, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN n < 4 THEN pos WHEN pos = 3 THEN 4 WHEN pos = 4 THEN 3 ELSE pos END AS pos FROM q""")
def move_job(t):
    """The third job of each queue moves one down; nothing moves at a queue's end."""
    q = windows.numbered(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], F.expr("c_custkey div 1048576"), "pos", "n")
    moved = F.when(F.col("n") < 4, F.col("pos")).when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos"))
    return q.select("c_custkey", moved.alias("pos"))


@query("""
SELECT event_id, CASE WHEN d <= 0 THEN 0 WHEN v >= 0 THEN (v + d // 2) // d ELSE -((-v + d // 2) // d) END AS q FROM (SELECT event_id, event_id * 31 % 2001 - 1000 AS v, event_id % 17 - 1 AS d FROM events)""")
def round_div(t):
    k = F.col("event_id")
    return t.events.select("event_id", N.round_div(k * 31 % 2001 - 1000, k % 17 - 1).alias("q"))


@query("SELECT p_partkey, greatest(1, (2 * p_size + 1001) // 2002)::BIGINT AS fps FROM part")
def helper_fps(t):
    """A whole frame rate for tools that know no other: num / den to the nearest, 1 at least."""
    return t.part.select("p_partkey", F.greatest(F.lit(1).cast("long"), N.div(F.col("p_size") * 2 + 1001, 2002)).alias("fps"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '.asset') WHEN 2 THEN concat('a/', p_name) WHEN 3 THEN '..' ELSE concat(p_brand, '?.asset') END"


@query(f"""
SELECT p_partkey, name, name NOT IN ('', '.', '..') AND NOT regexp_matches(name, '[\\\\/:*?"<>|]') AS safe,
       CASE WHEN name LIKE '%_.asset' AND NOT regexp_matches(name, '[\\\\/:*?"<>|]') AND NOT contains(name, '..') THEN left(name, length(name) - 6) END AS reference FROM (SELECT p_partkey, {_NAME} AS name FROM part)""")
def safe_names(t):
    """Whether a name may be written, and the bare reference of an asset's file."""
    name, bad = F.col("name"), F.col("name").rlike(r'[\\/:*?"<>|]')
    rows = t.part.select("p_partkey", F.expr(_NAME).alias("name"))
    bare = F.when(name.rlike(r"(?s)^.+\.asset$") & ~bad & ~name.contains(".."), F.regexp_replace(name, r"\.asset$", ""))
    return rows.select("p_partkey", "name", (~name.isin("", ".", "..") & ~bad).alias("safe"), bare.alias("reference"))


@query("""
SELECT p_partkey, 'encode --in ' || CASE WHEN contains(p_name, ' ') THEN '"' || p_name || '"' ELSE p_name END || ' --kind ' || p_type || ' --size ' || p_size::VARCHAR AS command FROM part""")
def command_preview(t):
    """Arguments as one line; those with a space are quoted."""
    arguments = F.array(F.lit("encode"), F.lit("--in"), F.col("p_name"), F.lit("--kind"), F.col("p_type"), F.lit("--size"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.array_join(F.transform(arguments, lambda a: F.when(a.contains(" "), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ").alias("command"))


@query("""
SELECT DISTINCT p_brand, p_name AS role FROM part p WHERE NOT EXISTS (SELECT 1 FROM part m WHERE m.p_brand = p.p_brand AND m.p_name = p.p_name AND m.p_size > 10)""")
def manifest_references(t):
    """Planned roles that a package's manifest does not mention; its references are parsed names, so they meet by equality."""
    named = t.part.where("p_size > 10").select("p_brand", F.col("p_name").alias("role")).distinct()
    return t.part.select("p_brand", F.col("p_name").alias("role")).distinct().join(named, ["p_brand", "role"], "left_anti")


@query("""
WITH a AS (SELECT conv_id, count(*) FILTER (role = 'user') AS marks, count(*) FILTER (role = 'assistant') AS thumbs FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN marks = thumbs THEN 'thumbnails' ELSE 'labels' END AS shown FROM a""")
def count_match(t):
    """Thumbnails are shown only if there are as many as chapters."""
    a = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("marks"), F.count_if(F.col("role") == "assistant").alias("thumbs"))
    return a.select("conv_id", F.when(F.col("marks") == F.col("thumbs"), "thumbnails").otherwise("labels").alias("shown"))


@query("""
WITH s AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 100) AS fav, bool_or(event_type = 'click' AND value > 90) AS resume, max(event_id) > (SELECT max(event_id) - 100 FROM events) AS recent FROM events GROUP BY 1)
SELECT user_id, CASE WHEN fav THEN 'FAVORITE' WHEN resume THEN 'RESUME' WHEN recent THEN 'RECENT' ELSE 'FORMAT' END AS badge FROM s""")
def priority_badge(t):
    last = t.events.agg((F.max("event_id") - 100).alias("last"))  # one row
    s = t.events.groupBy("user_id").agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("fav"),
        F.bool_or((F.col("event_type") == "click") & (F.col("value") > 90)).alias("resume"),
        F.max("event_id").alias("newest"),
    )
    badge = F.when(F.col("fav"), "FAVORITE").when(F.col("resume"), "RESUME").when(F.col("newest") > F.col("last"), "RECENT").otherwise("FORMAT")
    return s.crossJoin(F.broadcast(last)).select("user_id", badge.alias("badge"))


@query("""
WITH x AS (SELECT vec_id, [round(abs(v) * 255)::INT % 256 FOR v IN embedding[1:3]] AS c FROM embeddings),
     y AS (SELECT vec_id, 298 * (c[1] - 16) + 128 AS l, c[2] - 128 AS u, c[3] - 128 AS v FROM x),
     z AS (SELECT vec_id, least(greatest((l + 409 * v) >> 8, 0), 255) AS r, least(greatest((l - 100 * u - 208 * v) >> 8, 0), 255) AS g, least(greatest((l + 516 * u) >> 8, 0), 255) AS b FROM y)
SELECT vec_id, (((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3))::BIGINT AS packed FROM z""")
def yuv_pack(t):
    c = F.transform(F.slice("embedding", 1, 3), lambda v: F.round(F.abs(v) * 255).cast("int") % 256)
    return t.embeddings.select("vec_id", c.alias("c")).select("vec_id", N.yuv565(*(F.col("c")[k] for k in range(3))).cast("long").alias("packed"))


@query("""
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE '' END, ''), '(untitled)') || CASE WHEN c_nationkey > 5 THEN ' (' || (1980 + c_nationkey)::VARCHAR || ')' ELSE '' END || CASE WHEN c_acctbal > 0 THEN ' - ' || c_mktsegment ELSE '' END AS summary FROM customer""")
def concise_summary(t):
    """Title, year and genre of a film; what is not known is left out."""
    title = F.coalesce(F.nullif(F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).otherwise(""), F.lit("")), F.lit("(untitled)"))
    year = F.when(F.col("c_nationkey") > 5, F.concat(F.lit("("), (F.col("c_nationkey") + 1980).cast("string"), F.lit(")")))
    genre = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("- "), F.col("c_mktsegment")))
    return t.customer.select("c_custkey", F.concat_ws(" ", title, year, genre).alias("summary"))
