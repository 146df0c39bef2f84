"""Aggregate queries: documents as packets (doc_id = frame, n_chars = size, source = stream), lineitem and events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import packets
from reelspark.plans.registry import query

_RANKS = ", ".join(f"l[least(n - 1, n * {p} // 100) + 1]::BIGINT AS p{p}" for p in packets.PERCENTILES)


@query(f"""
WITH g AS (SELECT source AS stream, count(*)::BIGINT AS n, list_sort(list(n_chars)) AS l, round(sum(n_chars)::DOUBLE / count(*), 6) AS avg_size FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT stream, n AS n_packets, l[1]::BIGINT AS min_size, l[n]::BIGINT AS max_size, avg_size, {_RANKS} FROM g""")
def packet_report(t):
    return packets.report(t.documents.withColumnRenamed("source", "stream"), "n_chars", ["stream"])


@query("""
WITH g AS (SELECT count(*)::BIGINT AS n, list_sort(list(n_chars)) AS l FROM documents)
SELECT p::BIGINT AS p, l[least(n - 1, n * p // 100) + 1]::BIGINT AS value FROM g, (VALUES (50), (90), (95), (99)) v(p) WHERE n > 0""")
def packet_percentiles(t):
    return packets.percentiles(t.documents, "n_chars")


@query("""
WITH b AS (SELECT unnest([0, 2048, 5120, 10240, 15360, 20480, 30720, 40960])::BIGINT AS lo, unnest([2048, 5120, 10240, 15360, 20480, 30720, 40960, 999999])::BIGINT AS hi)
SELECT lo, hi, count(n_chars)::BIGINT AS n FROM b LEFT JOIN documents ON n_chars >= lo AND n_chars < hi GROUP BY 1, 2""")
def packet_histogram(t):
    return packets.histogram(t.documents, "n_chars")


@query("""
SELECT t::BIGINT AS threshold, count(*) FILTER (n_chars >= t)::BIGINT AS n_over, round(count(*) FILTER (n_chars >= t) * 100.0::DOUBLE / count(*), 6) AS pct,
       t <= 15360 AND count(*) FILTER (n_chars >= t) * 100.0::DOUBLE / count(*) > 10 AS warn
FROM documents, (VALUES (10240), (15360), (20480), (30720), (40960)) v(t) GROUP BY t""")
def threshold_counts(t):
    return packets.thresholds(t.documents, "n_chars")


@query("""
SELECT source AS stream, arg_min(doc_id, (-n_chars, doc_id)) AS frame, max(n_chars)::BIGINT AS size, arg_min(lang, (-n_chars, doc_id)) AS lang,
       arg_min(doc_id, (-n_chars, doc_id)) % 120 = 0 AS on_chunk FROM documents GROUP BY 1""")
def argmax_first(t):
    rows = t.documents.select(F.col("source").alias("stream"), F.col("doc_id").alias("frame"), "n_chars", "lang")
    best = packets.largest_first(rows, "n_chars", "frame", ["stream"], "lang")
    return best.withColumn("on_chunk", F.col("frame") % 120 == 0)


@query("""
WITH s AS (SELECT l_returnflag, l_suppkey, count(*) - 5 AS w, avg(l_quantity) AS db FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*)::BIGINT AS segments, round(sum(db * w) / sum(w), 6) AS db FROM s WHERE w > 0 GROUP BY 1""")
def weighted_avg(t):
    """Mean of the segments' values weighted by frames; segments without positive weight are left out."""
    segments = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg((F.count("*") - 5).alias("w"), F.avg("l_quantity").alias("db"))
    return segments.where("w > 0").groupBy("l_returnflag").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("db") * F.col("w")) / F.sum("w"), 6).alias("db"))


@query("""
WITH e AS (SELECT label, round(unnest(embedding)::DOUBLE * 127)::BIGINT AS d FROM embeddings),
     s AS (SELECT label, sum(d * d)::BIGINT AS sse, count(*)::BIGINT AS n FROM e GROUP BY 1)
SELECT label::BIGINT AS label, sse, n, CASE WHEN sse = 0 THEN 99.0 ELSE round(10 * log10(65025.0 * n / sse), 6) END AS psnr FROM s""")
def psnr_agg(t):
    d = F.round(F.col("x").cast("double") * 127).cast("long")
    blocks = t.embeddings.select("label", F.explode("embedding").alias("x"))
    s = blocks.groupBy(F.col("label").cast("long").alias("label")).agg(F.sum(d * d).alias("sse"), F.count("*").alias("n"))
    return s.withColumn("psnr", F.when(F.col("sse") == 0, 99.0).otherwise(F.round(10 * F.log10(F.lit(65025.0) * F.col("n") / F.col("sse")), 6)))


@query("""
WITH m AS (SELECT event_type AS key, (props->>'$.k')::BIGINT AS v FROM events UNION ALL SELECT 'total', (props->>'$.k')::BIGINT FROM events)
SELECT key, sum(v)::BIGINT AS total, count(v)::BIGINT AS n FROM m GROUP BY 1""")
def map_sum(t):
    """Maps added up key by key."""
    k = F.element_at(F.from_json("props", "map<string,bigint>"), "k")
    pairs = F.map_from_arrays(F.array(F.col("event_type"), F.lit("total")), F.array(k, k))
    return t.events.select(F.explode(pairs)).groupBy("key").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


@query("""
SELECT l_returnflag, count(*) FILTER (l_discount > 0.05)::BIGINT AS affected, round(avg(l_linenumber) FILTER (l_discount > 0.05), 6) AS avg_retries,
       max(l_extendedprice) AS max_before, max(l_extendedprice) FILTER (l_discount > 0.05) AS max_after,
       count(*) FILTER (l_extendedprice > 60000)::BIGINT AS still_over, count(*) FILTER (l_tax = 0)::BIGINT AS unmoved FROM lineitem GROUP BY 1""")
def conditional_agg(t):
    hit = F.col("l_discount") > 0.05
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_if(hit).alias("affected"),
        F.round(F.avg(F.when(hit, F.col("l_linenumber"))), 6).alias("avg_retries"),
        F.max("l_extendedprice").alias("max_before"),
        F.max(F.when(hit, F.col("l_extendedprice"))).alias("max_after"),
        F.count_if(F.col("l_extendedprice") > 60000).alias("still_over"),
        F.count_if(F.col("l_tax") == 0).alias("unmoved"),
    )


@query("""
WITH s AS (SELECT event_type AS stage, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1)
SELECT stage, cents, CASE WHEN sum(cents) OVER () = 0 THEN 0.0 ELSE round(cents * 100.0::DOUBLE / sum(cents) OVER (), 3) END AS percent_total FROM s""")
def percent_of_total(t):
    stages = t.events.groupBy(F.col("event_type").alias("stage")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    total = stages.agg(F.sum("cents").alias("total"))  # one row
    return stages.crossJoin(F.broadcast(total)).select("stage", "cents", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("cents") * 100.0 / F.col("total"), 3)).alias("percent_total"))


@query("SELECT source AS stream, max(doc_id) + 1 AS total_frames, least(count(*), 4096)::BIGINT AS n_points FROM documents GROUP BY 1")
def max_plus_one(t):
    """Frames of a stream, and the points of its seek index, which holds at most 4096."""
    return t.documents.groupBy(F.col("source").alias("stream")).agg((F.max("doc_id") + 1).alias("total_frames"), F.least(F.count("*"), F.lit(4096)).cast("long").alias("n_points"))


@query("""
WITH g AS (SELECT unnest(['added', 'changed', 'removed', 'unchanged']) AS status),
     x AS (SELECT n_name, CASE n_regionkey WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status FROM nation)
SELECT g.status, count(n_name)::BIGINT AS n, coalesce(string_agg(n_name, ', ' ORDER BY n_name), '') AS labels FROM g LEFT JOIN x USING (status) GROUP BY 1""")
def grouped_list(t):
    """All four groups of a change summary, empty ones too, with their labels in order."""
    status = F.when(F.col("n_regionkey") == 0, "added").when(F.col("n_regionkey") == 1, "changed").otherwise("unchanged")
    found = t.nation.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("labels"))
    groups = t.spark.createDataFrame([("added",), ("changed",), ("removed",), ("unchanged",)], "status string")
    return groups.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("labels", F.lit("")).alias("labels"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey > 4 THEN round(c_acctbal * 100)::BIGINT + c_nationkey * 1000 END AS total,
       CASE WHEN c_nationkey > 4 THEN 500000 - (round(c_acctbal * 100)::BIGINT + c_nationkey * 1000) END AS free_after FROM customer""")
def null_propagating_sum(t):
    """A plan's total is unknown if a part is."""
    part = F.when(F.col("c_nationkey") > 4, F.col("c_nationkey").cast("long") * 1000)
    total = F.round(F.col("c_acctbal") * 100).cast("long") + part
    return t.customer.select("c_custkey", total.alias("total"), (F.lit(500000) - total).alias("free_after"))


@query("SELECT l_linestatus, round(avg((l_discount > 0.03)::INT), 9) AS coverage, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def ratio_agg(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg((F.col("l_discount") > 0.03).cast("int")), 9).alias("coverage"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("n")).where("n > 1")
