"""Join queries: orders as video frames, lineitem as audio, events as points and spans, documents and labels as plan and disk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import joins
from reelspark.plans.registry import query


def _audio(t):
    """Audio by position: lineitem rows counted out in frames of l_orderkey."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("frame")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("bytes"), F.count("*").alias("samples"))


@query("""
WITH a AS (SELECT l_orderkey AS frame, sum(l_linenumber)::BIGINT AS bytes, count(*)::BIGINT AS samples FROM lineitem GROUP BY 1)
SELECT o_orderkey AS frame, coalesce(bytes, 0) AS bytes, coalesce(samples, 0) AS samples FROM orders LEFT JOIN a ON frame = o_orderkey""")
def mux_left_join(t):
    video = t.orders.select(F.col("o_orderkey").alias("frame"))
    return joins.positional(video, _audio(t), "frame", {"bytes": F.lit(0).cast("long"), "samples": F.lit(0).cast("long")})


@query("""
WITH a AS (SELECT l_orderkey + round_even(250 * 48000 / 1000.0 / 2002, 0)::BIGINT AS frame, sum(l_linenumber)::BIGINT AS bytes FROM lineitem GROUP BY 1)
SELECT o_orderkey AS frame, coalesce(bytes, 0) AS bytes FROM orders LEFT JOIN a ON frame = o_orderkey""")
def offset_join(t):
    """Audio that starts 250 ms late: positions move by whole frames, halves to even."""
    shift = F.bround(F.lit(250 * 48000 / 1000.0 / 2002)).cast("long")
    video = t.orders.select(F.col("o_orderkey").alias("frame"))
    moved = _audio(t).select((F.col("frame") + shift).alias("frame"), "bytes")
    return joins.positional(video, moved, "frame", {"bytes": F.lit(0).cast("long")})


@query("""
WITH a AS (SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 10 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 13 > 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only_right' WHEN b.doc_id IS NULL THEN 'only_left' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.size IS DISTINCT FROM b.size""")
def full_outer_diff(t):
    """Two versions of a stream, position by position."""
    docs = t.documents.select("doc_id", F.col("n_chars").alias("size"))
    other = docs.where("doc_id % 13 > 0").withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return joins.difference(docs.where("doc_id % 10 > 0"), other, ["doc_id"], ["size"])


def _at(t):
    return t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, event_id AS cue, us AS start, least(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + 7200000000) AS stop FROM e WHERE event_type IN ('view', 'click')),
     p AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase')
SELECT p.event_id, min(s.cue) AS cue FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.start <= p.us AND p.us < s.stop GROUP BY 1""")
def interval_join(t):
    """The cue that is on at a time: start <= time < end; of several the first."""
    e = _at(t)
    end = F.least(F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id")), F.col("at") + 7_200_000_000)
    spans = e.where("event_type IN ('view', 'click')").select("user_id", F.col("event_id").alias("cue"), F.col("at").alias("start"), end.alias("stop")).where("stop IS NOT NULL")
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    return joins.interval(points, spans, ["user_id"], "at", "start", "stop", ["cue"], 3_600_000_000).select("event_id", F.col("span_cue").alias("cue"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
SELECT v.event_id, p.event_id AS point, v.us - p.us AS behind FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.us >= p.us""")
def asof_join(t):
    """The greatest seek point at or before each target."""
    e = _at(t)
    points = e.where("event_type = 'purchase'").withColumn("point", F.col("event_id")).withColumn("when", F.col("at"))
    probes = e.where("event_type = 'view'").select("event_id", "user_id", "at")
    found = joins.asof(probes, points.select("user_id", "at", "point", "when", "event_id"), ["user_id"], "at", ["point", "when"], "event_id", cell=86_400_000_000)
    return found.select("event_id", F.col("point_point").alias("point"), (F.col("at") - F.col("point_when")).alias("behind"))


@query("""
WITH p AS (SELECT doc_id, n_chars % 5 AS h FROM documents WHERE doc_id % 9 > 0), e AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE n_chars % 5 END AS h FROM documents WHERE doc_id % 6 > 0)
SELECT coalesce(p.doc_id, e.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'removed' WHEN e.doc_id IS NULL THEN 'added' WHEN p.h = e.h THEN 'unchanged' ELSE 'changed' END AS status FROM p FULL JOIN e ON p.doc_id = e.doc_id""")
def diff_status(t):
    planned = t.documents.where("doc_id % 9 > 0").select("doc_id", (F.col("n_chars") % 5).alias("h"))
    existing = t.documents.where("doc_id % 6 > 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("n_chars") % 5).alias("h"))
    return joins.plan_status(planned, existing, "doc_id", "h")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner FROM documents")
def dedup_owner(t):
    """The first document with the same bytes owns them."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return joins.first_owner(rows, "digest", "doc_id").select("doc_id", "owner")


@query("""
SELECT n_nationkey::BIGINT AS n_nationkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS passed FROM nation""")
def not_exists_checklist(t):
    """A rule passes if no error of its category was found."""
    errors = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("found", F.lit(True))
    return t.nation.join(errors, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("found").isNull().alias("passed"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_missing(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pairwise_self_join(t):
    """Folders on the same volume, each pair once."""
    a = t.supplier.select(F.col("s_suppkey").alias("first"), "s_nationkey")
    b = t.supplier.select(F.col("s_suppkey").alias("second"), "s_nationkey")
    return a.join(b, "s_nationkey").where("first < second").select("first", "second")


@query("""
WITH x AS (SELECT s_suppkey, s_nationkey AS nk, (s_suppkey * 37 % 160)::BIGINT AS px, (s_suppkey * 53 % 120)::BIGINT AS py FROM supplier)
SELECT a.s_suppkey AS first, b.s_suppkey AS second FROM x a JOIN x b ON a.s_suppkey < b.s_suppkey AND (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) < 100""")
def theta_self_join(t):
    """Controls that overlap: centres nearer than their radii together. Cells of that width limit who meets whom."""
    x = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 37 % 160).alias("px"), (F.col("s_suppkey") * 53 % 120).alias("py"))
    cell = lambda c, d=0: F.floor(F.col(c) / 10) + d
    near = F.explode(F.array(*(F.struct(cell("px", i).alias("cx"), cell("py", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = x.select(F.col("s_suppkey").alias("first"), F.col("px").alias("ax"), F.col("py").alias("ay"), near.alias("c")).select("first", "ax", "ay", "c.cx", "c.cy")
    b = x.select(F.col("s_suppkey").alias("second"), "px", "py", cell("px").alias("cx"), cell("py").alias("cy"))
    d2 = (F.col("ax") - F.col("px")) * (F.col("ax") - F.col("px")) + (F.col("ay") - F.col("py")) * (F.col("ay") - F.col("py"))
    return a.join(b, ["cx", "cy"]).where((F.col("first") < F.col("second")) & (d2 < 100)).select("first", "second")


@query("""
SELECT source AS section, max(doc_id) + 1 AS stop, (SELECT max(doc_id) + 1 FROM documents) AS total, max(doc_id) + 1 <= (SELECT count(*) FROM documents) AS fits FROM documents GROUP BY 1""")
def scalar_subquery(t):
    """Sections against the container's own totals."""
    total = t.documents.agg((F.max("doc_id") + 1).alias("total"), F.count("*").alias("pages"))  # one row
    sections = t.documents.groupBy(F.col("source").alias("section")).agg((F.max("doc_id") + 1).alias("stop"))
    return sections.crossJoin(F.broadcast(total)).select("section", "stop", "total", (F.col("stop") <= F.col("pages")).alias("fits"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE coalesce(new_name, c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'manual' WHEN new_name IS NOT NULL THEN 'source' ELSE 'none' END AS provenance
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS new_name FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def conditional_upsert(t):
    """An import never overwrites what was edited by hand."""
    new = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("new_name"))
    manual = F.col("c_custkey") % 3 == 0
    joined = t.customer.join(new, "c_custkey", "left")
    name = F.when(manual, F.col("c_name")).otherwise(F.coalesce("new_name", "c_name"))
    return joined.select("c_custkey", name.alias("name"), F.when(manual, "manual").when(F.col("new_name").isNotNull(), "source").otherwise("none").alias("provenance"))


@query("""
SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), max(CASE WHEN event_type = 'view' THEN event_id END)) AS asset FROM events WHERE event_id % 20 < 7 GROUP BY 1""")
def pivot_fallback(t):
    """The focused asset, or else the idle one."""
    rows = t.events.where("event_id % 20 < 7").groupBy("user_id").pivot("event_type", ["purchase", "view"]).agg(F.max("event_id"))
    return rows.select("user_id", F.coalesce("purchase", "view").alias("asset"))


@query("""
WITH a AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0 GROUP BY 1),
     c AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders GROUP BY 1),
     x AS (SELECT c_custkey, CASE WHEN a.v % 5 > 0 THEN a.v END AS v1, CASE WHEN b.v % 5 > 0 THEN b.v END AS v2, CASE WHEN c.v % 5 > 0 THEN c.v END AS v3 FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey)
SELECT c_custkey, coalesce(v1, v2, v3) AS frame, (CASE WHEN v1 IS NOT NULL THEN 1 WHEN v2 IS NOT NULL THEN 2 WHEN v3 IS NOT NULL THEN 3 END)::BIGINT AS tier FROM x""")
def tiered_fallback(t):
    """Saved state by its current, earlier or oldest key, whichever is there and passes the identity check."""
    newest = lambda rows: rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("frame"))
    tiers = [newest(t.orders.where("o_orderstatus = 'F' AND o_orderkey % 4 = 0")), newest(t.orders.where("o_orderstatus = 'O' AND o_orderkey % 3 = 0")), newest(t.orders)]
    found = joins.tiered(t.customer.select("c_custkey"), tiers, "c_custkey", "frame", lambda s: s["frame"] % 5 > 0)
    return found.select("c_custkey", "frame", F.col("tier").cast("long").alias("tier"))
