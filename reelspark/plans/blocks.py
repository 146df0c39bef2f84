"""Block and audit queries: an embedding's 64 numbers as a block of 8 x 8 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.numbers import div
from reelspark.operators import windows
from reelspark.plans.registry import query

_BLOCK = "[round(v::DOUBLE * 127)::BIGINT + 128 FOR v IN embedding]"


def _blocks(t):
    block = F.transform("embedding", lambda v: F.round(v.cast("double") * 127).cast("long") + 128)
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), block.alias("b"))


def _with_previous(t):
    return windows.previous(_blocks(t), ["label"], "vec_id", "b", F.expr("vec_id div 1048576"), "p")


def _sum(array, start=0):
    return F.aggregate(array, F.lit(start).cast("long"), lambda a, x: a + x)


def sad(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def ssd(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


@query(f"""
WITH x AS (SELECT vec_id, label, {_BLOCK} AS b FROM embeddings), y AS (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM x)
SELECT vec_id, list_sum([abs(b[i] - p[i]) FOR i IN range(1, 65)])::BIGINT AS sad, ((list_sum([(b[i] - p[i]) * (b[i] - p[i]) FOR i IN range(1, 65)]) + 4)::BIGINT >> 3) AS ssd, list_max([abs(b[i] - p[i]) FOR i IN range(1, 65)])::BIGINT AS most FROM y WHERE p IS NOT NULL""")
def block_sad(t):
    """Distances of each block to its predecessor."""
    rows = _with_previous(t).where("p IS NOT NULL")
    most = F.array_max(F.zip_with("b", "p", lambda x, y: F.abs(x - y)))
    return rows.select("vec_id", sad("b", "p").alias("sad"), F.shiftright(ssd("b", "p") + 4, 3).alias("ssd"), most.alias("most"))


@query(f"""
WITH x AS (SELECT vec_id, {_BLOCK} AS b FROM embeddings), y AS (SELECT *, list_sum(b)::BIGINT // 64 AS mean FROM x)
SELECT vec_id, mean, (list_sum([(v - mean) * (v - mean) FOR v IN b]) // 64)::BIGINT AS variance FROM y""")
def block_stats(t):
    """Mean and variance of a block, both truncated."""
    rows = _blocks(t).withColumn("mean", div(_sum(F.col("b")), 64))
    variance = div(F.aggregate("b", F.lit(0).cast("long"), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))), 64)
    return rows.select("vec_id", "mean", variance.alias("variance"))


@query(f"""
WITH x AS (SELECT vec_id, label, {_BLOCK} AS b FROM embeddings), y AS (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM x),
     c AS (SELECT vec_id, 0 AS mode, CASE WHEN p IS NOT NULL THEN list_sum([(b[i] - p[i]) * (b[i] - p[i]) FOR i IN range(1, 65)])::BIGINT END AS cost FROM y
           UNION ALL SELECT vec_id, 1, list_sum([(v - 128) * (v - 128) FOR v IN b])::BIGINT + 7 * 2 FROM x UNION ALL SELECT vec_id, 2, 7 * 64 + 90000 FROM x)
SELECT vec_id, arg_min(mode, (cost, mode))::BIGINT AS mode, min(cost)::BIGINT AS cost FROM c WHERE cost IS NOT NULL GROUP BY 1""")
def argmin_cost(t):
    """The cheapest mode: distortion and rate; the first of equals."""
    rows = _with_previous(t)
    flat = F.aggregate("b", F.lit(0).cast("long"), lambda a, v: a + (v - 128) * (v - 128))
    costs = (F.when(F.col("p").isNotNull(), ssd("b", "p")), flat + 14, F.lit(7 * 64 + 90000).cast("long"))
    tried = F.filter(F.array(*(F.struct(c.alias("cost"), F.lit(k).cast("long").alias("mode")) for k, c in enumerate(costs))), lambda s: s["cost"].isNotNull())
    return rows.select("vec_id", F.array_min(tried).alias("best")).select("vec_id", "best.mode", "best.cost")


@query("""
WITH a AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS attempt, n_chars FROM documents), b AS (SELECT doc_id, attempt, least(51, 30 + 6 * attempt) AS qp, n_chars * (10 - attempt) // 10 + doc_id * (attempt + 1) % 37 AS size FROM a),
     c AS (SELECT *, min(CASE WHEN size <= 1500 THEN attempt ELSE 3 END) OVER (PARTITION BY doc_id) AS stop FROM b)
SELECT doc_id, arg_min(qp, (size, attempt))::BIGINT AS qp, min(size)::BIGINT AS size, max(attempt)::BIGINT AS retries FROM c WHERE attempt <= stop GROUP BY 1""")
def retry_ladder(t):
    """Up to three coarser attempts until a packet fits; the smallest is kept."""
    tries = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.struct(a.cast("long").alias("attempt"), F.least(F.lit(51), 30 + 6 * a).cast("long").alias("qp"))))
    size = F.expr("n_chars * (10 - attempt) div 10 + doc_id * (attempt + 1) % 37")
    rows = t.documents.select("doc_id", "n_chars", tries.alias("t")).select("doc_id", "n_chars", "t.*").withColumn("size", size)
    best = F.array_sort(F.collect_list(F.struct("attempt", "qp", "size")))  # four attempts at most
    out = rows.groupBy("doc_id").agg(best.alias("all"))
    stop = F.coalesce(F.array_min(F.transform(F.filter("all", lambda s: s["size"] <= 1500), lambda s: s["attempt"])), F.lit(3))
    made = out.withColumn("stop", stop).withColumn("made", F.filter("all", lambda s: s["attempt"] <= F.col("stop")))
    least = F.array_min(F.transform("made", lambda s: F.struct(s["size"].alias("size"), s["attempt"].alias("attempt"), s["qp"].alias("qp"))))
    return made.select("doc_id", least["qp"].alias("qp"), least["size"].alias("size"), (F.size("made") - 1).cast("long").alias("retries"))


@query("""
SELECT rule, bad::BIGINT AS bad FROM (
  SELECT 'quantity out of range' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS bad FROM lineitem UNION ALL SELECT 'discount above half', count(*) FILTER (l_discount > 0.5) FROM lineitem
  UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'line without order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
  UNION ALL SELECT 'order without line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey))""")
def audit_constraints(t):
    """How many rows break each constraint of a strict audit; both tables are read once and dealt by order."""
    one = lambda c: F.sum(c.cast("long"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", (~F.col("l_quantity").between(1, 50)).alias("quantity"), (F.col("l_discount") > 0.5).alias("discount")).repartition("l_orderkey")
    each = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), one(F.col("quantity")).alias("quantity"), one(F.col("discount")).alias("discount"))
    by_order = each.groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), F.sum("discount").alias("discount"), one(F.col("n") > 1).alias("repeated"))
    orders = t.orders.groupBy("o_orderkey").agg(F.count("*").alias("orders"))
    both = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "full_outer")
    bad = {
        "quantity out of range": "quantity", "discount above half": "discount", "repeated line": "repeated",
        "line without order": F.when(F.col("orders").isNull(), F.col("n")), "order without line": F.when(F.col("n").isNull(), F.col("orders")),
    }
    sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_{k}") for k, c in enumerate(bad.values())))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"_{k}").alias("bad")) for k, rule in enumerate(bad)))).alias("s")).select("s.*")
