"""JSON, map and array queries over events, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.functions import strings as S
from reelspark.plans.registry import query
from reelspark.session import spread

_PROBE = """concat('{{"duration": "', cast(event_id % 500 AS {s}), '.5", "streams": [{{"kind": "video", "fps": "24000/1001", "duration": "', cast(event_id % 300 AS {s}),
 '"}}, {{"kind": "', CASE WHEN event_id % 3 = 0 THEN 'audio' ELSE 'subtitle' END, '", "duration": "', cast(event_id % 700 AS {s}), '"}}]}}')"""
_STREAMS = "struct<duration:string,streams:array<struct<kind:string,fps:string,duration:string>>>"


def _probe(t):
    return spread(t.events.select("event_id")).select("event_id", F.from_json(F.expr(_PROBE.format(s="STRING")), _STREAMS).alias("p"))


@query(f"""
WITH x AS (SELECT event_id, {_PROBE.format(s="VARCHAR")}::JSON AS p FROM events)
SELECT event_id, (p->>'$.duration')::DOUBLE AS duration, json_array_length(p, '$.streams')::BIGINT AS n_streams,
       (CASE WHEN p->>'$.streams[1].kind' = 'audio' THEN 1 ELSE 0 END)::BIGINT AS n_audio, split_part(p->>'$.streams[0].fps', '/', 1)::BIGINT AS fps_num,
       CASE WHEN p->>'$.streams[1].kind' = 'audio' THEN '' ELSE 'no audio' END AS warnings FROM x""")
def json_extract(t):
    """A typed record of a probe's answer, with warnings instead of errors."""
    audio = F.size(F.filter("p.streams", lambda s: s["kind"] == "audio")).cast("long")
    fps = N.parse_frame_rate(F.get("p.streams", F.lit(0))["fps"])
    warnings = F.array_join(F.filter(F.array(F.when(audio == 0, "no audio"), F.when(F.col("fps").isNull(), "bad frame rate")), lambda w: w.isNotNull()), ", ")
    rows = _probe(t).withColumn("fps", fps)
    return rows.select("event_id", F.col("p.duration").try_cast("double").alias("duration"), F.size("p.streams").cast("long").alias("n_streams"), audio.alias("n_audio"), F.col("fps.num").alias("fps_num"), warnings.alias("warnings"))


_LOG = """concat(CASE WHEN event_id % 4 = 0 THEN 'PSNR ' ELSE 'STATS ' END, 'frames=', cast(event_id AS {s}), ' skip=', CASE WHEN event_id % 5 = 0 THEN 'many' ELSE cast(event_id % 17 AS {s}) END, ' stray other=7')"""


@query(f"""
WITH x AS (SELECT event_id, {_LOG.format(s="VARCHAR")} AS line FROM events)
SELECT event_id, CASE WHEN line LIKE 'STATS %' THEN try_cast(regexp_extract(line, 'frames=([^ ]*)', 1) AS BIGINT) END AS frames, CASE WHEN line LIKE 'STATS %' THEN try_cast(regexp_extract(line, 'skip=([^ ]*)', 1) AS BIGINT) END AS skip,
       CASE WHEN line LIKE 'STATS %' THEN 2 - (event_id % 5 = 0)::BIGINT END AS known FROM x""")
def kv_log_parse(t):
    """Known keys of a log line with whole numbers; other keys and bad tokens are skipped."""
    rows = t.events.select("event_id", S.key_values(F.expr(_LOG.format(s="STRING")), "STATS ").alias("kv"))
    kept = F.map_filter("kv", lambda k, v: k.isin("frames", "skip") & v.try_cast("long").isNotNull())
    return rows.select("event_id", kept["frames"].try_cast("long").alias("frames"), kept["skip"].try_cast("long").alias("skip"), F.when(F.col("kv").isNotNull(), F.size(kept).cast("long")).alias("known"))


@query("SELECT event_id, 'k=' || (props->>'$.k') || ';type=' || event_type AS entries FROM events")
def map_transform(t):
    """Keys in lower case, entries in order."""
    m = F.create_map(F.lit("TYPE"), F.col("event_type"), F.lit("K"), F.element_at(F.from_json("props", "map<string,string>"), "k"))
    entries = F.array_sort(F.map_entries(F.transform_keys(m, lambda k, v: F.lower(k))))
    return t.events.select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@query("""
WITH x AS (SELECT vec_id, [round(v::DOUBLE * 127)::BIGINT FOR v IN embedding[1:1 + vec_id % 9]] AS a FROM embeddings)
SELECT vec_id, array_to_string(list_concat(a, [0 FOR i IN range(8)])[1:8], ',') AS samples FROM x""")
def array_pad(t):
    """Exactly eight samples: short ones are padded with zeros, long ones cut."""
    a = F.transform(F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 9).cast("int")), lambda v: F.round(v.cast("double") * 127).cast("long"))
    padded = F.slice(F.concat(a, F.array_repeat(F.lit(0).cast("long"), 8)), 1, 8)
    return t.embeddings.select("vec_id", F.array_join(F.transform(padded, lambda v: v.cast("string")), ",").alias("samples"))


@query("""
SELECT vec_id, round(list_sum([v::DOUBLE FOR v IN [embedding[2 * i + 1] FOR i IN range(32)]]), 5) AS left_sum, round(list_sum([v::DOUBLE FOR v IN [embedding[2 * i + 2] FOR i IN range(32)]]), 5) AS right_sum FROM embeddings""")
def deinterleave(t):
    total = lambda side: F.round(F.aggregate(F.filter("embedding", lambda _, i: i % 2 == side), F.lit(0.0), lambda a, v: a + v.cast("double")), 5)
    return t.embeddings.select("vec_id", total(0).alias("left_sum"), total(1).alias("right_sum"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN greatest(event_id % 300, event_id % 700)::DOUBLE ELSE event_id % 500 + 0.5 END::DOUBLE AS duration FROM events")
def duration_fallback(t):
    """The container's duration, or else the longest stream's."""
    own = F.when(F.col("event_id") % 4 != 0, F.col("p.duration").try_cast("double"))
    longest = F.array_max(F.transform("p.streams", lambda s: s["duration"].try_cast("double")))
    return _probe(t).select("event_id", F.coalesce(own, longest).alias("duration"))


@query("""
SELECT p_partkey, 'keep=' || (CASE WHEN p_size > 25 THEN p_size ELSE CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 8 END END)::VARCHAR || ' qp=' || (CASE WHEN p_partkey % 3 = 0 THEN 24 ELSE 34 END)::VARCHAR AS flags FROM part""")
def override_coalesce(t):
    """Settings: defaults, then the preset, then explicit values; the last that says something counts; flags in order of name."""
    preset = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("keep"), F.lit(16), F.lit("qp"), F.lit(24)))
    explicit = F.when(F.col("p_size") > 25, F.create_map(F.lit("keep"), F.col("p_size")))
    default = F.create_map(F.lit("qp"), F.lit(34), F.lit("keep"), F.lit(8))
    merged = F.transform_values(default, lambda k, v: F.coalesce(explicit[k], preset[k], v))
    flags = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t.part.select("p_partkey", F.array_join(flags, " ").alias("flags"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS title FROM part")
def priority_coalesce(t):
    """The first tag of a priority list that is not empty; keys in any case."""
    tags = F.create_map(F.lit("Title"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(""), F.lit("SHOW"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")), F.lit("comment"), F.col("p_type"))
    low = F.transform_keys(tags, lambda k, v: F.lower(k))
    return t.part.select("p_partkey", F.coalesce(*(S.null_if_empty(low[k]) for k in ("title", "show", "comment"))).alias("title"))


@query("""
SELECT p.p_partkey, CASE WHEN p.p_partkey % 4 = 0 THEN i.p_size ELSE p.p_size END::BIGINT AS size, CASE WHEN p.p_partkey % 4 = 0 OR p.p_partkey % 10 = 3 THEN i.p_type ELSE p.p_type END AS kind
FROM part p JOIN part i ON i.p_partkey = p.p_partkey - p.p_partkey % 2""")
def group_inherit(t):
    """A focused control (odd) takes a group of fields from its idle one where it inherits, and else missing ones."""
    idle = t.part.select((F.col("p_partkey")).alias("idle_key"), F.col("p_size").alias("idle_size"), F.col("p_type").alias("idle_type"))
    rows = t.part.withColumn("inherits", F.col("p_partkey") % 4 == 0).withColumn("own_type", F.when(F.col("p_partkey") % 10 != 3, F.col("p_type")))
    joined = rows.join(idle, F.col("p_partkey") - F.col("p_partkey") % 2 == F.col("idle_key"))
    size = F.when(F.col("inherits"), F.col("idle_size")).otherwise(F.coalesce("p_size", "idle_size"))
    kind = F.when(F.col("inherits"), F.col("idle_type")).otherwise(F.coalesce("own_type", "idle_type"))
    return joined.select("p_partkey", size.cast("long").alias("size"), kind.alias("kind"))
