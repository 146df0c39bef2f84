"""Projects, queues, caches and reports: tables that are written, read back and compared, and containers with parts behind them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.operators import codecs, rangecoder, video
from reelspark.plans.containers import FRAMES, files, sync_mark
from reelspark.plans.registry import query
from reelspark.session import shared_path
from reelspark.sources import container, textfiles


def _back(t, rows, name: str, kind: str = "parquet", **options):
    """rows as written to a fresh folder and read again with their own schema."""
    path = shared_path(t.spark, name)
    rows.write.format(kind).options(**options).save(path)
    return t.spark.read.format(kind).schema(rows.schema).options(**options).load(path)


@query("""
SELECT event_type AS stage, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ms, '{"stage":"' || event_type || '","n":' || count(*) || ',"ms":' || sum(event_id)::BIGINT || '}' AS json, event_type || ',' || count(*) || ',' || sum(event_id)::BIGINT AS csv
FROM events GROUP BY 1""")
def stage_report(t):
    """Times of each stage as JSON lines and as CSV, both read back as text from what the writers wrote."""
    stages = t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ms"))
    lines = {}
    for kind in ("json", "csv"):
        stages.write.format(kind).save(path := shared_path(t.spark, f"stages-{kind}"))
        lines[kind] = t.spark.read.text(path).withColumnRenamed("value", kind)
    stage = {"json": F.get_json_object("json", "$.stage"), "csv": F.split_part("csv", F.lit(","), F.lit(1))}
    out = stages
    for kind, found in lines.items():
        out = out.join(found.withColumn("stage", stage[kind]), "stage")
    return out.select("stage", "n", "ms", "json", "csv")


@query("SELECT conv_id, turn, role, length(text)::BIGINT AS size, 'project ' || conv_id AS title FROM conversations")
def project_round_trip(t):
    """A project as one JSON document of its sections, saved and loaded with a schema."""
    section = F.struct("turn", "role", F.length("text").cast("long").alias("size"))
    projects = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(section)).alias("sections")).withColumn("title", F.concat(F.lit("project "), F.col("conv_id").cast("string")))
    loaded = _back(t, projects, "projects", "json")
    return loaded.select("conv_id", "title", F.explode("sections").alias("s")).select("conv_id", "s.turn", "s.role", "s.size", "title")


@query("SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS state, (o_orderkey % 7)::BIGINT AS priority FROM orders WHERE o_orderstatus <> 'O'")
def queue_save(t):
    """A queue saved twice: the second table takes the place of the first as a whole, or not at all."""
    path = shared_path(t.spark, "queue")
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("state"), (F.col("o_orderkey") % 7).alias("priority"))
    jobs.withColumn("state", F.lit("pending")).write.parquet(path)
    jobs.where("state <> 'running'").write.mode("overwrite").parquet(path)
    return t.spark.read.schema(jobs.schema).parquet(path)


@query("""
WITH now AS (SELECT doc_id, 'f' || doc_id AS path, n_chars AS size, doc_id % 11 AS mtime, doc_id % 2 = 0 AS hashed FROM documents),
     kept AS (SELECT 'f' || doc_id AS path, n_chars + (doc_id % 5 = 0)::INT AS size, doc_id % 11 + (doc_id % 7 = 0)::INT AS mtime, doc_id % 3 > 0 AS hashed, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 2 END AS version, lang AS found FROM documents)
SELECT n.doc_id, k.path IS NOT NULL AS hit, k.found FROM now n LEFT JOIN kept k ON n.path = k.path AND n.size = k.size AND n.mtime = k.mtime AND n.hashed = k.hashed AND k.version = 2""")
def probe_cache(t):
    """A cached probe counts only if path, size, time, hash flag and version are all the same."""
    k = F.col("doc_id")
    path = F.concat(F.lit("f"), k.cast("string"))
    now = t.documents.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (k % 11).alias("mtime"), (k % 2 == 0).alias("hashed"), F.lit(2).alias("version"))
    kept = t.documents.select(
        path.alias("path"), (F.col("n_chars") + (k % 5 == 0).cast("int")).alias("size"), (k % 11 + (k % 7 == 0).cast("int")).alias("mtime"), (k % 3 > 0).alias("hashed"),
        F.when(k % 13 == 0, 1).otherwise(2).alias("version"), F.col("lang").alias("found"), F.lit(True).alias("known"),
    )
    both = now.join(_back(t, kept, "probes"), ["path", "size", "mtime", "hashed", "version"], "left")
    return both.select("doc_id", F.col("known").isNotNull().alias("hit"), "found")


@query("""
WITH x AS (SELECT p_partkey, lower(p_brand) || '_' || p_size || '.mivftheme' AS target FROM part)
SELECT target, min(p_partkey) AS source, count(*)::BIGINT - 1 AS repeated FROM x GROUP BY 1""")
def export_targets(t):
    """Files of a package: each target is written once, from the first source that names it; readers see the whole package or none of it."""
    target = F.concat(F.lower("p_brand"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".mivftheme"))
    plan = t.part.groupBy(target.alias("target")).agg(F.min("p_partkey").alias("source"), (F.count("*") - 1).alias("repeated"))
    return _back(t, plan, "package")


@query("""
WITH x AS (SELECT source, doc_id // 50 AS part, sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END)::BIGINT AS size FROM documents WHERE doc_id // 50 % 4 <> 1 GROUP BY 1, 2), y AS (SELECT DISTINCT source, doc_id // 50 AS part FROM documents)
SELECT y.source, y.part, CASE WHEN x.part IS NULL THEN 'missing' WHEN size > 0 THEN 'ok' ELSE 'empty' END AS verdict FROM y LEFT JOIN x ON x.source = y.source AND x.part = y.part""")
def output_check(t):
    """Outputs that were planned, against those that are there with more than no bytes."""
    rows = t.documents.withColumn("part", F.expr("doc_id div 50"))
    made = rows.where("part % 4 <> 1").groupBy("source", "part").agg(F.sum(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("n_chars"))).alias("size"))
    both = rows.select("source", "part").distinct().join(_back(t, made, "outputs"), ["source", "part"], "left")
    return both.select("source", "part", F.when(F.col("size").isNull(), "missing").when(F.col("size") > 0, "ok").otherwise("empty").alias("verdict"))


@query("""
WITH s AS (SELECT conv_id AS job, turn AS stage, sha256(text) AS print, sha256(CASE WHEN (conv_id + turn) % 9 = 0 THEN text || '!' ELSE text END) AS saved, (conv_id * 3 + turn) % 11 <> 0 AS finished FROM conversations)
SELECT job, stage, NOT bool_and(finished AND print = saved) OVER (PARTITION BY job ORDER BY stage) AS run FROM s""")
def resume_stages(t):
    """A finished stage is skipped if its fingerprint is the saved one, and all before it are skipped."""
    text, sum_ = F.col("text"), F.col("conv_id") + F.col("turn")
    now = t.conversations.select(F.col("conv_id").alias("job"), F.col("turn").alias("stage"), F.sha2("text", 256).alias("print"))
    saved = t.conversations.where((F.col("conv_id") * 3 + F.col("turn")) % 11 != 0).select(F.col("conv_id").alias("job"), F.col("turn").alias("stage"), F.sha2(F.when(sum_ % 9 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("saved"))
    both = now.join(_back(t, saved, "stages"), ["job", "stage"], "left")
    same = F.coalesce(F.col("print") == F.col("saved"), F.lit(False))
    return both.select("job", "stage", (~F.bool_and(same).over(Window.partitionBy("job").orderBy("stage"))).alias("run"))


@query("""
WITH x AS (SELECT user_id, event_id % 40 AS title, max(epoch_us(ts)) AS last, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS liked FROM events GROUP BY 1, 2),
     y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, title) AS recent, row_number() OVER (PARTITION BY user_id ORDER BY liked DESC NULLS LAST, title) AS liking FROM x),
     z AS (SELECT *, CASE WHEN liked IS NOT NULL AND liking <= 128 THEN 0 WHEN recent <= 16 THEN 1 ELSE 2 END AS shelf FROM y)
SELECT user_id, title, ['favourite', 'recent', 'other'][shelf + 1] AS shelf, row_number() OVER (PARTITION BY user_id ORDER BY shelf, CASE shelf WHEN 0 THEN -liked WHEN 1 THEN -last END, title) AS place FROM z""")
def library_shelves(t):
    """A library with favourites (128 at most) on top, then the 16 latest titles, then the rest by name."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = t.events.groupBy("user_id", (F.col("event_id") % 40).alias("title")).agg(F.max(at).alias("last"), F.max(F.when(F.col("event_type") == "purchase", at)).alias("liked"))
    own = Window.partitionBy("user_id")
    x = x.withColumn("recent", F.row_number().over(own.orderBy(F.desc("last"), "title"))).withColumn("liking", F.row_number().over(own.orderBy(F.desc_nulls_last("liked"), "title")))
    x = x.withColumn("shelf", F.when(F.col("liked").isNotNull() & (F.col("liking") <= 128), 0).when(F.col("recent") <= 16, 1).otherwise(2))
    place = F.row_number().over(own.orderBy("shelf", F.when(F.col("shelf") == 0, -F.col("liked")).when(F.col("shelf") == 1, -F.col("last")), "title"))
    name = F.element_at(F.array(*map(F.lit, ("favourite", "recent", "other"))), F.col("shelf") + 1)
    return x.withColumn("place", place.cast("long")).select("user_id", "title", name.alias("shelf"), "place")


@query(f"SELECT DISTINCT file, 0 AS sid, 1 AS stype, 'M2Y1' AS codec, 16 AS width, 16 AS height, 24000 AS fps_num, 1001 AS fps_den FROM ({FRAMES})")
def container_streams(t):
    """The stream descriptors of each container."""
    return container.read_streams(files(t))


@query(f"SELECT file, frame, true AS page_flag, key AS sync FROM ({FRAMES})")
def page_flag_rule(t):
    """Every page carries the keyframe flag, so it tells nothing; bodies do."""
    found = container.read_packets(files(t), body=28)
    return found.select("file", "frame", (F.col("page_flags").bitwiseAND(container.FLAG_KEYFRAME) != 0).alias("page_flag"), sync_mark().alias("sync"))


@query(f"SELECT file, count(*)::BIGINT AS packets, (96 + sum(size + 48))::BIGINT AS media_end, (96 + sum(size + 48) + CASE WHEN count(*) FILTER (key) > 0 THEN 28 + 16 * count(*) FILTER (key) + 32 ELSE 0 END)::BIGINT AS size FROM ({FRAMES}) GROUP BY 1")
def media_end(t):
    """Containers with a seek index behind their pages: the footer says where the pages end, and no packet is read beyond that."""
    plain = files(t)
    points = container.seek_points(container.read_packets(plain, body=28), sync_mark())
    indexed = container.add_indexes(plain, points)
    found = container.read_packets(indexed, body=0).groupBy("file").agg(F.count("*").alias("packets"))
    return indexed.select("file", container.media_end(F.col("content")).alias("media_end"), F.length("content").cast("long").alias("size")).join(found, "file").select("file", "packets", "media_end", "size")


@query(f"""
WITH f AS (SELECT file, (96 + sum(size + 48))::BIGINT AS n FROM ({FRAMES}) GROUP BY 1), a AS (SELECT file, n, unnest(['poster', 'title']) AS key FROM f)
SELECT file, key, CASE WHEN key = 'poster' THEN 1 ELSE 2 END AS kind, n + 16 + 2 * 64 + CASE WHEN key = 'poster' THEN 0 ELSE 100 END AS at, CASE WHEN key = 'poster' THEN 100 ELSE length(file) END::BIGINT AS size, true AS crc_ok FROM a""")
def asset_bundle(t):
    """Assets behind a container, listed from the bundle's directory; a second bundle takes the place of the first."""
    name = F.col("file")
    assets = lambda n: F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.encode(v, "utf-8").alias("data")) for k, kind, v in (("poster", 1, F.repeat(F.lit("p"), F.lit(n))), ("title", 2, name))))
    once = container.with_assets(files(t).withColumn("assets", assets(7)))
    return container.read_assets(container.with_assets(once.withColumn("assets", assets(100))))


_SETTINGS = {"volume": (0, 100, 50), "depth": (-10, 10, 0), "skip": (5, 60, 10)}


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT * FROM (VALUES ('volume', 0, 100, 50), ('depth', -10, 10, 0), ('skip', 5, 60, 10)) v(key, low, high, fallback)),
     l AS (SELECT user_id, ['volume', 'depth', 'skip', 'colour'][event_id % 4 + 1] AS key, arg_max(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 160 - 20 END, event_id) FILTER (event_id IS NOT NULL) AS v, arg_max(event_id, event_id) AS last FROM events GROUP BY 1, 2)
SELECT u.user_id, k.key, (CASE WHEN last IS NULL OR last % 6 = 0 THEN fallback ELSE least(greatest(last % 160 - 20, low), high) END)::BIGINT AS value FROM u CROSS JOIN k LEFT JOIN l ON l.user_id = u.user_id AND l.key = k.key""")
def settings_parse(t):
    """Settings files of each user: the last line of a key counts, unknown keys do not, numbers are clamped, anything else gives the default."""
    n = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, ("volume", "depth", "skip", "colour"))), (n % 4 + 1).cast("int"))
    text = F.when(n % 6 == 0, F.lit("none")).otherwise((n % 160 - 20).cast("string"))
    lines = t.events.select(F.col("user_id").cast("string").alias("file"), n.alias("n"), F.concat(key, F.lit(" = "), text).alias("line"))
    return textfiles.settings(lines, _SETTINGS).select(F.col("file").cast("long").alias("user_id"), "key", "value")


_WORK = "[((round(v::DOUBLE * 127)::BIGINT + 128) % 256) FOR v IN embedding]"


@query(f"""
WITH x AS (SELECT vec_id, {_WORK} AS b FROM embeddings), t AS (SELECT [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]] AS m),
     c AS (SELECT vec_id, [[list_sum([list_sum([m[i][k] * b[(k - 1) * 8 + l] * m[j][l] FOR l IN range(1, 5)]) FOR k IN range(1, 5)])::BIGINT FOR j IN range(1, 5)] FOR i IN range(1, 5)] AS c FROM x, t),
     q AS (SELECT vec_id, [sign(v) * ((abs(v) + 8) // 16) FOR v IN flatten(c)] AS q FROM c)
SELECT vec_id, q::BIGINT[]::VARCHAR AS levels, len([v FOR v IN q IF v <> 0])::BIGINT AS kept, 2 + len([v FOR v IN q IF v <> 0])::BIGINT AS bytes FROM q""")
def transform_pack(t):
    """A 4 x 4 corner of each block: transformed, quantized and packed sparsely."""
    b = F.transform("embedding", lambda v: (F.round(v.cast("double") * 127).cast("long") + 128) % 256)
    corner = F.flatten(F.array(*(F.slice(b, 8 * k + 1, 4) for k in range(4))))
    out = video.transformed(t.embeddings.select("vec_id", corner.alias("block")), 16)
    text = F.concat(F.lit("["), F.array_join(F.transform("levels", lambda v: v.cast("string")), ", "), F.lit("]"))
    return out.select("vec_id", text.alias("levels"), F.size(F.filter("levels", lambda v: v != 0)).cast("long").alias("kept"), F.length("packed").cast("long").alias("bytes"))


@query()
def subframe_decode(t):
    """Two-channel ADPCM of whole subframes of 256 samples; see the tests for the codec itself."""
    data = F.concat(F.unhex(F.lit("0500f0ff0a001000")), F.substring(F.encode(F.repeat(F.sha2(F.col("text"), 512), F.lit(5)), "utf-8"), 1, 600))
    out = codecs.decode_packets(t.benchmark.select(F.col("item_id").alias("packet"), data.alias("data")), 2)
    return out.select("packet", F.size("samples").cast("long").alias("samples"), F.array_min("samples").alias("low"), F.array_max("samples").alias("high"))


@query(f"SELECT file, frame, 'M2Y2' AS codec, key AS keyframe, 0::BIGINT AS y_size, 0::BIGINT AS cb_size, 0::BIGINT AS cr_size FROM ({FRAMES})")
def body_metadata(t):
    """What the fixed part of each body says: codec, frame, key mark and the planes' sizes."""
    found = container.read_packets(files(t), body=28)
    head = container.body_fields(F.col("body"))
    return found.select("file", head["frame"].alias("frame"), head["codec"].alias("codec"), head["keyframe"].alias("keyframe"), *(head[f"{p}_size"].alias(f"{p}_size") for p in ("y", "cb", "cr")))


@query(f"SELECT file, seq, seq * 30000 // 25 AS pts, frame FROM ({FRAMES})")
def retime_container(t):
    """The same pages at 25 frames a second."""
    return container.read_packets(container.retimed(files(t), 25, 1), body=0).select("file", "seq", "pts", "frame")


@query("SELECT item_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS length FROM benchmark")
def range_round_trip(t):
    """Texts through the adaptive range coder and back; the model begins anew with each."""
    coded = rangecoder.encode_packets(t.benchmark.select(F.col("item_id").alias("frame"), F.encode("text", "utf-8").alias("body")))
    back = rangecoder.decode_packets(coded.select("frame", "coded", "length"))
    return back.select(F.col("frame").alias("item_id"), F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("length"))


_REACH = 2
_VECTORS = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(video.candidates(_REACH)))


@query(f"""
WITH v AS (SELECT vec_id, {_WORK} AS b FROM embeddings), f AS (SELECT vec_id // 400 AS stream, vec_id // 4 AS frame, flatten(list(b ORDER BY vec_id)) AS p FROM v GROUP BY 1, 2 HAVING count(*) = 4),
     g AS (SELECT *, lag(p) OVER (PARTITION BY stream ORDER BY frame) AS q FROM f), c AS (SELECT * FROM (VALUES {_VECTORS}) t(ord, x, y)),
     k AS (SELECT stream, frame, gx, gy, ord, x, y, list_sum([abs(p[(gy * 8 + i // 8) * 16 + gx * 8 + i % 8 + 1] - q[(gy * 8 + y + i // 8) * 16 + gx * 8 + x + i % 8 + 1]) FOR i IN range(64)])::BIGINT AS sad
           FROM g, (SELECT unnest([0, 1]) AS gx), (SELECT unnest([0, 1]) AS gy), c WHERE q IS NOT NULL AND gx * 8 + x BETWEEN 0 AND 8 AND gy * 8 + y BETWEEN 0 AND 8)
SELECT stream::VARCHAR AS stream, frame, gx::BIGINT AS bx, gy::BIGINT AS "by", arg_min(x, (sad, ord))::BIGINT AS mx, arg_min(y, (sad, ord))::BIGINT AS my, min(sad) AS sad FROM k WHERE sad <= {video.CUTOFF} GROUP BY 1, 2, 3, 4""")
def motion_search(t):
    """Full search of each 8 x 8 block of frames of 16 x 16 in the frame before; the first of equals."""
    b = F.transform("embedding", lambda v: F.lpad(F.hex((F.round(v.cast("double") * 127).cast("long") + 128) % 256), 2, "0"))
    rows = t.embeddings.select(F.expr("vec_id div 4").alias("frame"), "vec_id", F.unhex(F.array_join(b, "")).alias("rows"))
    strips = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "rows"))), lambda s: s["rows"])
    frames = rows.groupBy("frame").agg(strips.alias("strips")).where(F.size("strips") == 4)
    plane = F.concat(*(F.col("strips")[k] for k in range(4)))
    return video.motion(frames.select(F.expr("frame div 100").cast("string").alias("stream"), "frame", plane.alias("plane")), 16, 16, _REACH)
