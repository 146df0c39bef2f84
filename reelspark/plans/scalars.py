"""Timing, audio, pixel and size arithmetic over orders, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.functions import strings as S
from reelspark.plans.registry import query

_RATE = "CASE o_orderkey % 3 WHEN 0 THEN 24000 WHEN 1 THEN 25 ELSE 30000 END", "CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 1001 END"
_RATE_SQL = f"SELECT *, ({_RATE[0]})::BIGINT AS num, ({_RATE[1]})::BIGINT AS den FROM orders"


def _rated(t):
    return t.orders.withColumn("num", F.expr(_RATE[0]).cast("long")).withColumn("den", F.expr(_RATE[1]).cast("long"))


@query(f"SELECT o_orderkey, num, den, o_orderkey * 30000 * den // num AS ticks FROM ({_RATE_SQL})")
def frame_ticks(t):
    return _rated(t).select("o_orderkey", "num", "den", N.frame_ticks(F.col("o_orderkey"), F.col("num"), F.col("den")).alias("ticks"))


@query(f"""
WITH r AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 16000 END AS rate FROM ({_RATE_SQL}))
SELECT o_orderkey, rate::BIGINT AS rate, CASE WHEN rate * den % num = 0 AND rate * den // num BETWEEN 1 AND 65535 THEN rate * den // num END AS samples FROM r""")
def exact_division(t):
    rate = F.when(F.col("o_custkey") % 3 == 0, 48000).when(F.col("o_custkey") % 3 == 1, 44100).otherwise(16000).cast("long")
    return _rated(t).withColumn("rate", rate).select("o_orderkey", "rate", N.samples_per_frame(F.col("rate"), F.col("num"), F.col("den")).alias("samples"))


_RATE_TEXT = """CASE p_partkey % 6 WHEN 0 THEN cast(p_size AS {s}) WHEN 1 THEN '24000/1001' WHEN 2 THEN concat(cast(p_size AS {s}), '/', cast(p_partkey % 7 AS {s}))
 WHEN 3 THEN '23.976' WHEN 4 THEN concat(cast(p_size * 1001 AS {s}), '/1001') ELSE concat(cast(p_size AS {s}), '/70001') END"""


@query(f"""
WITH x AS (SELECT p_partkey, {_RATE_TEXT.format(s="VARCHAR")} AS rate FROM part),
     y AS (SELECT *, CASE WHEN regexp_full_match(rate, '[0-9]+(/[0-9]+)?') THEN split_part(rate, '/', 1)::BIGINT END AS a,
                  CASE WHEN rate LIKE '%/%' THEN split_part(rate, '/', 2)::BIGINT ELSE 1 END AS b FROM x),
     z AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN a // gcd(a, b) END AS n, CASE WHEN a > 0 AND b > 0 THEN b // gcd(a, b) END AS d FROM y)
SELECT p_partkey, rate, CASE WHEN n <= 65535 AND d <= 65535 THEN n END::BIGINT AS num, CASE WHEN n <= 65535 AND d <= 65535 THEN d END::BIGINT AS den FROM z""")
def rational_parse(t):
    rows = t.part.select("p_partkey", F.expr(_RATE_TEXT.format(s="STRING")).alias("rate")).withColumn("r", N.parse_frame_rate(F.col("rate")))
    return rows.select("p_partkey", "rate", "r.num", "r.den")


@query(f"""
WITH x AS (SELECT *, round(o_totalprice * 100)::BIGINT * num AS a, 100 * den AS b FROM ({_RATE_SQL}))
SELECT o_orderkey, (a + b - 1) // b AS ceil_frames, a // b AS floor_frame FROM x""")
def ceil_floor_frames(t):
    a, b = F.round(F.col("o_totalprice") * 100).cast("long") * F.col("num"), F.lit(100) * F.col("den")
    return _rated(t).select("o_orderkey", N.ceil_frames(a, b).alias("ceil_frames"), N.floor_div(a, b).alias("floor_frame"))


_MS = "(round(value * 100)::BIGINT * 377)"


@query(f"""
WITH x AS (SELECT event_id, {_MS} AS ms FROM events), y AS (SELECT *, ms // 1000 AS s, round_even(ms / 1000.0::DOUBLE, 0)::BIGINT AS r FROM x)
SELECT event_id, ms, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS short,
       printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS exact, printf('%d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) AS hour FROM y""")
def format_time(t):
    rows = t.events.select("event_id", (F.round(F.col("value") * 100).cast("long") * 377).alias("ms"))
    return rows.select("event_id", "ms", S.clock_short(N.div(F.col("ms"), 1000)).alias("short"), S.clock_ms(F.col("ms")).alias("exact"), S.clock_hour(F.col("ms")).alias("hour"))


_STAMP = """CASE event_id % 5 WHEN 0 THEN concat(cast(event_id % 13 AS {s}), ':', cast(event_id % 60 AS {s}), ':', cast(event_id % 59 AS {s}))
 WHEN 1 THEN concat(cast(event_id % 77 AS {s}), ':', cast(event_id % 60 AS {s})) WHEN 2 THEN concat(' ', cast(event_id % 1000 AS {s}), '.5 ') WHEN 3 THEN 'soon' ELSE concat(cast(event_id % 9 AS {s}), ':x') END"""


@query(f"""
WITH x AS (SELECT event_id, {_STAMP.format(s="VARCHAR")} AS stamp FROM events), y AS (SELECT *, string_split(trim(stamp), ':') AS p FROM x)
SELECT event_id, stamp, CASE len(p) WHEN 3 THEN (try_cast(p[1] AS BIGINT) * 3600 + try_cast(p[2] AS BIGINT) * 60 + try_cast(p[3] AS BIGINT))::DOUBLE
       WHEN 2 THEN (try_cast(p[1] AS BIGINT) * 60 + try_cast(p[2] AS BIGINT))::DOUBLE WHEN 1 THEN try_cast(p[1] AS DOUBLE) END AS seconds FROM y""")
def timestamp_parse(t):
    rows = t.events.select("event_id", F.expr(_STAMP.format(s="STRING")).alias("stamp"))
    return rows.withColumn("seconds", S.parse_seconds(F.col("stamp")))


_CUE = """CASE WHEN event_id % 11 = 0 THEN 'later' ELSE concat(lpad(cast(event_id % 30 AS {s}), 2, '0'), ':', lpad(cast(event_id % 67 AS {s}), 2, '0'), ':', lpad(cast(event_id % 62 AS {s}), 2, '0'),
 CASE WHEN event_id % 2 = 0 THEN ',' ELSE '.' END, lpad(cast(event_id % 1000 AS {s}), 3, '0'), ' --> ') END"""


@query(f"""
WITH x AS (SELECT event_id, {_CUE.format(s="VARCHAR")} AS cue FROM events),
     y AS (SELECT *, regexp_extract(cue, '^([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})[,.]([0-9]{{3}})', ['h', 'm', 's', 'ms']) AS p FROM x)
SELECT event_id, cue, CASE WHEN p.h <> '' AND try_cast(p.m AS INT) < 60 AND try_cast(p.s AS INT) < 60 THEN ((try_cast(p.h AS BIGINT) * 60 + try_cast(p.m AS BIGINT)) * 60 + try_cast(p.s AS BIGINT)) * 1000 + try_cast(p.ms AS BIGINT) END AS ms FROM y""")
def srt_time(t):
    rows = t.events.select("event_id", F.expr(_CUE.format(s="STRING")).alias("cue"))
    return rows.withColumn("ms", S.parse_cue_time(F.col("cue")))


@query("""
WITH x AS (SELECT event_id, round(value * 1000)::BIGINT - 40000 AS v FROM events)
SELECT event_id, least(greatest(v, 0), 255) AS u8, least(greatest(v, -128), 127) AS s8, least(greatest(v, -32768), 32767) AS s16, CASE WHEN v BETWEEN 0 AND 100 THEN v ELSE 50 END AS or_default FROM x""")
def clamp_values(t):
    v = F.round(F.col("value") * 1000).cast("long") - 40000
    return t.events.select("event_id", *(N.clamp(v, a, b).alias(n) for n, a, b in (("u8", 0, 255), ("s8", -128, 127), ("s16", -32768, 32767))), F.when(v.between(0, 100), v).otherwise(50).alias("or_default"))


@query("""
WITH x AS (SELECT event_id, (event_id * 7919 % 65536 - 32768) AS sample, event_id % 400 AS master, event_id % 130 - 10 AS channel, event_id % 2 = 0 AS soft FROM events),
     y AS (SELECT *, sample * master * least(greatest(channel, 0), 100) AS wide FROM x), z AS (SELECT *, sign(wide) * (abs(wide) // 10000) AS v FROM y),
     k AS (SELECT *, CASE WHEN soft AND v > 28000 THEN 28000 + floor((v - 28000) / 4.0) WHEN soft AND v < -28000 THEN -28000 + floor((v + 28000) / 4.0) ELSE v END AS g FROM z)
SELECT event_id, least(greatest(g, -32768), 32767)::BIGINT AS sample FROM k""")
def soft_limiter(t):
    e = F.col("event_id")
    return t.events.select("event_id", N.gain(e * 7919 % 65536 - 32768, e % 400, e % 130 - 10, e % 2 == 0).alias("sample"))


@query("""
WITH x AS (SELECT p_partkey, p_size::BIGINT AS a, 1 + p_partkey % 40 AS b FROM part),
     y AS (SELECT *, CASE WHEN a * 240 >= b * 400 THEN 400 ELSE a * 240 // b END AS w0, CASE WHEN a * 240 >= b * 400 THEN b * 400 // a ELSE 240 END AS h0 FROM x),
     z AS (SELECT *, greatest(2, w0 - w0 % 2) AS w, greatest(2, h0 - h0 % 2) AS h FROM y), q AS (SELECT *, (400 - w) // 2 AS x0, (240 - h) // 2 AS y0 FROM z)
SELECT p_partkey, w::BIGINT AS w, h::BIGINT AS h, (x0 - x0 % 2)::BIGINT AS x, (y0 - y0 % 2)::BIGINT AS y FROM q""")
def aspect_fit(t):
    rows = t.part.select("p_partkey", N.aspect_fit(F.col("p_size"), 1 + F.col("p_partkey") % 40, 400, 240).alias("b"))
    return rows.select("p_partkey", "b.w", "b.h", "b.x", "b.y")


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS d, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 24000 END AS num, 1001 AS den FROM events),
     y AS (SELECT *, CASE WHEN d > 0 AND num > 0 THEN greatest(1, round_even(d * num / den, 0)::BIGINT) * (12 + ((round_even(16000.0::DOUBLE * den / num, 0)::BIGINT - 1) * 4 + 7) // 8) END AS adpcm,
                  CASE WHEN d > 0 THEN round_even(d * 48000, 0)::BIGINT * 2 * 2 END AS pcm FROM x)
SELECT event_id, pcm, adpcm::BIGINT AS adpcm, CASE WHEN pcm IS NOT NULL THEN greatest(0, 50000000 - pcm)::BIGINT END AS video, CASE WHEN pcm IS NOT NULL THEN 2 * greatest(0, 50000000 - pcm)::BIGINT END AS working,
       CASE WHEN adpcm IS NULL THEN 'unknown' ELSE 'estimated' END AS class FROM y""")
def size_estimate(t):
    """Audio sizes by formula, what is left of 50,000,000 bytes for video, and twice that as working space; null if unknown."""
    d, num = F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")), F.when(F.col("event_id") % 7 == 0, 0).otherwise(24000)
    rows = t.events.select("event_id", N.pcm_bytes(d, 48000, 2).alias("pcm"), N.adpcm_bytes(d, 16000, num, 1001).alias("adpcm"))
    video = F.when(F.col("pcm").isNotNull(), F.greatest(F.lit(0), 50000000 - F.col("pcm")))
    return rows.select("event_id", "pcm", "adpcm", video.alias("video"), (2 * video).alias("working"), F.when(F.col("adpcm").isNull(), "unknown").otherwise("estimated").alias("class"))


@query("""
WITH x AS (SELECT vec_id, [round(abs(v) * 255)::INT % 256 FOR v IN embedding[1:3]] AS c FROM embeddings)
SELECT vec_id, (((c[1] >> 3) << 11) | ((c[2] >> 2) << 5) | (c[3] >> 3))::BIGINT AS packed, ((c[1] * 54 + c[2] * 183 + c[3] * 19) >> 8)::BIGINT AS luma FROM x""")
def rgb565_pack(t):
    c = F.transform(F.slice("embedding", 1, 3), lambda v: F.round(F.abs(v) * 255).cast("int") % 256)
    rows = t.embeddings.select("vec_id", c.alias("c"))
    parts = [F.col("c")[k] for k in range(3)]
    return rows.select("vec_id", N.rgb565(*parts).cast("long").alias("packed"), N.luma(*parts).cast("long").alias("luma"))


@query("""
SELECT vec_id, array_to_string([substr('0123456789abcdef', 1 + list_sum([CASE WHEN embedding[4 * k + j] > 0 THEN 1 << (4 - j) ELSE 0 END FOR j IN [1, 2, 3, 4]])::INT, 1) FOR k IN range(16)], '') AS mask FROM embeddings""")
def bitmask_pack(t):
    return t.embeddings.select("vec_id", N.bitmask(F.transform("embedding", lambda v: v > 0)).alias("mask"))


@query("""
WITH x AS (SELECT event_id, event_id % 700 AS cur, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 600 END AS total, CASE WHEN event_id % 8 = 0 THEN 0.0 ELSE value END AS speed FROM events)
SELECT event_id, CASE WHEN total > 0 AND speed > 0 THEN round((total - least(cur, total)) / speed, 6) END AS eta, CASE WHEN total > 0 THEN round(least(greatest(cur * 100.0::DOUBLE / total, 0), 100), 6) END AS pct FROM x""")
def eta_expr(t):
    cur, total, speed = F.col("event_id") % 700, F.when(F.col("event_id") % 9 != 0, 600), F.when(F.col("event_id") % 8 == 0, 0.0).otherwise(F.col("value"))
    return t.events.select("event_id", F.round(N.eta(cur, total, speed), 6).alias("eta"), F.round(N.percent(cur, total), 6).alias("pct"))


@query("""
WITH x AS (SELECT event_id, value, least(30, greatest(1, trunc(value)::BIGINT)) AS length FROM events)
SELECT event_id, CASE WHEN value >= length + 120 THEN 60.0 ELSE greatest(0, (value - length) / 2) END AS start, length FROM x""")
def smoke_window(t):
    rows = t.events.select("event_id", N.smoke_window(F.col("value"), 30).alias("w"))
    return rows.select("event_id", "w.start", "w.length")
