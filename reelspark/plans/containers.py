"""Container queries: documents as frames are packed into page containers, which are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.operators import codecs, packets, windows
from reelspark.plans import ordered
from reelspark.plans.registry import query
from reelspark.sources import container

SEGMENT = 2000  # frames of a file
FRAMES = "SELECT source || '/' || (doc_id // 2000)::VARCHAR AS file, doc_id AS frame, doc_id % 12 = 0 AS key, 28 + n_chars % 5000 AS size, row_number() OVER (PARTITION BY source, doc_id // 2000 ORDER BY doc_id) - 1 AS seq FROM documents"


def _body():
    """Bodies of a delta codec: tag, frame, key mark, empty planes, then filling."""
    k, n = F.col("doc_id"), F.col("n_chars") % 5000
    little = lambda c: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * b).bitwiseAND(F.lit(255))), 2, "0")) for b in range(4)))
    mark = F.unhex(F.when(k % 12 == 0, "01").otherwise("02"))
    return F.concat(F.unhex(F.lit(b"M2Y2".hex() + "10001000")), little(k), mark, F.unhex(F.lit("00" * 15)), F.encode(F.repeat(F.lit("x"), n.cast("int")), "utf-8"))


def files(t):
    """Documents as frames in containers of at most SEGMENT frames."""
    file = F.concat("source", F.lit("/"), F.expr(f"doc_id div {SEGMENT}").cast("string"))
    return container.pack(t.documents.select(file.alias("name"), F.col("doc_id").alias("frame"), _body().alias("body")), "name", "frame", "body")


def sync_mark():
    """Whether a packet's body says that decoding may begin there."""
    return F.substring("body", 13, 1) == F.unhex(F.lit("01"))


@query(f"SELECT file, seq, seq * 30000 * 1001 // 24000 AS pts, frame, size AS psize, key AS sync, true AS crc_ok FROM ({FRAMES})")
def container_packets(t):
    """Packets of the containers, each with what its body and page say."""
    found = container.read_packets(files(t), body=28)
    frame = N.le(F.col("body"), F.lit(8), 4)
    return found.select("file", "seq", "pts", frame.alias("frame"), "psize", sync_mark().alias("sync"), (F.col("crc_ok") & (F.col("frame") == frame)).alias("crc_ok"))


@query(f"""
WITH x AS (SELECT *, (96 + sum(size + 48) OVER (PARTITION BY file ORDER BY seq) - size - 48)::BIGINT AS page_offset FROM ({FRAMES})) SELECT file, frame, page_offset FROM x WHERE key""")
def seek_index(t):
    """Where a reader may begin: sync frames and the offsets of their pages."""
    found = container.read_packets(files(t), body=28)
    return container.seek_points(found, sync_mark())


@query(f"""
WITH g AS (SELECT split_part(file, '/', 1) AS stream, count(*)::BIGINT AS n, list_sort(list(size)) AS l, round(sum(size)::DOUBLE / count(*), 6) AS avg_size FROM ({FRAMES}) GROUP BY 1)
SELECT stream, n AS n_packets, l[1]::BIGINT AS min_size, l[n]::BIGINT AS max_size, avg_size, {", ".join(f"l[least(n - 1, n * {p} // 100) + 1]::BIGINT AS p{p}" for p in packets.PERCENTILES)} FROM g""")
def container_report(t):
    """The packet report from files instead of a table."""
    found = container.read_packets(files(t), body=0)
    return packets.report(found.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("stream"), "psize"), "psize", ["stream"])


@query()
def adpcm_frames(t):
    """A frame of 64 samples from each embedding as an audio packet; see the tests for the codec itself."""
    samples = F.transform("embedding", lambda v: F.round(v.cast("double") * 30000).cast("int"))
    out = codecs.encode_frames(t.embeddings.select(F.col("vec_id").alias("frame"), samples.alias("samples")))
    return out.select("frame", F.length("packet").cast("long").alias("bytes"), F.sha2("packet", 256).alias("digest"), "max_error")


@query("""
WITH x AS (SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, doc_id AS frame, 28 + n_chars % 5000 AS psize FROM documents)
SELECT file, seq, frame, psize, (96 + sum(psize + 48) OVER (PARTITION BY file ORDER BY seq) - psize - 48)::BIGINT AS page_offset, true AS crc_ok FROM x""")
def segment_merge(t):
    """Segments that each begin with the last page of the one before, merged into one container without those, and read back."""
    rows = windows.numbered(t.documents, ["source"], ["doc_id"], F.expr(f"doc_id div {ordered.CELL}"), "place").withColumn("place", F.col("place") - 1)
    warm = rows.where("place % 100 = 99").withColumn("segment", F.expr("place div 100 + 1"))
    rows = rows.withColumn("segment", F.expr("place div 100")).unionByName(warm)
    name = F.concat("source", F.lit("/"), F.col("segment").cast("string"))
    packed = container.pack(rows.select(name.alias("name"), F.col("doc_id").alias("frame"), _body().alias("body"), "place"), "name", "frame", "body", start="place")
    segment = F.split_part("file", F.lit("/"), F.lit(2)).cast("long")
    parts = container.merged(packed.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("file"), segment.alias("segment"), (segment > 0).cast("int").alias("skip"), "content"))
    return container.read_parts(parts, body=0).select("file", "seq", "frame", "psize", "page_offset", "crc_ok")


@query(f"""
WITH x AS (SELECT file, seq, frame, size, CASE WHEN seq % 3 > 0 THEN 8 + seq % 5 ELSE 8 END AS a FROM ({FRAMES})), y AS (SELECT *, (128 + sum(size + a + 64) OVER (PARTITION BY file ORDER BY seq) - size - a - 64)::BIGINT AS page_offset FROM x)
SELECT file, seq, 0 AS sid, frame, size AS psize, page_offset, true AS crc_ok FROM y UNION ALL SELECT file, seq, 1, seq, a, page_offset, true FROM y""")
def mux_container(t):
    """Containers with a second stream: audio packets by position, silence where there is none, and none beyond the video."""
    made = files(t)
    places = container.read_packets(made, body=0).select("file", F.col("seq").alias("place"))
    sound = F.encode(F.repeat(F.lit("a"), (8 + F.col("place") % 5).cast("int")), "utf-8")
    audio = places.where("place % 3 > 0").union(places.where("place = 0").withColumn("place", F.lit(1 << 30))).select("file", F.col("place").alias("frame"), sound.alias("body"))
    return container.read_parts(container.muxed(made, audio, bytes(8)), body=0).select("file", "seq", "sid", "frame", "psize", "page_offset", "crc_ok")
