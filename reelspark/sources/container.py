"""The page container: building, walking and reading it, from bytes in memory.

`read_files` gets its bytes through Spark's binaryFile source, so containers may
lie in any store that Spark reads; `reelspark.sources.pagefile` is the same as a
Python data source for mounted file systems, where files may be larger than a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.numbers import TICKS

#: Fixed values of the format: magics, sizes of the parts, and limits beyond which a walk ends.
MAGIC, PAGE_MAGIC, BUNDLE_MAGIC, DIRECTORY_MAGIC = b"MIVF", b"MP", b"MASB", b"MABD"
HEADER, DESCRIPTOR, PAGE, PACKET = 64, 32, 32, 16
MAX_PAYLOAD, MAX_PACKETS, MAX_FIRST, MAX_SEEK_POINTS = 512 * 1024, 128, 4096, 4096
FLAG_CRC, FLAG_KEYFRAME = 1, 2
HEADER_FORMAT, DESCRIPTOR_FORMAT, PAGE_FORMAT, PACKET_FORMAT = "<4sHHIIIQIIQQIII", "<BBH4sIIHHHHIBBH", "<2sBBIQIHHII", "<BBHIII"
VIDEO, AUDIO = 1, 2

STREAMS = "file string, sid int, stype int, codec string, width int, height int, fps_num int, fps_den int"
PACKETS = "file string, page_offset long, seq long, pts long, page_flags int, crc_ok boolean, ordinal int, sid int, flags int, psize long, frame long, body binary"


class Stream(NamedTuple):
    sid: int
    stype: int
    codec: str
    width: int
    height: int
    fps_num: int
    fps_den: int


class Packet(NamedTuple):
    page_offset: int
    seq: int
    pts: int
    page_flags: int
    crc_ok: bool
    ordinal: int
    sid: int
    flags: int
    psize: int
    frame: int
    body: bytes


def build(streams: list[Stream], pages: list[list[tuple[int, int, int, bytes]]], start: int = 0) -> bytes:
    """A container of pages of packets (sid, flags, frame, body), numbered from start."""
    first = HEADER + DESCRIPTOR * len(streams)
    num, den = next(((s.fps_num, s.fps_den) for s in streams if s.stype == VIDEO), (30, 1))
    ticks = lambda n: n * TICKS * den // num
    out = [struct.pack(HEADER_FORMAT, MAGIC, 0, 12, HEADER, len(streams), TICKS, ticks(len(pages)), len(streams), 4096, first, 0, 0, 0, 0)]
    out[0] = out[0].ljust(HEADER, b"\0")
    for s in streams:
        out.append(struct.pack(DESCRIPTOR_FORMAT, s.sid, s.stype, DESCRIPTOR, s.codec.encode(), 1, TICKS, s.width, s.height, s.fps_num, s.fps_den, 0, 0, 0, 0))
    for seq, packets in enumerate(pages, start):
        payload = b"".join(struct.pack(PACKET_FORMAT, sid, flags, PACKET, 0, len(body), frame) + body for sid, flags, frame, body in packets)
        out.append(struct.pack(PAGE_FORMAT, PAGE_MAGIC, PAGE, FLAG_CRC | FLAG_KEYFRAME, seq, ticks(seq), len(payload), len(packets), 0, zlib.crc32(payload), 0))
        out.append(payload)
    return b"".join(out)


def first_page(head: bytes) -> int:
    """Where pages begin; ValueError if the head is none of a container."""
    if len(head) < HEADER or head[:4] != MAGIC:
        raise ValueError("not a page container")
    (first,) = struct.unpack_from("<Q", head, 36)
    if not HEADER < first <= MAX_FIRST:
        raise ValueError(f"invalid first page offset {first}")
    return first


def streams_of(head: bytes) -> list[Stream]:
    """The descriptors between header and first page."""
    first, at, out = first_page(head), HEADER, []
    while at + DESCRIPTOR <= first:
        sid, stype, size, codec, _, _, width, height, num, den, *_ = struct.unpack_from(DESCRIPTOR_FORMAT, head, at)
        if size < DESCRIPTOR or at + size > first:
            break
        out.append(Stream(sid, stype, codec.decode("ascii", "replace"), width, height, num, den))
        at += size
    return out


def packets_of(read: Callable[[int, int], bytes], size: int, start: int, strict: bool = False, body: int | None = None, stop: int | None = None) -> Iterator[Packet]:
    """Packets from the page at start on, of pages that begin before stop. read(at, n) gives bytes; body limits how much of each body is read.

    A permissive walk ends at the first page that is none; a strict one raises.
    """
    at = start
    while at + PAGE <= size and (stop is None or at < stop):
        magic, _, page_flags, seq, pts, length, count, _, crc, _ = struct.unpack(PAGE_FORMAT, read(at, PAGE))
        end = at + PAGE + length
        if magic != PAGE_MAGIC or not 0 < length <= MAX_PAYLOAD or not 0 < count <= MAX_PACKETS or end > size:
            if strict:
                raise ValueError(f"no page at byte {at}")
            return
        payload = read(at + PAGE, length)
        crc_ok = zlib.crc32(payload) == crc
        inside = 0
        for ordinal in range(count):
            if inside + PACKET > length:
                break
            sid, flags, head, _, psize, frame = struct.unpack_from(PACKET_FORMAT, payload, inside)
            if head < PACKET or inside + head + psize > length:
                if strict:
                    raise ValueError(f"packet {ordinal} of the page at byte {at} crosses it")
                break
            own = payload[inside + head : inside + head + (psize if body is None else min(psize, body))]
            yield Packet(at, seq, pts, page_flags, crc_ok, ordinal, sid, flags, psize, frame, own)
            inside += head + psize
        at = end


def body_head(body: bytes) -> dict | None:
    """What the fixed 28 bytes of a delta codec's body say; None for other codecs and short bodies."""
    if len(body) < 28 or body[:4] not in (b"M2Y1", b"M2Y2"):
        return None
    y, cb, cr = struct.unpack_from("<III", body, 16)
    out = {"codec": body[:4].decode(), "frame": struct.unpack_from("<I", body, 8)[0], "keyframe": body[12] == 1, "sizes": [y, cb, cr], "nkeep": None, "plane_qp": None}
    if out["codec"] == "M2Y1":  # planes are plain there and begin with their quantizer
        offsets = [28, 28 + y, 28 + y + cb]
        out |= {"nkeep": body[13], "plane_qp": [body[at] for at, n in zip(offsets, (y, cb, cr), strict=True) if n and at < len(body)]}
    return out


def assets_of(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(key, type, offset, size, crc32) of an asset bundle behind a container; none where its footer is not consistent."""
    size = len(data)
    if size < 64 or data[-64:-60] != BUNDLE_MAGIC:
        return []
    version, at, length, count = struct.unpack_from("<IQQI", data, size - 60)
    if version != 1 or at + length + 64 != size or data[at : at + 4] != DIRECTORY_MAGIC or struct.unpack_from("<II", data, at + 4) != (1, count):
        return []
    out = []
    for k in range(count):
        key, kind, _, offset, length, crc, _ = struct.unpack_from("<32sIIQQII", data, at + 16 + 64 * k)
        out.append((key.split(b"\0")[0].decode("ascii", "replace"), kind, at + offset, length, crc))
    return out


def add_assets(data: bytes, assets: list[tuple[str, int, bytes]]) -> bytes:
    """The container with an asset bundle (key, type, bytes) behind it instead of the one it had."""
    if assets_of(data):
        data = data[: struct.unpack_from("<Q", data, len(data) - 56)[0]]
    head, entries, offset = 16 + 64 * len(assets), [], 16 + 64 * len(assets)
    for key, kind, payload in assets:
        entries.append(struct.pack("<32sIIQQII", key.encode(), kind, 0, offset, len(payload), zlib.crc32(payload), 0))
        offset += len(payload)
    bundle = struct.pack("<4sIII", DIRECTORY_MAGIC, 1, len(assets), head) + b"".join(entries) + b"".join(p for *_, p in assets)
    return data + bundle + struct.pack("<4sIQQIIQQQQ", BUNDLE_MAGIC, 1, len(data), len(bundle), len(assets), 0, len(data), 0, 0, 0)


def _packet_rows(name: str, packets: Iterator[Packet], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for p in packets:
        rows.append((name, *p))
        size += len(p.body)
        if len(rows) >= most or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in text.split(", "))])


def read_packets(files: DataFrame, strict: bool = False, body: int | None = None) -> DataFrame:
    """Packets of files(file, content), in the order of each file."""
    schema = arrow_schema(PACKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                yield from _packet_rows(name, packets_of(lambda at, n, data=data: data[at : at + n], len(data), first_page(data), strict, body), schema)

    return files.select("file", "content").mapInArrow(run, PACKETS)


def read_streams(files: DataFrame) -> DataFrame:
    schema = arrow_schema(STREAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *s) for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in streams_of(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return files.select("file", F.substring("content", 1, MAX_FIRST).alias("content")).mapInArrow(run, STREAMS)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, content of all files under path."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.col("path").alias("file"), "content")


def pack(frames: DataFrame, file: str, order: str, body: str, rate: tuple[int, int] = (24000, 1001), codec: str = "M2Y1", start: str | None = None) -> DataFrame:
    """file, content: a video container for each file of frames, a page a frame in order; pages are numbered from the least start of a file, or 0.

    A file is built in one task, so files must be bounded; callers cut streams
    into segments of a bounded number of frames.
    """

    def run(key, table):
        rows = sorted(zip(table.column(order).to_pylist(), table.column(body).to_pylist(), strict=True))
        stream = Stream(0, VIDEO, codec, 16, 16, *rate)
        data = build([stream], [[(0, 0, frame, own)] for frame, own in rows], min(table.column(start).to_pylist()) if start else 0)
        return pa.table({"file": [key[0].as_py()], "content": pa.array([data], pa.binary())})

    return frames.select(F.col(file).alias("file"), order, body, *[start] * bool(start)).groupBy("file").applyInArrow(run, "file string, content binary")


def seek_points(packets: DataFrame, sync, most: int = MAX_SEEK_POINTS) -> DataFrame:
    """file, frame, page_offset of the first sync packet of each page, the first `most` of a file (the format's own cap)."""
    from pyspark.sql import Window

    first = packets.where(sync).groupBy("file", "page_offset").agg(F.min_by("frame", "ordinal").alias("frame"))
    w = Window.partitionBy("file").orderBy("page_offset")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("file", "frame", "page_offset")


#: Fixed values of the seek index: its magic and version, and those of the footer that stands behind an embedded one.
INDEX_MAGIC, INDEX_VERSION, INDEX_FOOTER_MAGIC, INDEX_FOOTER_VERSION, INDEX_FOOTER = 0x314A4458, 2, 0x5844494D, 1, 32


def index_payload(size: int, first: int, points: list[tuple[int, int]], frames: int | None = None) -> bytes:
    """A seek index. A sidecar's header has no number of frames, an embedded one's has."""
    head = struct.pack("<IIQI", INDEX_MAGIC, INDEX_VERSION, size, first) + (b"" if frames is None else struct.pack("<I", frames))
    return head + struct.pack("<I", len(points)) + b"".join(struct.pack("<IIQ", frame, 0, at) for frame, at in points)


def parse_index(data: bytes, embedded: bool) -> tuple[int, int, list[tuple[int, int]], int]:
    """(file size, first page, points, frames); ValueError where magic, version or length do not fit."""
    magic, version, size, first = struct.unpack_from("<IIQI", data)
    head = 28 if embedded else 24
    (count,) = struct.unpack_from("<I", data, head - 4)
    if (magic, version) != (INDEX_MAGIC, INDEX_VERSION) or count > MAX_SEEK_POINTS or len(data) < head + 16 * count:
        raise ValueError("no seek index of this version")
    points = [(f, at) for f, _, at in struct.iter_unpack("<IIQ", data[head : head + 16 * count])]
    frames = struct.unpack_from("<I", data, 20)[0] if embedded else max((f for f, _ in points), default=-1) + 1
    return size, first, points, frames


def with_index(data: bytes, points: list[tuple[int, int]], frames: int) -> bytes:
    """The container with its seek index and a footer behind it; unchanged where there are no points."""
    if not points:
        return data
    first = first_page(data)
    size = len(data) + len(index_payload(0, first, points, frames)) + INDEX_FOOTER
    payload = index_payload(size, first, points, frames)
    return data + payload + struct.pack("<IIQIIII", INDEX_FOOTER_MAGIC, INDEX_FOOTER_VERSION, len(data), len(payload), INDEX_MAGIC, INDEX_VERSION, 0)


def add_indexes(files: DataFrame, points: DataFrame) -> DataFrame:
    """files(file, content) with the seek index of their points(file, frame, page_offset), MAX_SEEK_POINTS of a file at most, behind their pages."""
    listed = points.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("page_offset", "frame"))).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = [(p["frame"], p["page_offset"]) for p in own or ()]
                out.append(with_index(data.as_py(), own, max((f for f, _ in own), default=-1) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    return files.join(listed, "file", "left").select("file", "content", "points").mapInArrow(run, "file string, content binary")


def media_end(content):
    """Column of the byte at which a container's pages end: where an index footer says, else its size."""
    from reelspark.functions.numbers import le

    size = F.length(content).cast("long")
    foot = F.substring(content, F.greatest(size - INDEX_FOOTER + 1, F.lit(1)).cast("int"), F.lit(INDEX_FOOTER))
    found = (le(foot, F.lit(0), 4) == INDEX_FOOTER_MAGIC) & (le(foot, F.lit(4), 4) == INDEX_FOOTER_VERSION)
    return F.when(found, le(foot, F.lit(8), 4) + le(foot, F.lit(12), 4) * (1 << 32)).otherwise(size)


def with_assets(files: DataFrame) -> DataFrame:
    """files(file, content, assets: list of (key, kind, data)) -> file, content with the bundle behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [add_assets(data.as_py(), [(a["key"], a["kind"], a["data"]) for a in own or ()]) for data, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    return files.select("file", "content", "assets").mapInArrow(run, "file string, content binary")


def read_assets(files: DataFrame) -> DataFrame:
    """file, key, kind, at, size, crc_ok of each asset behind files(file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                rows += [(name, key, kind, at, size, zlib.crc32(data[at : at + size]) == crc) for key, kind, at, size, crc in assets_of(data)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "key", "kind", "at", "size", "crc_ok"])

    return files.select("file", "content").mapInArrow(run, "file string, key string, kind int, at long, size long, crc_ok boolean")


def _pages(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(flags, seq, pts, packets, reserved, payload) of each page; ValueError at anything else."""
    at = first_page(data)
    while at < len(data):
        if len(data) < at + PAGE or data[at : at + 2] != PAGE_MAGIC:
            raise ValueError(f"no page at byte {at}")
        _, _, flags, seq, pts, length, count, reserved, _, _ = struct.unpack_from(PAGE_FORMAT, data, at)
        payload = data[at + PAGE : at + PAGE + length]
        if len(payload) != length:
            raise ValueError(f"the page at byte {at} is cut short")
        yield flags, seq, pts, count, reserved, payload
        at += PAGE + length


def _page(flags: int, seq: int, pts: int, count: int, reserved: int, payload: bytes) -> bytes:
    return struct.pack(PAGE_FORMAT, PAGE_MAGIC, PAGE, flags, seq, pts, len(payload), count, reserved, zlib.crc32(payload), 0) + payload


def merge(segments: list[bytes], warm: list[int] | None = None) -> bytes:
    """One container of video segments in order. warm pages of a segment are dropped; descriptors must be equal and pages go up by one."""
    first = first_page(segments[0])
    head, out, expected = segments[0][HEADER:first], [], 0
    for data, skip in zip(segments, warm or [0] * len(segments), strict=True):
        if data[HEADER : first_page(data)] != head or len(streams_of(data)) != 1:
            raise ValueError("segments do not have the same single video stream")
        for k, page in enumerate(_pages(data)):
            if k < skip:
                continue
            if page[1] != expected:
                raise ValueError(f"expected page {expected}, got {page[1]}")
            out.append(_page(*page))
            expected += 1
    video = streams_of(segments[0])[0]
    header = bytearray(segments[0][:HEADER])
    struct.pack_into("<Q", header, 20, expected * TICKS * video.fps_den // video.fps_num)
    return bytes(header) + head + b"".join(out)


def mux(video: bytes, audio: list[bytes], silence: bytes, codec: str = "PC16", rate: int = 48000, channels: int = 2) -> bytes:
    """video with an audio packet behind each page's packets, by position: missing audio is silence, audio beyond the video is cut."""
    first = first_page(video)
    descriptor = struct.pack(DESCRIPTOR_FORMAT, 1, AUDIO, DESCRIPTOR, codec.encode(), 1, rate, 0, channels, 0, 0, 0, 0, 0, 0)
    header = bytearray(video[:HEADER])
    for at, kind, value in ((12, "<I", 2), (28, "<I", 2), (36, "<Q", first + DESCRIPTOR)):
        struct.pack_into(kind, header, at, value)
    out = [bytes(header), video[HEADER:first], descriptor]
    for k, (flags, seq, pts, count, reserved, payload) in enumerate(_pages(video)):
        body = audio[k] if k < len(audio) else silence
        packet = struct.pack(PACKET_FORMAT, 1, 0, PACKET, 0, len(body), k) + body
        out.append(_page(flags, seq, pts, count + 1, reserved, payload + packet))
    return b"".join(out)


#: Containers as rows: a part holds PART_PAGES whole pages (64 MB at most), the first one the header as well.
PART_PAGES = 128
PAGES = "file string, segment long, place long, seq long, pts long, flags int, count int, reserved int, payload binary"


def read_pages(files: DataFrame) -> DataFrame:
    """Pages of files(file, segment, content) with their place in the file; anything but pages behind the header is an error."""
    schema = arrow_schema(PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows, size = [], 0
                for place, (flags, seq, pts, count, reserved, payload) in enumerate(_pages(data.as_py())):
                    rows.append((name, segment, place, seq, pts, flags, count, reserved, payload))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file", F.col("segment").cast("long"), "content").mapInArrow(run, PAGES)


def write_parts(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """file, part, content: the containers of pages(file, seq, pts, flags, count, reserved, payload) behind heads(file, head), in parts.

    A container is its parts in order; different tasks build them.
    """

    def run(key, table):
        rows = sorted(table.select(["seq", "pts", "flags", "count", "reserved", "payload", "head"]).to_pylist(), key=lambda r: r["seq"])
        head = rows[0]["head"] if rows[0]["head"] and key[1].as_py() == 0 else b""
        data = head + b"".join(_page(r["flags"], r["seq"], r["pts"], r["count"], r["reserved"], r["payload"]) for r in rows)
        return pa.table({"file": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()), "content": pa.array([data], pa.binary())})

    rows = pages.withColumn("part", F.expr(f"seq div {PART_PAGES}")).join(heads.select("file", "head"), "file")
    rows = rows.withColumn("head", F.when(F.col("seq") % PART_PAGES == 0, F.col("head")))
    return rows.groupBy("file", "part").applyInArrow(run, "file string, part long, content binary")


def read_parts(parts: DataFrame, body: int | None = None) -> DataFrame:
    """Packets of containers in parts(file, part, content), each part by itself."""
    from pyspark.sql import Window

    schema = arrow_schema(PACKETS)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.select("file", "part", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = data.as_py()
                packets = packets_of(lambda a, n, data=data: data[a : a + n], len(data), 0 if part else first_page(data), True, body)
                yield from _packet_rows(name, (p._replace(page_offset=p.page_offset + at) for p in packets), schema)

    return parts.join(places, ["file", "part"]).select("file", "part", "content", "at").mapInArrow(run, PACKETS)


def _head_of(change):
    """A column function: change(head of a container up to its first page, a number) -> head."""

    @F.pandas_udf("binary")
    def run(heads: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([bytes(change(bytes(h)[: first_page(bytes(h))], int(n))) for h, n in zip(heads, numbers, strict=True)], dtype=object)

    return run


def _with_duration(head: bytes, pages: int) -> bytes:
    out, video = bytearray(head), streams_of(head)[0]
    struct.pack_into("<Q", out, 20, pages * TICKS * video.fps_den // video.fps_num)
    return out


def _with_audio(head: bytes, rate: int, codec: bytes = b"PC16", channels: int = 2) -> bytes:
    out = bytearray(head)
    for at, kind, value in ((12, "<I", 2), (28, "<I", 2), (36, "<Q", len(head) + DESCRIPTOR)):
        struct.pack_into(kind, out, at, value)
    return out + struct.pack(DESCRIPTOR_FORMAT, 1, AUDIO, DESCRIPTOR, codec, 1, rate, 0, channels, 0, 0, 0, 0, 0, 0)


def merged(files: DataFrame) -> DataFrame:
    """file, part, content: one container of the segments of each file in files(file, segment, skip, content), by segment, without skip pages of each.

    Descriptors must be equal and page numbers go up by one from 0, else the job fails.
    """
    from pyspark.sql import Window

    heads = files.select("file", "segment", F.substring("content", 1, MAX_FIRST).alias("head"))
    first = F.substring("head", HEADER + 1, DESCRIPTOR)
    one = heads.groupBy("file").agg(F.min_by("head", "segment").alias("head"), F.countDistinct(first).alias("kinds"))
    pages = read_pages(files).join(files.select("file", "segment", "skip"), ["file", "segment"]).where("place >= skip")
    counts = pages.groupBy("file", "segment").agg(F.count("*").alias("n"))  # a row for each segment
    own = Window.partitionBy("file")
    before = F.sum("n").over(own.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = pages.join(counts.withColumn("before", before), ["file", "segment"])
    expected = F.col("before") + F.col("place") - F.col("skip")
    gap = F.raise_error(F.format_string("%s: expected page %d, got %d", "file", expected, "seq"))
    placed = placed.withColumn("seq", F.when(F.col("seq") == expected, F.col("seq")).otherwise(gap.cast("long")))
    totals = counts.groupBy("file").agg(F.sum("n").alias("pages"))
    wrong = F.raise_error(F.format_string("%s: segments do not have the same video stream", "file"))
    head = _head_of(_with_duration)(F.when(F.col("kinds") == 1, F.col("head")).otherwise(wrong.cast("binary")), "pages")
    return write_parts(placed, one.join(totals, "file").select("file", head.alias("head")))


def muxed(files: DataFrame, audio: DataFrame, silence: bytes, rate: int = 48000) -> DataFrame:
    """file, part, content: files(file, content) with an audio packet behind each page's packets, by position (audio: file, frame, body).

    Missing audio is silence, audio beyond the video is cut.
    """
    pages = read_pages(files.withColumn("segment", F.lit(0)))
    both = pages.join(audio.select("file", F.col("frame").alias("place"), F.col("body").alias("sound")), ["file", "place"], "left")
    sound = F.coalesce("sound", F.lit(silence))
    little = lambda c, n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * b).bitwiseAND(F.lit(255))), 2, "0")) for b in range(n)))
    head = F.concat(F.unhex(F.lit(struct.pack("<BBHI", 1, 0, PACKET, 0).hex())), little(F.length(sound).cast("long"), 4), little(F.col("place"), 4))
    pages = both.withColumn("payload", F.concat("payload", head, sound)).withColumn("count", F.col("count") + 1)
    heads = files.select("file", _head_of(_with_audio)(F.substring("content", 1, MAX_FIRST), F.lit(rate)).alias("head"))
    return write_parts(pages, heads)


def retime(data: bytes, num: int, den: int) -> bytes:
    """The same pages at another frame rate: descriptors, page times and duration."""
    first = first_page(data)
    head, n = bytearray(data[:first]), 0
    at = HEADER
    while at + DESCRIPTOR <= first:
        if head[at + 1] == VIDEO:
            struct.pack_into("<HH", head, at + 20, num, den)
        at += struct.unpack_from("<H", head, at + 2)[0]
    out = []
    for flags, seq, _, count, reserved, payload in _pages(data):
        out.append(_page(flags, seq, seq * TICKS * den // num, count, reserved, payload))
        n += 1
    struct.pack_into("<Q", head, 20, n * TICKS * den // num)
    return bytes(head) + b"".join(out)


def retimed(files: DataFrame, num: int, den: int) -> DataFrame:
    """files(file, content) at another frame rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([retime(c.as_py(), num, den) for c in batch.column(1)], pa.binary())], names=["file", "content"])

    return files.select("file", "content").mapInArrow(run, "file string, content binary")


def body_fields(body):
    """Column of a struct (codec, frame, keyframe, y_size, cb_size, cr_size) of a delta codec's body, of which 28 bytes are enough; null for others."""
    from reelspark.functions.numbers import le

    codec = F.substring(body, 1, 4).cast("string")
    sizes = [le(body, F.lit(16 + 4 * k), 4).alias(f"{p}_size") for k, p in enumerate(("y", "cb", "cr"))]
    fields = F.struct(codec.alias("codec"), le(body, F.lit(8), 4).alias("frame"), (le(body, F.lit(12), 1) == 1).alias("keyframe"), *sizes)
    return F.when((F.length(body) >= 28) & codec.isin("M2Y1", "M2Y2"), fields)
