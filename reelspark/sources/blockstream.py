"""The second container: blocks that begin with a sync word, and packets with bit-packed headers that may span blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format: the sync word, and kinds of stream descriptors.
SYNC = b"\x4c\x32"
END, VIDEO, AUDIO, VIDEO_WIDE, DATA = 0, 1, 2, 3, 4
PACKETS = "file string, block_offset long, ts_us long, stream int, media string, codec int, keyframe boolean, body binary"


class Track(NamedTuple):
    media: str
    codec: int
    time_base: tuple[int, int]
    width: int = 0
    height: int = 0
    rate: int = 0
    channels: int = 0


class Piece(NamedTuple):
    block_offset: int
    ts_us: int
    stream: int
    keyframe: bool
    body: bytes


class Bits:
    """Bits from the highest down, beginning at a byte; what is left of a byte is dropped when bytes are read on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left = data, at, 0

    def one(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise EOFError
            self.at, self.left = self.at + 1, 8
        self.left -= 1
        return self.data[self.at - 1] >> self.left & 1

    def number(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def unary(self) -> int:
        n = 1
        while not self.one():
            n += 1
        return n


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of up to four bytes, seven bits each while the top bit is set."""
    value = 0
    for k in range(4):
        if at >= len(data):
            raise EOFError
        byte, at = data[at], at + 1
        if k == 3:
            return value << 7 | byte, at
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            break
    return value, at


def _sync(data: bytes, at: int, tracks: list[Track]) -> tuple[int, int, int] | None:
    """(timestamp, block size, where it goes on) of a sync at this place; tracks that are new are added."""
    if data[at : at + 2] != SYNC:
        return None
    big = lambda a, n: int.from_bytes(data[a : a + n], "big")
    ts, size, at = big(at + 4, 8), big(at + 12, 2) + 1, at + 14
    while at < len(data):
        kind, at = _number(data, at)
        length, at = _number(data, at)
        index, track = -1, None
        if kind == END:
            return ts, size, at + length
        if kind == AUDIO:
            rate = big(at + 2, 3) + 1
            index, track, at = big(at, 1), Track("audio", big(at + 1, 1), (1, rate), rate=rate, channels=big(at + 5, 1) + 1), at + 6
        elif kind in (VIDEO, VIDEO_WIDE):
            track = Track("video", big(at + 1, 1), (big(at + 4, 2), big(at + 2, 2)), big(at + 6, 2), big(at + 8, 2))
            index, at = big(at, 1), at + 10 + (3 if kind == VIDEO_WIDE else 2)
        elif kind == DATA:
            index, track, at = big(at, 1), Track("data", 0, (0, 0)), at + 2
        if track is not None and index == len(tracks) < 16:
            tracks.append(track)
    return ts, size, at


def packets(data: bytes) -> Iterator[tuple[Piece, Track]]:
    """Whole packets in order: pieces of a stream add up until one ends a frame. Ends quietly where the data do; ValueError on damage."""
    tracks: list[Track] = []
    parts: dict[int, bytearray] = {}
    at, ts, size, flags = 0, 0, 0, 0
    try:
        while at < len(data):
            start = at
            if (found := _sync(data, at, tracks)) is not None:
                ts, size, at = found
            elif not tracks:
                raise ValueError("no sync word at the beginning")
            if at >= len(data):
                return
            flags, at = data[at], at + 1
            if flags & 2:
                at += 2
            while at < min(start + size, len(data)):
                if not data[at]:
                    at += 1
                    break
                bits = Bits(data, at)
                stream = bits.number(bits.unary())
                if stream >= len(tracks):
                    raise ValueError(f"packet of unknown stream {stream} at byte {at}")
                ends = bits.one()
                if ends:
                    bits.number(bits.unary())
                    bits.one()
                    bits.number(bits.unary() * 2 + 26)
                length = bits.number(13) + 1
                if length > size or bits.at + length > len(data):
                    if length > size:
                        raise ValueError(f"packet at byte {at} is longer than its block")
                    return
                body = parts.setdefault(stream, bytearray())
                body += data[bits.at : bits.at + length]
                at = bits.at + length
                if ends:
                    track = tracks[stream]
                    yield Piece(start, ts, stream, track.media != "video" or body[0] >= 0x80, bytes(body)), track
                    parts[stream] = bytearray()
            if flags % 2 == 0:
                at = start + size
    except EOFError:
        return


def seek(data: bytes, target_us: int) -> tuple[int, int] | None:
    """(offset, timestamp) of the last block at or before a time, or of the first block; blocks are told by plausible sync words."""
    blocks, at = [], data.find(SYNC)
    while at >= 0:
        blocks.append((at, int.from_bytes(data[at + 4 : at + 12], "big")))
        at = data.find(SYNC, at + 2)
    last = blocks[-1][1] if blocks else 0
    known = [(at, ts) for at, ts in blocks if ts <= last + 2_000_000]
    before = [b for b in known if b[1] <= target_us]
    return before[-1] if before else (known[0] if known else None)


def read_packets(files: DataFrame) -> DataFrame:
    """Packets of files(file, content)."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in PACKETS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, p.block_offset, p.ts_us, p.stream, t.media, t.codec, p.keyframe, p.body) for p, t in packets(data.as_py())]
                for at in range(0, len(rows), 4096):
                    cols = zip(*rows[at : at + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return files.select("file", "content").mapInArrow(run, PACKETS)
