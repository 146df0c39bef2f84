"""Video kernels, the range coder, the second container, merges and seek indexes."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.operators import codecs, rangecoder, video
from reelspark.sources import blockstream, container
from reelspark.sources.container import Stream


def test_full_search_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    before = rng.integers(0, 256, (48, 64)).astype(np.uint8)
    current = np.roll(before, (2, -3), (0, 1))
    place, sad = video.full_search(current, before, 4)
    moves = np.array(video.candidates(4))
    assert len(moves) == 81 and tuple(moves[0]) == (0, 0)
    assert (moves[place[1:-1, 1:-1]] == (3, -2)).all() and (sad[1:-1, 1:-1] == 0).all()
    assert video.global_vector(current, before) == (3, -2)
    frames = spark.createDataFrame([("s", 0, before.tobytes()), ("s", 1, current.tobytes()), ("s", 2, current.tobytes())], "stream string, frame long, plane binary")
    rows = video.motion(frames, 64, 48).collect()
    assert {(r.mx, r.my, r.sad) for r in rows if r.frame == 2} == {(0, 0, 0)} and {r.frame for r in rows} == {1, 2}


def test_first_of_equals_and_cutoff():
    flat = np.full((16, 16), 9, np.uint8)
    place, sad = video.full_search(flat, flat, 3)
    assert (place == 0).all() and (sad == 0).all()
    place, sad = video.full_search(flat, flat + 200, 3, cutoff=100)
    assert (place == -1).all() and (sad == -1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-255, 255), min_size=16, max_size=16), st.integers(1, 9))
def test_transform_and_sparse(values, q):
    block = np.array(values).reshape(1, 4, 4)
    assert (video.inverse(video.forward(block)) == block).all()
    levels = np.clip(video.quantize(video.forward(block), 64 * q), -128, 127).ravel()
    data = video.pack_sparse(levels)
    assert len(data) == 2 + np.count_nonzero(levels)
    back, used = video.unpack_sparse(data + b"rest", 16)
    assert (back == levels).all() and used == len(data)


def plain_encode(data):
    """The usual coder with a cached byte, one bit at a time."""
    model = [[1024] * 256 for _ in range(4)]
    low, span, cache, pending, out, before = 0, 0xFFFFFFFF, 0, 1, bytearray(), 0

    def shift():
        nonlocal low, cache, pending
        if low < 0xFF000000 or low > 0xFFFFFFFF:
            carry = low >> 32
            while pending:
                out.append((cache + carry) & 255)
                cache, pending = 255, pending - 1
            cache = low >> 24 & 255
        pending += 1
        low = low << 8 & 0xFFFFFFFF

    for byte in data:
        probs, node = model[before >> 6], 1
        for k in range(7, -1, -1):
            bit, bound = byte >> k & 1, (span >> 11) * probs[node]
            if bit:
                low, span, probs[node] = low + bound, span - bound, probs[node] - (probs[node] >> 5)
            else:
                span, probs[node] = bound, probs[node] + ((2048 - probs[node]) >> 5)
            node = node << 1 | bit
            while span < 1 << 24:
                span = span << 8 & 0xFFFFFFFF
                shift()
        before = byte
    for _ in range(5):
        shift()
    return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=80), st.binary(max_size=3).map(lambda b: b * 40)), min_size=1, max_size=6))
def test_range_coder(packets):
    coded = rangecoder.encode(packets)
    assert coded == [plain_encode(p) for p in packets]
    assert rangecoder.decode(coded, [len(p) for p in packets]) == packets


def test_range_coder_rows(spark):
    rows = [(k, bytes([k % 7] * k)) for k in range(40)] + [(99, None)]
    got = rangecoder.encode_packets(spark.createDataFrame(rows, "frame long, body binary"), lanes=16).collect()
    assert len(got) == 41 and all(r.verified for r in got)


class Writer:
    def __init__(self):
        self.bits = []

    def number(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]
        return self

    def unary(self, n):
        return self.number(1, n)

    def done(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[k : k + 8])), 2) for k in range(0, len(self.bits), 8))


def piece(stream, body, ends):
    w = Writer().unary(1).number(stream, 1).number(int(ends), 1)
    if ends:
        w.unary(2).number(1, 2).number(0, 1).unary(1).number(5, 28)
    return w.number(len(body) - 1, 13).done() + body


def block(ts, pieces, size=600, streams=True):
    head = blockstream.SYNC + b"\0\0" + ts.to_bytes(8, "big") + (size - 1).to_bytes(2, "big")
    if streams:
        head += bytes([1, 12, 0, 0]) + struct.pack(">HHHH", 24, 1, 320, 240) + b"\0\0" + bytes([2, 6, 1, 1]) + (31999).to_bytes(3, "big") + bytes([1])
    data = head + bytes([0, 0]) + b"\0" + b"".join(pieces)
    return data + b"\0" * (size - len(data))


def test_block_stream(spark):
    data = block(0, [piece(0, b"\x80first", False), piece(1, b"sound", True)]) + block(40000, [piece(0, b" rest", True), piece(0, b"\x01next", True)]) + block(80000, [piece(1, b"x" * 100, True)], streams=False)
    got = [(p.ts_us, p.stream, p.keyframe, p.body, t.media) for p, t in blockstream.packets(data)]
    assert got == [(0, 1, True, b"sound", "audio"), (40000, 0, True, b"\x80first rest", "video"), (40000, 0, False, b"\x01next", "video"), (80000, 1, True, b"x" * 100, "audio")]
    assert [t.rate for _, t in blockstream.packets(data)][0] == 32000
    assert len(list(blockstream.packets(data[:1240]))) == 3
    assert blockstream.seek(data, 79999) == (600, 40000) and blockstream.seek(data, -5) == (0, 0) and blockstream.seek(b"", 0) is None
    with pytest.raises(ValueError, match="no sync"):
        list(blockstream.packets(b"nothing here"))
    assert blockstream.read_packets(spark.createDataFrame([("f", data)], "file string, content binary")).count() == 4


VIDEO = Stream(0, 1, "M2Y0", 16, 16, 24000, 1001)


def segment(start, n):
    data = container.build([VIDEO], [[(0, 0, start + k, b"M2Y0" + bytes([start + k]))] for k in range(n)])
    pages = [(f, start + k, (start + k) * 30000 * 1001 // 24000, c, r, p) for k, (f, _, _, c, r, p) in enumerate(container._pages(data))]
    return data[: container.first_page(data)] + b"".join(container._page(*p) for p in pages)


def walk(data):
    return list(container.packets_of(lambda at, n: data[at : at + n], len(data), container.first_page(data), strict=True))


def test_merge_mux_and_retime():
    merged = container.merge([segment(0, 3), segment(2, 3), segment(5, 1)], [0, 1, 0])
    assert [p.seq for p in walk(merged)] == list(range(6)) and merged == container.build([VIDEO], [[(0, 0, k, b"M2Y0" + bytes([k]))] for k in range(6)])
    with pytest.raises(ValueError, match="expected page 3"):
        container.merge([segment(0, 3), segment(2, 3)])
    both = container.mux(merged, [b"a" * 4, b"b" * 4], b"\0" * 4)
    assert [p.body for p in walk(both) if p.sid == 1] == [b"aaaa", b"bbbb"] + [b"\0" * 4] * 4
    assert [s.stype for s in container.streams_of(both)] == [1, 2] and all(p.crc_ok for p in walk(both))
    slow = container.retime(both, 30, 1)
    assert [p.pts for p in walk(slow) if p.sid == 0] == [k * 1000 for k in range(6)] and container.streams_of(slow)[0].fps_num == 30


def test_seek_indexes():
    data, points = container.merge([segment(0, 3)]), [(0, 96), (2, 300)]
    assert container.parse_index(container.index_payload(len(data), 96, points), False) == (len(data), 96, points, 3)
    whole = container.with_index(data, points, 3)
    offset, length = struct.unpack_from("<QI", whole, len(whole) - 24)
    assert container.parse_index(whole[offset : offset + length], True) == (len(whole), 96, points, 3)
    assert len(list(container.packets_of(lambda at, n: whole[at : at + n], len(whole), 96))) == 3
    assert container.with_index(data, [], 0) == data
    with pytest.raises(ValueError, match="no seek index"):
        container.parse_index(b"x" * 40, False)


@pytest.mark.parametrize("channels", [1, 2])
def test_subframes_equal_a_plain_loop(channels):
    rng = random.Random(channels)
    for size in (0, 3, 4 * channels, 4 * channels + 127, 4 * channels + 128 * channels, 4 * channels + 700):
        head = b"".join(struct.pack("<hh", rng.randint(0, 88), rng.randint(-32768, 32767)) for _ in range(channels))
        data = (head + rng.randbytes(800))[:size]
        got = codecs.decode_subframes(data, channels)
        n = max(size - 4 * channels, 0) * 2 // channels // 256
        assert got.shape == (n * 256, channels)
        state = [list(struct.unpack_from("<hh", data, 4 * c)) for c in range(channels)] if n else []
        at = 4 * channels
        for sub in range(n):
            for c in range(channels):
                for k in range(256):
                    nibble = data[at + k // 2] >> 4 * (k % 2) & 15
                    index, value = state[c]
                    move = (2 * (nibble & 7) + 1) * int(codecs.STEPS[index]) // 8
                    value = max(-32768, min(32767, value + (-move if nibble & 8 else move)))
                    state[c] = [max(0, min(88, index + int(codecs.MOVES[nibble & 7]))), value]
                    assert got[sub * 256 + k, c] == value
                at += 128
    with pytest.raises(ValueError):
        codecs.decode_subframes(struct.pack("<hh", 89, 0) * 2, channels)
    with pytest.raises(ValueError):
        codecs.decode_subframes(b"", 3)
