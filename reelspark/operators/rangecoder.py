"""Adaptive binary range coder for packets: bytes as paths in a bit tree, contexts by the byte before.

A packet is sequential and begins with a fresh model; the packets of a batch are
coded side by side, a lane each. The encoder writes digits of nine bits, whose
carries are added up at the end, so that a step is the same for all lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a probability, speed of adaption, smallest range, and bits of the byte before that make the context.
BITS, MOVE, TOP, CONTEXT = 11, 5, 1 << 24, 2
_U = np.uint64


def _lanes(packets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in packets], np.int64)
    table = np.zeros((len(packets), int(sizes.max(initial=0)) + 8), np.uint8)
    for k, p in enumerate(packets):
        table[k, : len(p)] = np.frombuffer(p, np.uint8)
    return table, sizes


def _adapt(model: np.ndarray, at: tuple, bit: np.ndarray) -> None:
    p = model[at]
    model[at] = np.where(bit, p - (p >> MOVE), p + (((1 << BITS) - p) >> MOVE))


def encode(packets: list[bytes]) -> list[bytes]:
    table, sizes = _lanes(packets)
    n = len(packets)
    model = np.full((n, 1 << CONTEXT, 256), 1 << (BITS - 1), np.int64)
    low, span = np.zeros(n, _U), np.full(n, 0xFFFFFFFF, _U)
    digits, used = np.zeros((n, 2 * table.shape[1] + 16), np.int32), np.zeros(n, np.int64)

    def shift(rows: np.ndarray) -> None:
        digits[rows, used[rows]] = (low[rows] >> _U(24)).astype(np.int32)
        used[rows] += 1
        low[rows] = (low[rows] & _U(0xFFFFFF)) << _U(8)

    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        context = (table[rows, k - 1] >> (8 - CONTEXT)).astype(np.int64) if k else np.zeros(len(rows), np.int64)
        node = np.ones(len(rows), np.int64)
        for place in range(7, -1, -1):
            bit = (table[rows, k] >> place & 1).astype(bool)
            bound = (span[rows] >> _U(BITS)) * model[rows, context, node].astype(_U)
            low[rows] += np.where(bit, bound, _U(0))
            span[rows] = np.where(bit, span[rows] - bound, bound)
            _adapt(model, (rows, context, node), bit)
            node = node << 1 | bit
            while len(small := rows[span[rows] < TOP]):
                span[small] <<= _U(8)
                shift(small)
                if (used + 8 > digits.shape[1]).any():
                    digits = np.pad(digits, ((0, 0), (0, digits.shape[1])))
    for _ in range(4):
        shift(np.arange(n))
    out = []
    for k in range(n):
        number = np.append(0, digits[k, : used[k]])  # the first byte takes a carry that goes all the way
        while (over := np.flatnonzero(number > 255)).size:
            number[over] -= 256
            number[over - 1] += 1
        out.append(number.astype(np.uint8).tobytes())
    return out


def decode(packets: list[bytes], lengths: list[int]) -> list[bytes]:
    """The first lengths bytes of each packet; what lies beyond a packet's end reads as zeros."""
    table, sizes = _lanes(packets)
    n, wanted = len(packets), np.array(lengths, np.int64)
    model = np.full((n, 1 << CONTEXT, 256), 1 << (BITS - 1), np.int64)
    out = np.zeros((n, int(wanted.max(initial=0))), np.uint8)
    span, code, at = np.full(n, 0xFFFFFFFF, _U), np.zeros(n, _U), np.ones(n, np.int64)

    def more(rows: np.ndarray) -> None:
        there = at[rows] < sizes[rows]
        byte = np.where(there, table[rows, np.minimum(at[rows], table.shape[1] - 1)], 0)
        code[rows] = (code[rows] << _U(8) | byte.astype(_U)) & _U(0xFFFFFFFF)
        at[rows] += there

    for _ in range(4):
        more(np.arange(n))
    for k in range(out.shape[1]):
        rows = np.flatnonzero(wanted > k)
        context = (out[rows, k - 1] >> (8 - CONTEXT)).astype(np.int64) if k else np.zeros(len(rows), np.int64)
        node = np.ones(len(rows), np.int64)
        for _ in range(8):
            bound = (span[rows] >> _U(BITS)) * model[rows, context, node].astype(_U)
            bit = code[rows] >= bound
            code[rows] -= np.where(bit, bound, _U(0))
            span[rows] = np.where(bit, span[rows] - bound, bound)
            _adapt(model, (rows, context, node), bit)
            node = node << 1 | bit
            while len(small := rows[(span[rows] < TOP) & (span[rows] > 0)]):
                span[small] <<= _U(8)
                more(small)
        out[rows, k] = (node & 255).astype(np.uint8)
    return [out[k, : wanted[k]].tobytes() for k in range(n)]


def encode_packets(packets: DataFrame, lanes: int = 256) -> DataFrame:
    """packets(frame, body) -> frame, coded, length, verified (the coded body gives the body again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lanes):
                batch = whole.slice(at, lanes)
                bodies = [b or b"" for b in batch.column(1).to_pylist()]
                sizes = [len(b) for b in bodies]
                coded = encode(bodies)
                same = [a == b for a, b in zip(decode(coded, sizes), bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array(sizes, pa.int64()), pa.array(same)], names=["frame", "coded", "length", "verified"])

    return packets.select("frame", "body").mapInArrow(run, "frame long, coded binary, length long, verified boolean")


def decode_packets(packets: DataFrame, lanes: int = 256) -> DataFrame:
    """packets(frame, coded, length) -> frame, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lanes):
                batch = whole.slice(at, lanes)
                bodies = decode(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["frame", "body"])

    return packets.select("frame", "coded", "length").mapInArrow(run, "frame long, body binary")
