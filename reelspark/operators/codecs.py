"""ADPCM audio packets: sequential within a packet, packets side by side in vectorised steps."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The step sizes of IMA ADPCM grow by about a tenth from 7; the table is the public one.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
TAG = b"IA4M"


def _step(nibble: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    move = (step >> 3) + (nibble >> 2 & 1) * step + (nibble >> 1 & 1) * (step >> 1) + (nibble & 1) * (step >> 2)
    predictor = np.clip(np.where(nibble & 8, predictor - move, predictor + move), -32768, 32767)
    return predictor, np.clip(index + MOVES[nibble & 7], 0, 88)


def encode(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packets, samples) -> first samples and (packets, samples - 1) nibbles; every packet begins anew."""
    samples = np.clip(samples, -32768, 32767).astype(np.int64)
    predictor, index = samples[:, 0].copy(), np.zeros(len(samples), np.int64)
    out = np.zeros((len(samples), max(samples.shape[1] - 1, 0)), np.int64)
    for k in range(1, samples.shape[1]):
        left, nibble = samples[:, k] - predictor, np.zeros(len(samples), np.int64)
        nibble[left < 0] = 8
        left = np.abs(left)
        for bit, part in ((4, 0), (2, 1), (1, 2)):
            size = STEPS[index] >> part
            fits = left >= size
            nibble += bit * fits
            left = left - size * fits
        predictor, index = _step(nibble, predictor, index)
        out[:, k - 1] = nibble
    return samples[:, 0], out


def decode(first: np.ndarray, nibbles: np.ndarray) -> np.ndarray:
    predictor, index = first.astype(np.int64), np.zeros(len(first), np.int64)
    out = np.zeros((len(first), nibbles.shape[1] + 1), np.int64)
    out[:, 0] = predictor
    for k in range(nibbles.shape[1]):
        predictor, index = _step(nibbles[:, k], predictor, index)
        out[:, k + 1] = predictor
    return out


def packet(frame: int, first: int, nibbles: np.ndarray) -> bytes:
    pairs = np.append(nibbles, np.zeros(len(nibbles) % 2, np.int64)).reshape(-1, 2)
    data = (pairs[:, 0] | pairs[:, 1] << 4).astype(np.uint8).tobytes()
    return TAG + struct.pack("<IHBBhBBI", frame, len(nibbles) + 1, 1, 0, first, 0, 0, len(data)) + data


def parse(data: bytes) -> tuple[int, int, np.ndarray]:
    """Frame, first sample and nibbles of a packet."""
    frame, n, _, _, first, _, _, size = struct.unpack_from("<IHBBhBBI", data, 4)
    raw = np.frombuffer(data, np.uint8, size, 20).astype(np.int64)
    return frame, first, np.stack([raw & 15, raw >> 4], axis=1).ravel()[: n - 1]


def encode_frames(frames: DataFrame) -> DataFrame:
    """frames(frame, samples array<int>), samples of equal number -> frame, packet, max_error of the decoded packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pcm = np.array(batch.column(1).to_pylist(), np.int64)
            first, nibbles = encode(pcm)
            error = np.abs(decode(first, nibbles) - np.clip(pcm, -32768, 32767)).max(1)
            packets = [packet(f, int(a), n) for f, a, n in zip(batch.column(0).to_pylist(), first, nibbles, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packets, pa.binary()), pa.array(error)], names=["frame", "packet", "max_error"])

    return frames.select("frame", "samples").mapInArrow(run, "frame long, packet binary, max_error long")


#: Fixed value: samples of a subframe of the second codec.
SUBFRAME = 256


def decode_subframes(data: bytes, channels: int) -> np.ndarray:
    """(samples, channels) of a packet: for each channel its step index and predictor, then whole subframes, a channel's after the other's.

    Bytes beyond the last whole subframe are not decoded; an index beyond the
    table raises ValueError, a packet shorter than its head has no samples.
    """
    if channels not in (1, 2):
        raise ValueError(f"{channels} channels")
    if len(data) < 4 * channels:
        return np.zeros((0, channels), np.int64)
    index, predictor = np.frombuffer(data, "<i2", 2 * channels).reshape(-1, 2).T.astype(np.int64)
    if ((index < 0) | (index > 88)).any():
        raise ValueError(f"step index {index.max()}")
    n = (len(data) - 4 * channels) * 2 // channels // SUBFRAME
    raw = np.frombuffer(data, np.uint8, n * channels * SUBFRAME // 2, 4 * channels).astype(np.int64)
    nibbles = np.stack([raw & 15, raw >> 4], axis=1).reshape(n, channels, SUBFRAME).swapaxes(1, 2).reshape(-1, channels)
    out = np.zeros(nibbles.shape, np.int64)
    for k, nibble in enumerate(nibbles):  # channels side by side
        move = (2 * (nibble & 7) + 1) * STEPS[index] >> 3
        predictor = out[k] = np.clip(np.where(nibble & 8, predictor - move, predictor + move), -32768, 32767)
        index = np.clip(index + MOVES[nibble & 7], 0, 88)
    return out


def decode_packets(packets: DataFrame, channels: int) -> DataFrame:
    """packets(packet, data) -> packet, samples (interleaved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = [decode_subframes(d or b"", channels).ravel().astype(np.int16) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(samples, pa.list_(pa.int16()))], names=["packet", "samples"])

    return packets.select("packet", "data").mapInArrow(run, "packet long, samples array<short>")
