"""Block kernels of inter-frame coding, vectorised over blocks and candidates: motion search, 4 x 4 transform, sparse packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, CUTOFF = 8, 4096
#: Fixed value: what a block outside of the frame costs in the global search.
OUTSIDE = 4096


def candidates(reach: int) -> list[tuple[int, int]]:
    """All vectors within reach in the order in which equals are tried: none, along x, along y, then ring by ring."""
    out = [(0, 0)]
    out += [(s * r, 0) for r in range(1, reach + 1) for s in (-1, 1)]
    out += [(0, s * r) for r in range(1, reach + 1) for s in (-1, 1)]
    for r in range(1, reach + 1):
        out += [(-r, -r), (r, -r), (-r, r), (r, r)]
        out += [(x, y) for x in range(1 - r, r) for y in (-r, r)]
        out += [(x, y) for y in range(1 - r, r) for x in (-r, r)]
    return list(dict.fromkeys(out))


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane[: h // BLOCK * BLOCK, : w // BLOCK * BLOCK].reshape(h // BLOCK, BLOCK, w // BLOCK, BLOCK).swapaxes(1, 2).astype(np.int64)


def _differences(current: np.ndarray, before: np.ndarray, x: int, y: int) -> np.ndarray:
    """Sum of absolute differences of each block to the one moved by (x, y); -1 where that leaves the frame."""
    rows, cols = current.shape[:2]
    h, w = before.shape
    out = np.full((rows, cols), -1, np.int64)
    top, left = np.arange(rows) * BLOCK + y, np.arange(cols) * BLOCK + x
    r, c = np.flatnonzero((top >= 0) & (top + BLOCK <= h)), np.flatnonzero((left >= 0) & (left + BLOCK <= w))
    if len(r) and len(c):
        moved = before[top[r[0]] : top[r[-1]] + BLOCK, left[c[0]] : left[c[-1]] + BLOCK]
        out[np.ix_(r, c)] = np.abs(current[np.ix_(r, c)] - _blocks(moved)).sum((2, 3))
    return out


def full_search(current: np.ndarray, before: np.ndarray, reach: int, cutoff: int = CUTOFF) -> tuple[np.ndarray, np.ndarray]:
    """Place in candidates() of each block's best vector, and its difference; -1 where none is at most the cutoff."""
    blocks = _blocks(current)
    best, place = np.full(blocks.shape[:2], cutoff + 1), np.full(blocks.shape[:2], -1)
    for k, (x, y) in enumerate(candidates(reach)):
        cost = _differences(blocks, before.astype(np.int64), x, y)
        better = (cost >= 0) & (cost < best)
        best[better], place[better] = cost[better], k
    return place, np.where(place >= 0, best, -1)


def global_vector(current: np.ndarray, before: np.ndarray, reach: int = 8) -> tuple[int, int]:
    """The vector of the least difference over every second inner block, row by row; held in -8 to 7."""
    blocks, best, vector = _blocks(current), None, (0, 0)
    reach = min(max(reach, 0), 8)
    for y in range(-reach, reach + 1):
        for x in range(-reach, reach + 1):
            cost = _differences(blocks, before.astype(np.int64), x, y)[1:-1:2, 1:-1:2]
            total = int(np.where(cost < 0, OUTSIDE, cost).sum())
            if best is None or total < best:
                best, vector = total, (x, y)
    return min(vector[0], 7), min(vector[1], 7)


def motion(frames: DataFrame, width: int, height: int, reach: int = 4) -> DataFrame:
    """frames(stream, frame, plane binary) -> stream, frame, bx, by, mx, my, sad of each block against the frame before."""
    w = Window.partitionBy("stream").orderBy("frame")
    pairs = frames.withColumn("before", F.lag("plane").over(w)).where("before IS NOT NULL").select("stream", "frame", "plane", "before")
    moves = np.array(candidates(reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, frame, now, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                current, before = (np.frombuffer(p, np.uint8).reshape(height, width) for p in (now, old))
                place, sad = full_search(current, before, reach)
                by, bx = np.nonzero(place >= 0)
                vector, n = moves[place[by, bx]], len(bx)
                cols = [pa.array([stream] * n, pa.string()), pa.array([frame] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in (bx, by, vector[:, 0], vector[:, 1], sad[by, bx]))]
                yield pa.RecordBatch.from_arrays(cols, names=["stream", "frame", "bx", "by", "mx", "my", "sad"])

    return pairs.mapInArrow(run, "stream string, frame long, bx long, by long, mx long, my long, sad long")


#: Fixed value: rows of the 4 x 4 transform; it is its own inverse but for a factor of 16.
TRANSFORM = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]], np.int64)


def forward(blocks: np.ndarray) -> np.ndarray:
    """(n, 4, 4) residuals to coefficients."""
    return TRANSFORM @ blocks.astype(np.int64) @ TRANSFORM.T


def inverse(blocks: np.ndarray) -> np.ndarray:
    return (TRANSFORM.T @ blocks.astype(np.int64) @ TRANSFORM + 8) >> 4


def quantize(values: np.ndarray, q: int) -> np.ndarray:
    """Rounded to the nearest step, halves away from zero."""
    q = max(q, 1)
    return np.sign(values) * ((np.abs(values) + q // 2) // q)


def pack_sparse(values: np.ndarray) -> bytes:
    """A mask of the values that are not zero (first value in the lowest bit), then those values as signed bytes."""
    values = np.clip(values, -128, 127).astype(np.int8)
    return np.packbits(values != 0, bitorder="little").tobytes() + values[values != 0].tobytes()


def unpack_sparse(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """n values and how many bytes they took."""
    head = -(-n // 8)
    mask = np.unpackbits(np.frombuffer(data, np.uint8, head), count=n, bitorder="little").astype(bool)
    out = np.zeros(n, np.int8)
    out[mask] = np.frombuffer(data, np.int8, int(mask.sum()), head)
    return out, head + int(mask.sum())


def transformed(blocks: DataFrame, q: int) -> DataFrame:
    """blocks(vec_id, block of 16 values) -> vec_id, levels (quantized coefficients), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                levels = quantize(forward(np.array(batch.column(1).to_pylist()).reshape(-1, 4, 4)), q).reshape(-1, 16)
                packed = pa.array([pack_sparse(v) for v in levels], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(levels), pa.list_(pa.int64())), packed], names=["vec_id", "levels", "packed"])

    return blocks.select("vec_id", "block").mapInArrow(run, "vec_id long, levels array<long>, packed binary")
