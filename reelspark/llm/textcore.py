"""Kernels on Arrow batches of texts, shared by the operators of this subpackage.

A whole batch of texts is treated as one byte buffer with offsets, so words and
their hashes come out of a few vectorised passes instead of a loop over rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
LEFT, RIGHT, SEEDS = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))
SLICE_BYTES, LONG_WORD, BLOCK = 2 << 20, 64, 1 << 16  # BLOCK: words hashed at a time
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Returns to the system what this process has freed: that of Arrow's pool and of the C library's heaps."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable) -> Callable:
    """The kernel run(batches); at the end of a task its worker, which stays for those of other stages, gives back its memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable) -> Callable:
    """The same for run(key, table), at the end of a group."""

    def group(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return group


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about limit bytes of text, to bound memory."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word index of each text for words [^\\x20\\x09-\\x0D]+."""
    space = data - np.uint8(9) < 5  # wraps below 9
    space |= data == 32
    edge = np.ones(len(data) + 1, bool)  # True: what stands before this byte is no part of its word
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    del edge
    starts, ends = at[:-1], at[1:]
    word = ~space[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time, mixed; XXH64 from LONG_WORD bytes on. Seeds 0 and 1 are independent."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    raw, digest = memoryview(padded), xxhash.xxh64_intdigest
    for a in range(0, len(starts), BLOCK):
        begin, end = starts[a : a + BLOCK], ends[a : a + BLOCK]
        lengths = end - begin
        some = out[a : a + BLOCK]
        some[:] = mix(lengths.astype(_U) ^ SEEDS[seed])
        rows = np.flatnonzero(lengths < LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            rows = rows[lengths[rows] > at] if at else rows
            if not len(rows):
                break
            left = np.minimum(lengths[rows] - at, 8)
            bits = eight[begin[rows] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(_U))
            some[rows] = mix(some[rows] * LEFT + bits)
        for k in np.flatnonzero(lengths >= LONG_WORD).tolist():
            some[k] = digest(raw[begin[k] : end[k]], seed)
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i : i + width] for every i, made of hashes of runs of 1, 2, 4 ... words; windows may cross texts, callers mask those."""
    out = np.zeros(max(len(words) - width + 1, 0), _U)
    for a in range(0, len(out), BLOCK):
        out[a : a + BLOCK] = _window_hashes(words[a : a + BLOCK + width - 1], width)
    return out


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    total, done, run, size = None, 0, words, 1
    while True:
        if width & size:
            n = len(words) - done - size + 1
            total = run if total is None else mix(total[:n] * LEFT + (run[done : done + n] ^ RIGHT))
            done += size
        if done == width:
            return mix(total ^ RIGHT)
        run = mix(run[:-size] * LEFT + (run[size:] ^ RIGHT))
        size *= 2


def window_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and row of every window of width words that lies inside one text."""
    counts = np.diff(first)
    per = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), per)
    begin = np.cumsum(per) - per
    return np.arange(int(per.sum())) - np.repeat(begin, per) + np.repeat(first[:-1], per), row


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window of width words that begins at one of starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def byte_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
