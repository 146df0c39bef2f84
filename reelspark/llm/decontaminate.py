"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces. Wherever a text
holds the item with at most k edits, one piece at least is there unchanged. An
Aho-Corasick automaton over the pieces of all items finds those places in one
pass over a text. Where more than k of an item's shreds (disjoint pieces of SHRED
characters) are missing around such a place, k edits cannot be enough; elsewhere
Myers' bit-parallel algorithm gives the smallest edit distance of the item to any
passage there.

Items come to the driver a block of BLOCK_CHARS characters at a time and go to the
executors as one broadcast each. Documents are read once, whatever the number of
blocks: with several, a task takes GROUP_BYTES of texts at a time past each block's
automaton, of which it holds one.

Texts and items are compared in lower case with white space runs as one space.

Defined cases: null and empty texts and items match nothing; items so short that
pieces would be under MIN_PIECE characters (below about 90 characters) get a
smaller budget than ERROR_RATE's share, in the end 0 (exact matches only); equal items are reported each with their own item_id;
repeated rows of documents give their rows each; tables may be empty; columns
other than the ids and texts are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.textcore import lean, slices, text_buffer
from reelspark.session import ship

ERROR_RATE, MIN_PIECE, SHRED = 0.1, 9, 5
BLOCK_CHARS, GROUP_BYTES = 4_000_000, 64 << 20
MATCHES = "doc_id long, item_id long, distance int, begin long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(size: int, rate: float = ERROR_RATE, piece: int = MIN_PIECE) -> int:
    """Edits allowed for an item of so many characters: the rate's share, but pieces keep their least length."""
    return max(0, min(int(size * rate), size // piece - 1))


def pieces(size: int, k: int) -> list[tuple[int, int]]:
    """k + 1 adjacent pieces of about equal length."""
    cuts = [size * j // (k + 1) for j in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


class Pattern:
    """An item's bit masks for Myers' algorithm."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def distances(self, text: str) -> Iterator[int]:
        """For each end in text: the least edits between the item and a passage that ends there."""
        ones = (1 << self.size) - 1
        up, down, score, top, get = ones, 0, self.size, 1 << self.size - 1, self.masks.get
        for c in text:
            eq = get(c, 0)
            vertical = eq | down
            eq |= ((eq & up) + up) ^ up
            plus, minus = down | ~(eq | up) & ones, up & eq
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & ones, minus << 1 & ones
            up, down = minus | ~(vertical | plus) & ones, plus & vertical
            yield score


def _may_hold(passage: str, shreds: list[str], k: int) -> bool:
    """False if more than k of the item's short pieces are missing: each takes an edit of its own."""
    for shred in shreds:
        if shred not in passage:
            if not k:
                return False
            k -= 1
    return True


class Matcher:
    """All items of a block, compiled."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, piece: int = MIN_PIECE):
        self.items, self.automaton = [], ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), rate, piece)
            for a, b in pieces(len(text), k):
                places.setdefault(text[a:b], []).append((len(self.items), b))
            shreds = [text[a : a + SHRED] for a in range(0, len(text) - SHRED + 1, SHRED)]
            self.items.append((item_id, text, k, Pattern(text), Pattern(text[::-1]), shreds))
        for key, value in places.items():
            self.automaton.add_word(key, value)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of each item's best passage within its budget, the first of equals."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, places in self.automaton.iter(text):
            for item, b in places:
                _, own, k, _, _, shreds = self.items[item]
                begin = last + 1 - b
                low, high = max(0, begin - k), min(len(text), begin + len(own) + k)
                if not _may_hold(text[low:high], shreds, k):
                    continue
                runs = spans.setdefault(item, [])
                if runs and low <= runs[-1][1] and low >= runs[-1][0]:
                    runs[-1][1] = max(runs[-1][1], high)
                else:
                    runs.append([low, high])
        out = []
        for item, runs in sorted(spans.items()):
            item_id, own, k, pattern, backwards, _ = self.items[item]
            best = None
            for low, high in runs:
                for j, score in enumerate(pattern.distances(text[low:high])):
                    if score <= k and (best is None or score < best[0]):
                        best = (score, low + j + 1)
            if best is not None:
                score, end = best
                before = text[max(0, end - len(own) - k) : end][::-1]
                begin = end - next(j + 1 for j, s in enumerate(backwards.distances(before)) if s == score)
                out.append((item_id, score, begin, end))
        return out


def item_blocks(items: DataFrame) -> list[Broadcast]:
    """The items in blocks of about BLOCK_CHARS characters, each as a broadcast."""
    ship(items.sparkSession)
    send, blocks, block, size = items.sparkSession.sparkContext.broadcast, [], [], 0
    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= BLOCK_CHARS:
            blocks.append(send(block))
            block, size = [], 0
    return [*blocks, send(block)] if block else blocks


def _groups(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about limit bytes of text."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += len(text_buffer(batch.column(column))[0])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _passes(batches: Iterator[pa.RecordBatch], column: int, blocks: list[Broadcast], rate: float, piece: int) -> Iterator[tuple[list[pa.RecordBatch], Iterator[Matcher]]]:
    """Groups of batches, each with the matchers that it has to pass."""
    if len(blocks) == 1:
        matcher = Matcher(blocks[0].value, rate, piece)
        for batch in batches:
            yield [batch], iter([matcher])
        return
    for group in _groups(batches, column, GROUP_BYTES):
        yield group, (Matcher(block.value, rate, piece) for block in blocks)


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, piece: int = MIN_PIECE) -> DataFrame:
    """doc_id, item_id, distance, begin, end: the best passage of each item in each text that holds it.

    begin and end are places in the text as compared (lower case, single spaces).
    """
    blocks = item_blocks(items)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, matchers in _passes(batches, 1, blocks, rate, piece):
            for matcher in matchers:
                for batch in (part for whole in group for part in slices(whole)):
                    rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.find(normal(t))]
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "begin", "end"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCHES)


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, piece: int = MIN_PIECE) -> DataFrame:
    """docs without the rows whose text holds an item; all columns as they are."""
    at, blocks = docs.columns.index("text"), item_blocks(items)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, matchers in _passes(batches, at, blocks, rate, piece):
            for matcher in matchers:
                group = [batch.filter(pa.array([not matcher.find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_())) for batch in group]
            yield from group

    return docs.mapInArrow(run, docs.schema)
