"""Token files: ids of documents, entropy-coded by a static range asymmetric numeral system.

A table of token files has a row for each segment. A segment holds whole
documents in ascending doc_id order, one frequency table counted over all of its
ids, and blocks of up to BLOCK ids that share that table and are coded each for
itself. A block has LANES interleaved coders: id k belongs to lane k modulo
LANES, and all lanes take a step at once. Its payload begins with the lanes' end
states; then follow the 32-bit words in the order in which the reader needs
them. The checkpoints (first id, number of ids, offset and length in bytes, CRC
of each block) let a reader begin at any block.

Writing needs one pass: documents are tokenized where they are read, ids (not
texts) are dealt to buckets of adjacent doc_ids, a partition each, sorted there,
and streamed into segments; memory is that of one segment, whatever the size of a
bucket. Buckets are cut by percentiles of doc_id. A doc_id that fills buckets by
itself, and null, are cut further by a hash of the ids, so no value has to fit one
bucket. There are at most MOST_BUCKETS, which is all that the driver, a plan or the
sums over buckets ever hold; beyond MOST_BUCKETS x ROWS_PER_BUCKET rows, buckets grow.

Defined cases: a null text counts as empty and has the end id only; null doc_ids
come first, each with a slot of its own; equal doc_ids are ordered by a hash of
their ids, then by the ids; an empty table gives no file rows and no result rows.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.bpe import SPACE, TOKENIZER, WORD_AND_MARKS, _Kept, byte_letters
from reelspark.llm.textcore import slices, text_buffer
from reelspark.session import shared_path, ship

#: White space beyond ASCII before a space.
OTHER_RUNS = [c + " " for c in SPACE if not c.isascii()]
END_ID = 2
BLOCK, LANES, SEGMENT = 1 << 19, 4096, 1 << 21
LOW = np.uint64(1 << 31)
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4096, 64, 1 << 15

SEGMENT_SCHEMA = (
    "bucket int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, bits int, symbols binary, frequencies binary, "
    "block_first array<long>, block_ids array<int>, block_offset array<long>, block_bytes array<int>, block_crc array<long>, payload binary"
)


class Tokenizer:
    """The tokenizers library, with the ids of space-separated pieces kept.

    A split at a space behind a character that is no white space never cuts a
    match of the byte-level pattern, so the pieces' ids in a row are the text's.
    A piece of letters is one word for the library's model, and marks behind it
    are words of their own; other pieces go through the whole library.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize, self.letters = self.library.model.tokenize, {b: c for b, c in byte_letters().items() if chr(b) != c}
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        split = str(self.library.pre_tokenizer)
        self.pieces = self.library.normalizer is None and split.startswith("ByteLevel(") and "add_prefix_space=False" in split
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.space = byte_letters()[32]
        self.kept, self.words, self.heads = _Kept(self.piece, most), _Kept(self.word, most // 8), _Kept(self.head, most // 8)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        """One word that the split gives."""
        seen = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(seen)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a piece with the space before it."""
        if piece.isalpha():
            if piece.isascii():
                return array(self.code, [t.id for t in self.tokenize(self.space + piece)]).tobytes()
            return self.word(" " + piece)
        if m := WORD_AND_MARKS.fullmatch(piece):
            word, marks, after, more = m.groups()
            if word.isalpha() and after is None:
                return self.kept[word] + self.words[marks]
            if word.isalpha() and after.isalpha():
                return self.kept[word] + self.words[marks] + self.words["\n"] + self.words[after] + (self.words[more] if more else b"")
        return self.whole(" " + piece)

    def head(self, piece: str) -> bytes:
        """The ids of a piece at the beginning of a text."""
        return self.word(piece) if piece.isalpha() else self.whole(piece)

    def text(self, text: str, runs: bool) -> bytes:
        """Ids of a text; runs: whether ASCII white space stands before a space in it."""
        if runs or not self.pieces or not text.isascii() and any(r in text for r in OTHER_RUNS) or self.special.search(text):
            return self.whole(text)
        head, *tails = text.split(" ")
        return (self.heads[head] if head else b"") + b"".join(map(self.kept.__getitem__, tails))

    def texts(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a column."""
        data, offsets = text_buffer(column)
        white = (data == 32) | (data >= 9) & (data <= 13)
        hit = np.flatnonzero(white[:-1] & (data[1:] == 32)) + 1  # one across two texts counts for the second, which only costs time
        runs = np.diff(np.searchsorted(hit, offsets)) > 0
        return [self.text(t or "", r) for t, r in zip(column.to_pylist(), runs.tolist(), strict=True)]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, their frequencies (1 at least, a power of two in sum) and that power's exponent."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    bits = int(np.clip(np.ceil(np.log2(max(len(symbols), 1))) + 3, 12, 22))
    total, counts = 1 << bits, counts[symbols]
    table = np.maximum(1, counts * total // counts.sum())
    over = int(table.sum()) - total
    if over <= 0:
        table[np.argmax(table)] -= over
    while over > 0:  # rare symbols got more than their share: the others give in proportion
        give = np.minimum(table - 1, np.ceil((table - 1) * (over / (table - 1).sum())).astype(np.int64))
        cut = np.minimum(np.cumsum(give), over)
        table -= np.diff(cut, prepend=0)
        over = int(table.sum()) - total
    return symbols, table, bits


def encode_block(ranks: np.ndarray, table: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """One block of ranks (places of the symbols in the table)."""
    lanes = min(LANES, len(ranks))
    state = np.full(lanes, LOW)
    shift, words = np.uint64(bits), []
    freq, start = table.astype(np.uint64)[ranks], starts.astype(np.uint64)[ranks]
    for at in range((len(ranks) - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[at : at + lanes], start[at : at + lanes]
        x = state[: len(f)]
        full = x >= ((LOW >> shift) << np.uint64(32)) * f
        if full.any():
            words.append(x[full].astype("<u4"))
            x[full] >>= np.uint64(32)
        q = x // f
        x[:] = (q << shift) + (x - q * f) + c
    return b"".join([state.astype("<u8").tobytes(), *(w.tobytes() for w in reversed(words))])


def decode_block(payload: bytes, n: int, table: np.ndarray, starts: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """The n ranks of a block; slots gives the rank of each slot of the range."""
    lanes = min(LANES, n)
    state = np.frombuffer(payload, "<u8", lanes).copy()
    words, used = np.frombuffer(payload, "<u4", offset=8 * lanes), 0
    out = np.empty(n, slots.dtype)
    table, starts = table.astype(np.uint64), starts.astype(np.uint64)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        low = x & mask
        rank = slots[low]
        out[at : at + lanes] = rank
        x[:] = table[rank] * (x >> shift) + low - starts[rank]
        few = np.flatnonzero(x < LOW)
        if len(few):
            x[few] = x[few] << np.uint64(32) | words[used : used + len(few)]
            used += len(few)
    if used != len(words) or (state != LOW).any():
        raise ValueError("a block's payload does not end where its ids end")
    return out


def encode_segment(ids: np.ndarray) -> dict:
    symbols, table, bits = frequency_table(ids)
    starts = np.cumsum(table) - table
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    blocks = [(at, ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    payloads = [encode_block(place[part], table, starts, bits) for _, part in blocks]
    return {
        "n_ids": len(ids), "bits": bits, "symbols": symbols.astype("<u4").tobytes(), "frequencies": table.astype("<u4").tobytes(),
        "block_first": [at for at, _ in blocks], "block_ids": [len(part) for _, part in blocks],
        "block_offset": list(itertools.accumulate((len(p) for p in payloads), initial=0))[:-1], "block_bytes": [len(p) for p in payloads],
        "block_crc": [zlib.crc32(p) for p in payloads], "payload": b"".join(payloads),
    }


def decode_segment(row: dict, blocks: range | None = None) -> np.ndarray:
    """The ids of all blocks of a segment, or of some; a damaged block raises ValueError."""
    symbols, table, bits = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["frequencies"], "<u4").astype(np.int64), row["bits"]
    starts = np.cumsum(table) - table
    slots = np.repeat(np.arange(len(table), dtype=np.int32), table)
    out = []
    for k in blocks if blocks is not None else range(len(row["block_first"])):
        part = row["payload"][row["block_offset"][k] : row["block_offset"][k] + row["block_bytes"][k]]
        if zlib.crc32(part) != row["block_crc"][k]:
            raise ValueError(f"block {k} of segment {row['segment']} of bucket {row['bucket']} is damaged")
        out.append(symbols[decode_block(part, row["block_ids"][k], table, starts, slots, bits)])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, ids) in order -> segments; a segment ends where a bucket ends or when it is full."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[k]) for n, k in (f.split(" ") for f in SEGMENT_SCHEMA.split(", "))])
    bucket, segment, first, docs, parts, size = None, 0, 0, [], [], 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), "<u4")
        row = {"bucket": bucket, "segment": segment, "first_id": first, "doc_ids": docs, "doc_lengths": [len(p) // 4 for p in parts]} | encode_segment(ids)
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for b, doc, narrow, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs and (b != bucket or size >= SEGMENT):
                yield flush()
                segment, first, docs, parts, size = segment + 1, first + size, [], [], 0
            if b != bucket:
                bucket, segment, first = b, 0, 0
            docs.append(doc)
            parts.append(narrow if wide else np.frombuffer(narrow, "<u2").astype("<u4").tobytes())
            size += len(parts[-1]) // 4
    if docs:
        yield flush()


class Cuts:
    """Where rows in the order of (doc_id, hash) are cut into buckets: between doc_ids, and within null and doc_ids that fill buckets."""

    def __init__(self, points: list[int], null_buckets: int):
        self.nulls = max(null_buckets, 0)
        self.values, self.shares = np.unique(np.array(points, np.int64), return_counts=True)
        self.first = np.cumsum(self.shares) - self.shares + self.nulls  # buckets before each value's own

    @property
    def buckets(self) -> int:
        return int(self.nulls + self.shares.sum()) + 1

    def place(self, docs: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Buckets of rows; hashes are unsigned."""
        share = lambda n: ((hashes >> np.uint64(32)) * n.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        if not len(self.values):
            return np.where(null, share(np.full(len(docs), self.nulls)), self.nulls)
        k = np.searchsorted(self.values, docs, side="right") - 1  # the value at or before
        at = np.maximum(k, 0)
        own = docs == self.values[at]
        inside = np.where(own, share(self.shares[at]), self.shares[at] - 1)
        known = np.where(k >= 0, self.first[at] + 1 + inside, self.nulls)
        return np.where(null, share(np.full(len(docs), self.nulls)), known)


def tokenize(docs: DataFrame, path: str = TOKENIZER, end_id: int | None = END_ID, cuts: Cuts | None = None) -> DataFrame:
    """doc_id, place (a hash of the ids), ids (binary), wide (ids have 4 bytes instead of 2) and bucket, with the end id behind each document."""
    ship(docs.sparkSession)
    names = ["doc_id", "place", "ids", "wide", "bucket"]
    cuts = cuts or Cuts([], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = b"" if end_id is None else np.array([end_id], tok.dtype).tobytes()
        for whole in batches:
            for batch in slices(whole):
                ids = [x + end for x in tok.texts(batch.column(1))]
                hashes = np.array([xxhash.xxh64_intdigest(x) for x in ids], np.uint64)
                bucket = cuts.place(batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False), hashes)
                place = (hashes ^ np.uint64(1 << 63)).view(np.int64)  # in the same order as a signed number
                cols = [pa.array(place), pa.array(ids, pa.binary()), pa.array([tok.dtype.itemsize == 4] * len(ids)), pa.array(bucket.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, place long, ids binary, wide boolean, bucket int")


def bounds(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, least: int = LEAST_BUCKETS, most: int = MOST_BUCKETS) -> Cuts:
    """Cuts into buckets of about equal rows, `most` of them and one for null at the most; only the column doc_id is read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, known = own.agg(F.count("*"), F.count("doc_id")).first()
    buckets = min(most, max(least, -(-n // rows_per_bucket)))
    nulls = -(-(n - known) * buckets // max(n, 1))
    rest = max(buckets - nulls, 1)
    points = own.select(F.percentile_approx("doc_id", [k / rest for k in range(1, rest)], 8 * rest)).first()[0] if rest > 1 and known else None
    return Cuts(points or [], nulls)


def write(docs: DataFrame, path: str, tokenizer_path: str = TOKENIZER, end_id: int | None = END_ID, **cut_how) -> None:
    """Writes documents(doc_id, text) as token files to path; cut_how as in bounds."""
    cuts = bounds(docs, **cut_how)
    rows = tokenize(docs, tokenizer_path, end_id, cuts).repartitionById(cuts.buckets, F.col("bucket"))
    rows = rows.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "place", "ids")
    rows.select("bucket", "doc_id", "ids", "wide").mapInArrow(_segments, SEGMENT_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit) of each document in token files."""
    ship(spark)
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = decode_segment(row).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_lengths"])
                begins = ends - np.array(row["doc_lengths"])
                views = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [[row["bucket"]] * len(views), row["doc_ids"], (begins + row["first_id"]).tolist(), row["doc_lengths"], [zlib.crc32(v) for v in views]]
                arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(views, pa.binary())] * ids, names=["bucket", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    docs = files.mapInArrow(run, "bucket int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # one row for each bucket, of which there are MOST_BUCKETS and one for null at the most
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = docs.join(starts, "bucket").withColumn("start", F.col("inside") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def round_trip(docs: DataFrame, path: str | None = None, tokenizer_path: str = TOKENIZER, ids: bool = False, **cut_how) -> DataFrame:
    """Writes docs to token files (a fresh shared folder unless path is given) and reads them back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write(docs, path, tokenizer_path, **cut_how)
    return read(spark, path, ids)
