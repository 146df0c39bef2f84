"""Substring deduplication by fixed-block anchors.

A word is removed if a window of WINDOW words that covers it also starts in a
document with a smaller doc_id. Steps:

1. Anchors. Each text's non-overlapping blocks of WINDOW / 2 words are the index,
   which keeps the smallest and largest doc_id of each block; they are combined in
   each batch and again for each bucket of block hashes, so a block that a third of
   all documents have is one entry.
2. Probes. Every rolling window of that length probes the index. A repeat of
   WINDOW words holds a whole block of either text, so both texts have a hit
   inside each repeat. A row carries the probes of a batch of texts that fall into
   one bucket, packed (hashes without the bits the bucket tells, and texts as
   runs: about 5 bytes a word), and passes by the bucket's index as a stream.
3. Extension. Texts with hits in blocks that other documents have are read once
   more; their windows around hits are the candidates.
4. Owners. Candidates meet by hash; the smallest doc_id of a hash owns it, and all
   other documents drop the words it covers. Adjacent windows add up to maximal
   repeats. Nothing is paired: a passage that a third of all documents share
   costs each of them its own windows and no more.

Buckets with more than HOT probes or candidates are dealt to several tasks, each
with the bucket's index (of probes) or its combined owners (of candidates).

Windows are told apart by 96 bits of two independent hashes beside their bucket:
a false match of two of 10^12 windows has a chance of about 10^-5.

Defined cases: null texts count as empty; texts under WINDOW words lose nothing;
a null doc_id is larger than all others and owns nothing against another null;
rows with equal doc_id never remove words from each other, and repeated rows are
treated alike; an empty table gives no rows; other columns are carried along.
Rows without a doc_id are told apart by their texts; those that share a doc_id
are taken to be few.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.llm.textcore import covered, lean, lean_group, slices, text_buffer, window_hashes, window_rows, word_hashes, word_spans
from reelspark.session import cut, shared_path, ship

WINDOW = 50
LEAST_BUCKETS, BYTES_PER_BUCKET, BATCH_BYTES = 64, 14_000_000, 4 << 20
HOT, BROADCAST_BYTES = 12_000_000, 16 << 20
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # LAST: the place of a null doc_id
#: kind 0 is an index (ids: the smallest and largest doc_id of each hash), kind 1 has rows' hashes (ids: locators, runs and whether doc_id is null).
PACKED = ["bucket", "kind", "n", "hashes", "more", "ids"]
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
PACKED_SQL = "bucket int, kind int, n long, hashes binary, more binary, ids binary"
FOUND_SQL = "at long, void boolean, bucket int, hashes binary"


def buckets_for(docs: DataFrame) -> int:
    """A power of two, in proportion to the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (int(total) // BYTES_PER_BUCKET).bit_length())


class Ids:
    """Locators of rows (doc_id, or a hash of the text where that is null) and whether they are null."""

    def __init__(self, at: np.ndarray, void: np.ndarray):
        self.at, self.void = at, void

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Ids:
        return cls(batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False))

    def __getitem__(self, k) -> Ids:
        return Ids(self.at[k], self.void[k])

    @property
    def order(self) -> np.ndarray:
        return np.where(self.void, LAST, self.at)

    def pack(self) -> bytes:
        """Runs of equal rows, as differences."""
        first = np.flatnonzero(np.append(True, (self.at[1:] != self.at[:-1]) | (self.void[1:] != self.void[:-1])))
        runs = np.diff(np.append(first, len(self.at))).astype("<u4")
        deltas = np.diff(self.at[first].view(np.uint64), prepend=np.uint64(0))
        return zlib.compress(deltas.tobytes() + runs.tobytes() + self.void[first].astype(np.uint8).tobytes(), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Ids:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
        n = len(raw) // 13
        at, runs = np.cumsum(raw[: 8 * n].view(np.uint64), dtype=np.uint64).view(np.int64), raw[8 * n : 12 * n].view("<u4")
        return cls(np.repeat(at, runs), np.repeat(raw[12 * n :].astype(bool), runs))


def _least_and_most(hashes: np.ndarray, more: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each hash once, in order, with the smallest and largest of its values."""
    order = np.lexsort((more, hashes))
    hashes, more = hashes[order], more[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    if len(first):
        least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
    return hashes[first], more[first], least, most


def _by_bucket(place: np.ndarray) -> Iterator[tuple[int, slice]]:
    present = np.unique(place)
    ends = np.append(np.searchsorted(place, present), len(place)).tolist()
    for k, b in enumerate(present.tolist()):
        yield b, slice(ends[k], ends[k + 1])


def _index_rows(hashes: np.ndarray, more: np.ndarray, least: np.ndarray, most: np.ndarray, place: np.ndarray, n: np.ndarray | None = None) -> Iterator[tuple]:
    """Packed rows of kind 0; hashes come in order, and so do their buckets."""
    for b, s in _by_bucket(place):
        low = least[s]
        ids = zlib.compress(low.tobytes() + (most[s].view(np.uint64) - low.view(np.uint64)).tobytes(), 1)
        yield b, 0, len(low) if n is None else int(n[s].sum()), hashes[s].tobytes(), more[s].tobytes(), ids


def _unpacked_index(rows: list[dict], narrow: bool) -> tuple[np.ndarray, ...]:
    """Hashes, more, least and most of rows of kind 0, combined."""
    parts = []
    for row in rows:
        raw = np.frombuffer(zlib.decompress(row["ids"]), np.int64)
        least = raw[: len(raw) // 2]
        parts.append((np.frombuffer(row["hashes"], "<u4" if narrow else "<u8"), np.frombuffer(row["more"], "<u4"), least, (least.view(np.uint64) + raw[len(raw) // 2 :].view(np.uint64)).view(np.int64)))
    hashes, more, least, most = (np.concatenate(c) for c in zip(*parts, strict=True))
    return _least_and_most(hashes, more if len(more) else np.zeros(len(hashes), np.uint32), least, most)


def _rows(hashes: np.ndarray, more: np.ndarray | None, ids: Ids, bits: int, narrow: bool) -> Iterator[tuple]:
    """Packed rows of kind 1; equal ids lie together. narrow keeps the 32 bits below the bucket's."""
    place = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(place, kind="stable")
    hashes = _narrow(hashes[order], bits) if narrow else hashes[order].astype("<u8")
    more = np.zeros(0, "<u4") if more is None else more[order].astype("<u4")
    ids, place = ids[order], place[order]
    del order
    for b, s in _by_bucket(place):
        yield b, 1, s.stop - s.start, hashes[s].tobytes(), more[s].tobytes(), ids[s].pack()


def _narrow(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(32 - bits)).astype("<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], names=PACKED)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one after the other; their binaries are views of the batch."""
    for k in range(batch.num_rows):
        yield {name: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for name, v in zip(batch.schema.names, (c[k] for c in batch.columns), strict=True)}


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, starts, ends, the first word of each text, and the words' hashes."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _sliced(part):
    """A lean kernel that takes its batches through part in slices; what part holds of one is freed before the next."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                yield from part(batch)

    return run


def _anchors(bits: int, window: int):
    """Rows (at, void, text) -> the index of each batch's blocks."""
    half = window // 2

    @_sliced
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, hashes = _words(batch.column(2))[3:]
        at, row = window_rows(first, half)
        keep = ((at - first[row]) % half == 0) & (np.diff(first) >= window)[row]
        at, row = at[keep], row[keep]
        if len(at):
            doc = Ids.of(batch).order[row]
            h, _, least, most = _least_and_most(window_hashes(hashes, half)[at], np.zeros(len(at), np.uint8), doc, doc)
            yield _batch(list(_index_rows(_narrow(h, bits), np.zeros(0, "<u4"), least, most, (h >> np.uint64(64 - bits)).astype(np.int64))))

    return run


def _merge(narrow: bool):
    """One index row for each bucket; n adds up the batches' entries."""

    @lean_group
    def merge(key, table):
        rows = table.to_pylist()
        hashes, more, least, most = _unpacked_index(rows, narrow)
        bucket = np.full(len(hashes), key[0].as_py())
        packed = _batch(list(_index_rows(hashes, more if not narrow else more[:0], least, most, bucket)))
        return pa.Table.from_batches([packed.set_column(2, "n", pa.array([sum(r["n"] for r in rows)], pa.int64()))])

    return merge


def _probe(bits: int, window: int):
    """Rows (at, void, text) -> all rolling windows of half the length."""
    half = window // 2

    @_sliced
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, hashes = _words(batch.column(2))[3:]
        at, row = window_rows(first, half)
        keep = (np.diff(first) >= window)[row]
        at, row = at[keep], row[keep]
        if len(at):
            packed = _rows(window_hashes(hashes, half)[at], None, Ids.of(batch)[row], bits, True)
            del hashes, at, row, keep  # packing takes as much again
            yield _batch(list(packed))

    return run


def _pass_by(narrow: bool):
    """Packed rows, sorted by bucket and kind -> (at, void, bucket, hashes) of the rows' hashes that the index says are found.

    narrow: those that some other document has; else those that a smaller doc_id has.
    """
    kind = "<u4" if narrow else "<u8"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = None, None
        for batch in batches:
            out = []
            for row in _each(batch):
                if row["kind"] == 0:
                    bucket, index = row["bucket"], _unpacked_index([row], narrow)
                    continue
                if row["bucket"] != bucket:
                    continue  # no block in this bucket
                known, known_more, least, most = index
                hashes, ids = np.frombuffer(row["hashes"], kind), Ids.unpack(row["ids"])
                more = np.frombuffer(row["more"], "<u4") if not narrow else np.zeros(len(hashes), np.uint32)
                at, far = np.searchsorted(known, hashes), len(known) - 1
                while (other := (at < far) & (known[np.minimum(at, far)] == hashes) & (known_more[np.minimum(at, far)] != more)).any():
                    at += other  # equal in the first hash only
                at = np.minimum(at, far)
                hit = (known[at] == hashes) & (known_more[at] == more)
                order = ids.order
                hit &= (least[at] != order) | (most[at] != order) if narrow else least[at] < order
                out.append(_by_row(ids[hit], hashes[hit], row["bucket"]))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


def _by_row(ids: Ids, hashes: np.ndarray, bucket: int) -> pa.Table:
    """A row for each run of equal ids, with its hashes as one binary."""
    n = len(hashes)
    at = np.flatnonzero(np.append(True, (ids.at[1:] != ids.at[:-1]) | (ids.void[1:] != ids.void[:-1]))) if n else np.zeros(0, np.int64)
    parts = [p.tobytes() for p in np.split(hashes, at[1:])] if n else []
    return pa.table({"at": pa.array(ids.at[at], pa.int64()), "void": pa.array(ids.void[at]), "bucket": pa.array([bucket] * len(at), pa.int32()), "hashes": pa.array(parts, pa.binary())})


@lean_group
def _own(key, table):
    """Candidates of a bucket whose hash a smaller doc_id has, for a bucket that one task holds."""
    all_ids, hashes, more = zip(*((Ids.unpack(r["ids"]), np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["more"], "<u4")) for part in table.to_batches() for r in _each(part)), strict=True)
    ids = Ids(np.concatenate([x.at for x in all_ids]), np.concatenate([x.void for x in all_ids]))
    del all_ids
    hashes, more = np.concatenate(hashes), np.concatenate(more)
    order = np.lexsort((more, hashes))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(hashes[order]) != 0) | (np.diff(more[order]) != 0)
    del more
    first = np.flatnonzero(first)
    doc = ids.order[order]
    late = np.sort(order[doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))])
    del order, doc, first
    late = late[np.lexsort((ids.at[late], ids.void[late]))]
    return _by_row(ids[late], hashes[late], key[0].as_py())


@lean
def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed candidates -> the smallest doc_id of each hash, combined in each batch."""
    for batch in batches:
        by: dict[int, list[dict]] = {}
        for row in batch.to_pylist():
            by.setdefault(row["bucket"], []).append(row)
        for bucket, rows in by.items():
            doc = np.concatenate([Ids.unpack(r["ids"]).order for r in rows])
            hashes, more = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows]), np.concatenate([np.frombuffer(r["more"], "<u4") for r in rows])
            found = _least_and_most(hashes, more, doc, doc)
            yield _batch(list(_index_rows(*found, np.full(len(found[0]), bucket))))


def _met(index: DataFrame, rows: DataFrame, hot: DataFrame, narrow: bool) -> DataFrame:
    """Rows passed by their bucket's index; hot(bucket, tasks) tells which buckets go to several tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        index, rows = (x.withColumn("task", F.lit(0).cast("long")) for x in (index, rows))
    else:
        index = index.join(hot, "bucket", "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1)) - 1)))
        if hot.count() * 32 <= BROADCAST_BYTES:
            hot = F.broadcast(hot)
        rows = rows.join(hot, "bucket", "left").withColumn("task", F.pmod(F.xxhash64("ids"), F.coalesce("tasks", F.lit(1).cast("long"))))
    both = index.select("task", *PACKED).union(rows.select("task", *PACKED))
    both = both.repartition(n, "bucket", "task").sortWithinPartitions("bucket", "task", "kind").select(*PACKED)
    return both.mapInArrow(_pass_by(narrow), FOUND_SQL)


def _hits(column, k: int, bits: int | None) -> np.ndarray:
    """The hashes listed for row k; with bits, those of probes with their bucket in front."""
    lists = column[k].as_py() or []
    if bits is None:
        return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x["hashes"], "<u8") for x in lists)])
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x["hashes"], "<u4").astype(np.uint64) | np.uint64(x["bucket"]) << np.uint64(32) for x in lists)])


def _finished(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, text: str | None, digest: bool) -> tuple:
    """n_words, n_removed, and the kept words' digest or the text without the removed words.

    A removed word goes with the white space behind it, so what is kept keeps its own.
    """
    n = len(starts)
    if digest:
        left = np.flatnonzero(~gone)
        raw = data.tobytes()
        return n, n - len(left), hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])).hexdigest(), None
    if not gone.any():
        return n, 0, None, text
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    raw, at, out = data.tobytes(), 0, []
    for a, b in edges.reshape(-1, 2).tolist():
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < n else len(raw)
    out.append(raw[at:])
    return n, int(gone.sum()), None, b"".join(out).decode("utf-8")


def _extend(bits: int, window: int, digest: bool):
    """Rows (at, void, text, doc_id, rest, hits) -> finished rows, rows to finish, and packed candidates (states 0, 1 and 2)."""
    half = window // 2

    @_sliced
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, rest, hits = batch.column(2), batch.column(4), batch.column(5)
        data, starts, ends, first, hashes = _words(texts)
        ids, offsets = Ids.of(batch), text_buffer(texts)[1]
        rows, take_all, row_of = [], [], []
        short = window_hashes(hashes, half) >> np.uint64(32 - bits)
        for k in range(batch.num_rows):
            a, b = int(first[k]), int(first[k + 1])
            found = hits[k].is_valid and b - a >= window
            if found:
                hit = np.isin(short[a : b - half + 1], _hits(hits, k, bits))
                near = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=near[1:])
                n = b - a - window + 1
                take = np.flatnonzero(near[window - half + 1 : window - half + 1 + n] > near[:n])
                take_all.append(take + a)
                row_of.append(np.full(len(take), k))
            if found and len(take):
                rows.append((1, b - a, None, None, texts[k].as_py()))
            else:
                base = int(offsets[k])
                text = texts[k].as_py() if not digest else None
                rows.append((0, *_finished(data[base : offsets[k + 1]], starts[a:b] - base, ends[a:b] - base, np.zeros(b - a, bool), text, digest)))
        state, n_words, n_removed, sha, text = zip(*rows, strict=True)
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(state, pa.int32()), *batch.columns[:2], batch.column(3), rest, pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), *(pa.nulls(m, k) for k in KINDS)],
            names=MIXED,
        )
        take = np.concatenate(take_all) if take_all else np.zeros(0, np.int64)
        if len(take):
            del short, rows, text, take_all
            second = window_hashes(word_hashes(data, starts, ends, 1), window)[take].astype(np.uint32)
            packed = _rows(window_hashes(hashes, window)[take], second, ids[np.concatenate(row_of)], bits, False)
            del starts, ends, hashes, second, take, row_of
            packed = _batch(list(packed))
            m = packed.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([2] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, rest.type), pa.nulls(m, pa.string()), *[pa.nulls(m, pa.int64())] * 2, pa.nulls(m, pa.string()), *packed.columns], names=MIXED
            )

    return run


MIXED = ["state", "at", "void", "doc_id", "rest", "text", "n_words", "n_removed", "kept_sha256", *PACKED]


def _finish(window: int, digest: bool):
    """Rows (text, doc_id, rest, hits) -> finished rows."""

    @_sliced
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, rows = batch.column(0), []
        data, starts, ends, first, hashes = _words(texts)
        offsets, full = text_buffer(texts)[1], window_hashes(hashes, window)
        for k in range(batch.num_rows):
            a, b, base = int(first[k]), int(first[k + 1]), int(offsets[k])
            gone = covered(b - a, np.flatnonzero(np.isin(full[a : b - window + 1], _hits(batch.column(3), k, None))), window)
            rows.append(_finished(data[base : offsets[k + 1]], starts[a:b] - base, ends[a:b] - base, gone, texts[k].as_py(), digest))
        n_words, n_removed, sha, text = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "rest", "text", "n_words", "n_removed", "kept_sha256"])

    return run


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the hits found for them, as a list of (bucket, hashes); equal hits of repeated rows count once."""
    hits = found.groupBy("at", "void").agg(F.collect_set(F.struct("bucket", "hashes")).alias("hits"))
    return rows.join(hits, ["at", "void"], "left")


def _hot(sizes: DataFrame, hot: int) -> DataFrame:
    """bucket, tasks of the buckets with more than hot rows n."""
    return cut(sizes.where(F.col("n") > hot).select("bucket", F.ceil(F.col("n") / hot).cast("long").alias("tasks")))


def dedupe(docs: DataFrame, window: int = WINDOW, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, rest (a struct of docs' other columns), text (without the removed words; null with digest), n_words, n_removed, kept_sha256 (only with digest)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("boolean").alias("none")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(*others).alias("rest"))
    rows = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("at"), F.col("doc_id").isNull().alias("void"), "text", "doc_id", "rest")
    bits = buckets_for(rows).bit_length() - 1
    source = rows.select("at", "void", "text")
    # an anchor stands for half a window of probes
    index = cut(source.mapInArrow(_anchors(bits, window), PACKED_SQL).groupBy("bucket").applyInArrow(_merge(True), PACKED_SQL))
    hits = _met(index, source.mapInArrow(_probe(bits, window), PACKED_SQL), _hot(index, max(hot // (window // 2), 1)), True)
    schema = T.StructType(
        [T.StructField("state", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("void", T.BooleanType()), T.StructField("doc_id", T.LongType())]
        + [T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(n, T.BinaryType()) for n in ("hashes", "more", "ids")]
    )
    _joined(rows, hits).select("at", "void", "text", "doc_id", "rest", "hits").mapInArrow(_extend(bits, window, digest), schema).write.parquet(path := shared_path(spark, "repeats"))
    mixed = spark.read.schema(schema).parquet(path)
    candidates = mixed.where("state = 2").select(*PACKED)
    large = _hot(candidates.groupBy("bucket").agg(F.sum("n").alias("n")), hot)
    if large.isEmpty():
        late = candidates.groupBy("bucket").applyInArrow(_own, FOUND_SQL)
    else:
        some = candidates.join(large.select("bucket"), "bucket", "left_semi").select(*PACKED)
        owners = some.mapInArrow(_owners, PACKED_SQL).groupBy("bucket").applyInArrow(_merge(False), PACKED_SQL)
        late = candidates.join(large, "bucket", "left_anti").select(*PACKED).groupBy("bucket").applyInArrow(_own, FOUND_SQL).union(_met(owners, some, large, False))
    columns = ["doc_id", "rest", "text", "n_words", "n_removed", "kept_sha256"]
    open_ = _joined(mixed.where("state = 1").select("at", "void", "text", "doc_id", "rest"), late).select("text", "doc_id", "rest", "hits")
    finished = open_.mapInArrow(_finish(window, digest), T.StructType([schema[c] for c in columns]))
    return mixed.where("state = 0").select(*columns).unionByName(finished)


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removed words gone from their texts; columns and rows stay."""
    found = dedupe(docs, window)
    kinds = dict(docs.dtypes)
    return found.select(*(F.col(c).cast(kinds[c]).alias(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))
