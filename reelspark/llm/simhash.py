"""SimHash near-duplicates: pivot distance tables over dealt fingerprints.

A fingerprint bit is set if it is set in more than half of the hashes of a text's
word shingles. Fingerprints link at max_distance or fewer differing bits.

Distance tables alone would have to compare all pairs, which grows with the
square of the input. So distinct fingerprints are first dealt by keys that linked
ones share, and the tables work within a key:

* `groups` (64 bits): the bits are cut into max_distance + m blocks; linked
  fingerprints are equal in m blocks at least, and a key is the bits of m blocks.
  No link is lost at any m; more fingerprints take a larger m, so that keys hold
  few of them (`block_plan`).
* `similar` (512 bits): links are a Jaccard similarity of the sets of shingles,
  compared in full; fingerprints only find candidates. A key is made of ROWS least
  hashes, and there are BANDS of them at every size of the input: two sets at
  similarity s share no key with probability (1 - s ** ROWS) ** BANDS, which is
  5 in 100 million at 0.8 and less above.

Within a key, fingerprints become references one after the other until PIVOTS of
them are taken or each fingerprint links to one. The Hamming distances to all
references are computed once for each fingerprint. By the triangle inequality a
pair whose distances to some reference differ by more than the limit cannot link
and is discarded: fingerprints are sorted by their distance to the first
reference, so a scan stops at the limit, and the table discards among the rest.
Survivors are verified by their own distance. What is linked already is not
compared again, so a large group of copies costs a few passes. Keys with more
than HOT_KEY fingerprints are cut into parts, and each pair of parts is a task of
its own. A task passes on a spanning forest of its links, never all pairs, and
the components of all forests are found by star operations.

Defined cases: a null text counts as empty; no words give fingerprint zero,
linked like any other; fewer words than a shingle give one shingle of all words;
component ids are the smallest doc_id, null where all doc_ids are null; repeated
rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.components import stars
from reelspark.llm.textcore import lean, mix, slices, text_buffer, word_spans
from reelspark.session import cut, ship

SEED, PIVOTS, HOT_KEY = 42, 24, 1 << 15
#: Keys of a set of shingles, how many least hashes make one, and how many hashes of shingles a task compares sets in.
BANDS, ROWS, HOT_SETS = 32, 4, 2_000_000
#: Fingerprints that a key should hold at most on average, and bytes of a list that goes to every task.
KEY_LOAD, BROADCAST_BYTES = 256, 16 << 20
#: A byte's bits, a byte each, so that up to 255 rows can be summed in one integer.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle in order, and the number of shingles of each text."""
    starts, ends, first = word_spans(data, offsets)
    lengths = ends - starts
    space = (data == 32) | ((data >= 9) & (data <= 13))
    gone = space.copy()  # all white space but the first behind a word
    gone[1:] &= space[:-1]
    text = np.where(space, np.uint8(32), _LOWER[data])[~gone].tobytes()
    begin = starts - np.searchsorted(np.flatnonzero(gone), starts)
    del space, gone
    words = np.diff(first)
    per = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    head = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    tail = head + np.repeat(np.minimum(words, width), per) - 1
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(head), np.uint64)
    for at in range(0, len(head), 1 << 17):
        a, b = begin[head[at : at + (1 << 17)]].tolist(), tail[at : at + (1 << 17)]
        b = (begin[b] + lengths[b]).tolist()
        out[at : at + len(a)] = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    return out, per


def fingerprints_of(hashes: np.ndarray, per: np.ndarray, words: int = 1) -> np.ndarray:
    """(texts, words) unsigned 64-bit; further words come from hashes mixed anew."""
    pieces = -(-per // 255)
    text_of = np.repeat(np.arange(len(per)), pieces)
    begin = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = begin * 255 + np.repeat(np.cumsum(per) - per, pieces)
    out = np.zeros((len(per), words), np.uint64)
    for word in range(words):
        counts = np.zeros((len(per), 64), np.int64)
        for at in range(0, len(begin), 1024):
            to = begin[at + 1024] if at + 1024 < len(begin) else len(hashes)
            h = hashes[begin[at] : to]
            if word:
                h = mix(h + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64)))
            sums = np.add.reduceat(SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8).T], begin[at : at + 1024] - begin[at], axis=1)
            lanes = np.ascontiguousarray(sums.T).astype("<u8").view(np.uint8).reshape(-1, 64)
            np.add.at(counts, text_of[at : at + 1024], lanes)
        set_ = counts * 2 > per[:, None]
        out[:, word] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, id (the fingerprint) and fp (the same in binary, little-endian)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fps = fingerprints_of(*shingle_hashes(*text_buffer(batch.column(1)), shingle))
                raw = [row.tobytes() for row in fps.astype("<u8")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0].view(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, id long, fp binary")


def block_plan(max_distance: int, n: int = 0) -> list[np.ndarray]:
    """Bit positions of each key for n fingerprints of 64 bits: all choices of m of max_distance + m blocks, m = 2 or the least for KEY_LOAD."""
    for m in range(2, 5):
        if n <= KEY_LOAD << 64 * m // (max_distance + m):
            break
    blocks = np.array_split(np.arange(64), max_distance + m)
    return [np.concatenate(some) for some in itertools.combinations(blocks, m)]


def _banded(distinct: DataFrame, plan: list[np.ndarray]) -> DataFrame:
    """key, id, fp: a row for each key of each fingerprint."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw, _ = text_buffer(batch.column(1))
                bits = np.unpackbits(raw.reshape(batch.num_rows, -1), axis=1, bitorder="little")
                keys = [bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) | k << 40 for k, p in enumerate(plan)]
                n = len(plan)
                take = pa.array(np.tile(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(take), batch.column(1).take(take)], names=["key", "id", "fp"])

    return distinct.select("id", "fp").mapInArrow(run, "key long, id long, fp binary")


class Forest:
    """Components among rows 0 to n - 1, by vectorised hooking."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root[:] = up


def _near(fps: np.ndarray, table: np.ndarray, rows: np.ndarray, max_distance: int, forest: Forest, others: np.ndarray) -> None:
    """Adds the links of rows with others (sorted by their distance to the first reference) that are not in one component yet."""
    first = table[others, 0]
    low, high = np.searchsorted(first, table[rows, 0] - max_distance), np.searchsorted(first, table[rows, 0] + max_distance, side="right")
    done = 0
    while done < len(rows):
        size = np.cumsum(high[done:] - low[done:])
        to = done + max(1, int(np.searchsorted(size, 1 << 18, side="right")))
        width = high[done:to] - low[done:to]
        a = np.repeat(rows[done:to], width)
        b = others[np.arange(len(a)) - np.repeat(np.cumsum(width) - width - low[done:to], width)]
        apart = forest.root[a] != forest.root[b]
        a, b = a[apart], b[apart]
        for column in table.T[1:]:
            near = np.abs(column[a] - column[b]) <= max_distance
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= max_distance
        forest.add(a[near], b[near])
        done = to


def key_links(fps: np.ndarray, part: np.ndarray, max_distance: int) -> np.ndarray:
    """The root row of each row's component by links among the rows of one key.

    part is 0 or 3 for all pairs, or tells which of two parts of a hot key a row
    comes from (1, 2): only pairs of different parts then need to be looked at.
    """
    n = len(fps)
    forest = Forest(n)
    both = part[0] in (0, 3)
    distance = lambda row: np.bitwise_count(fps ^ fps[row]).sum(1, dtype=np.int16)
    unlinked, columns = np.ones(n, bool), []
    while len(columns) < PIVOTS and (left := np.flatnonzero(unlinked)).size:
        row = left[0]
        columns.append(distance(row))
        near = np.flatnonzero(columns[-1] <= max_distance)  # also of the same part: a link is a link
        forest.add(near, np.full(len(near), row))
        unlinked[near] = False
    root = forest.root
    if both:
        largest = np.bincount(root, minlength=n).argmax()
        rows = np.flatnonzero(root != largest)
        sides = [(rows, np.arange(n))]
    else:
        sides = [(np.flatnonzero(part == 1), np.flatnonzero(part == 2))]
    table = np.stack(columns, axis=1)
    for rows, others in sides:
        if len(rows) and len(others):
            _near(fps, table, rows, max_distance, forest, others[np.argsort(table[others, 0], kind="stable")])
    return forest.root


def links(key: np.ndarray, part: np.ndarray, fps: np.ndarray, max_distance: int) -> np.ndarray:
    """Rows sorted by key -> the root row of each row's component by links within keys; part as in key_links."""
    n = len(key)
    forest = Forest(n)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    size = np.diff(ends, prepend=0)
    small = np.repeat(size <= PIVOTS, size) & (part % 3 == 0)  # all pairs of few rows, for all such keys at once
    left, rows, step = np.repeat(ends, size) - np.arange(n), np.flatnonzero(small), 0  # rows from here to the key's end
    while len(rows := rows[left[rows] > (step := step + 1)]):
        for at in range(0, len(rows), 1 << 18):
            a = rows[at : at + (1 << 18)]
            near = np.bitwise_count(fps[a] ^ fps[a + step]).sum(1, dtype=np.int64) <= max_distance
            forest.add(a[near], a[near] + step)
    for end, rows in zip(ends.tolist(), size.tolist(), strict=True):
        if rows > 1 and not small[end - 1]:
            forest.root[end - rows : end] = key_links(fps[end - rows : end], part[end - rows : end], max_distance) + end - rows
    return forest.root


def _linked(rows: DataFrame, words: int, max_distance: int) -> DataFrame:
    """Edges (a, b) of fingerprint ids from rows sorted by (key, sub); a key's rows may lie in several batches."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(last: bool):
            nonlocal kept, size
            if not kept:
                return
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            apart = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] >> 2 != cols[1][:-1] >> 2)
            change = np.flatnonzero(apart) + 1
            stop = len(cols[0]) if last else (change[-1] if len(change) else 0)
            kept, size = ([tuple(c[stop:] for c in cols)], len(cols[0]) - stop) if stop < len(cols[0]) else ([], 0)
            if stop:
                key, sub, ids, fps = (c[:stop] for c in cols)
                root = links(np.cumsum(np.append(True, apart[: stop - 1])), sub & 3, fps, max_distance)
                child = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], names=["a", "b"])

        limit = 1 << 16  # rows that are linked at a time, or one key's
        for batch in batches:
            raw, _ = text_buffer(batch.column(3))
            key, sub, ids = (batch.column(k).to_numpy() for k in range(3))
            kept.append((key, sub, ids, raw.view("<u8").reshape(-1, words)))
            size += len(key)
            if size >= limit:
                yield from flush(False)
                limit = max(1 << 16, 2 * size)
        yield from flush(True)

    return rows.mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, payload: str, hot_key: int) -> DataFrame:
    """key, sub, id and payload, sorted by key and task; each pair of parts of a hot key is a task (sub >> 2) of its own."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hot = rows.groupBy("key").count().where(F.col("count") > hot_key).select("key", F.ceil(F.col("count") / hot_key).cast("int").alias("parts"))
    hot = cut(hot)  # a row for each key of more than hot_key fingerprints; most often none
    if hot.isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
    else:
        rows = rows.join(hot, "key", "left")
        own = F.pmod(F.xxhash64("id"), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("own", own).withColumn("other", other)
        kind = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
        task = F.least("own", "other") * F.col("parts") + F.greatest("own", "other") + 1
        rows = rows.withColumn("sub", F.when(F.col("parts").isNull(), 0).otherwise(task * 4 + kind).cast("long")).drop("own", "other", "parts")
    return rows.select("key", "sub", "id", payload).repartition(n, "key", F.shiftright("sub", 2)).sortWithinPartitions("key", F.shiftright("sub", 2), "id")


def edges(distinct: DataFrame, plan: list[np.ndarray], max_distance: int, hot_key: int = HOT_KEY) -> DataFrame:
    """Links between distinct(id, fp of 64 bits), as forests of each key."""
    return _linked(_dealt(_banded(distinct, plan), "fp", hot_key), 1, max_distance)


def _components(each: DataFrame, distinct: DataFrame, star: DataFrame) -> DataFrame:
    """each with a root (id) of its component, and the component's smallest doc_id."""
    member = star.select(F.col("a").alias("id"), F.col("b").alias("root")).union(star.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    known = distinct.select("id", "least").join(member, "id", "left").withColumn("root", F.coalesce("root", "id"))
    n = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id")).repartition(n)  # dealt anew, so that a large component's rows can be split
    classes = cut(known.select("id", "root").join(least, "root").select("id", "root", "component_id"))
    return each.join(classes, "id").select(*each.columns, "root", "component_id")


def groups(docs: DataFrame, shingle: int = 4, max_distance: int = 4, hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, id (the fingerprint of 64 bits), fp, root (a fingerprint of its component), component_id for every document."""
    ship(docs.sparkSession)
    each = cut(fingerprints(docs, shingle))
    distinct = cut(each.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")))
    return _components(each, distinct, stars(edges(distinct, block_plan(max_distance, distinct.count()), max_distance, hot_key)))


def _sets(hashes: np.ndarray, per: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct hashes of each text, sorted, and their ids."""
    grams = [np.unique(h).astype("<u8").tobytes() for h in np.split(hashes, np.cumsum(per)[:-1])]
    return grams, np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64).view(np.int64)


def band_keys(hashes: np.ndarray, per: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands): keys of `rows` least hashes each; texts without shingles have the same keys."""
    some = np.flatnonzero(per)
    begin = (np.cumsum(per) - per)[some]
    rng = np.random.default_rng(SEED)
    keys = np.zeros((len(per), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(some), band, np.uint64)
        for salt, odd in rng.integers(0, 1 << 64, (rows, 2), dtype=np.uint64):
            if len(some):
                key = mix(key + np.minimum.reduceat((hashes ^ salt) * (odd | np.uint64(1)), begin))
        keys[some, band] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, content (a hash of the text), id (of the set of shingles), fp and keys of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                hashes, per = shingle_hashes(*text_buffer(batch.column(1)), shingle)
                fps = [row.tobytes() for row in fingerprints_of(hashes, per, words).astype("<u8")]
                keys = [row.tobytes() for row in band_keys(hashes, per).astype("<i8")]
                cols = [batch.column(0), batch.column(2), pa.array(_sets(hashes, per)[1]), pa.array(fps, pa.binary()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "content", "id", "fp", "keys"])

    return _source(docs).mapInArrow(run, "doc_id long, content long, id long, fp binary, keys binary")


def _content():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _content().alias("content"))


def _keyed(distinct: DataFrame) -> DataFrame:
    """key, id: a row for each key of each set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = text_buffer(batch.column(1))[0].view("<i8")
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), len(keys) // batch.num_rows))], names=["key", "id"])

    return distinct.select("id", "keys").mapInArrow(run, "key long, id long")


def _listed(table: DataFrame, row_bytes: int) -> DataFrame:
    """A checkpointed table, marked to go to every task if its counted rows allow that."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def gram_sets(docs: DataFrame, member: DataFrame, shingle: int) -> DataFrame:
    """key, id and grams (the sorted hashes) for each row of member(key, id, at_doc, at_content); the two last tell a row that has the set."""
    rows = _source(docs)
    rows = rows.join(_listed(member, 40), rows.doc_id.eqNullSafe(member.at_doc) & (rows.content == member.at_content)).select("key", "id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                grams, ids = _sets(*shingle_hashes(*text_buffer(batch.column(2)), shingle))
                own = ids == batch.column(1).to_numpy()  # False: another text with the same hash
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], names=["key", "id", "grams"])
                yield out.filter(pa.array(own))

    return rows.mapInArrow(run, "key long, id long, grams binary").groupBy("key", "id").agg(F.first("grams").alias("grams"))


class Postings:
    """Which of some sets hold each hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets])
        self.first = np.cumsum(self.n) - self.n
        _, self.token = np.unique(np.concatenate(sets), return_inverse=True)
        self.owners = np.repeat(np.arange(len(sets)), self.n)[np.argsort(self.token, kind="stable")]
        self.ends = np.cumsum(np.bincount(self.token)) if len(self.token) else np.zeros(0, np.int64)
        self.begins = np.diff(self.ends, prepend=0)
        self.begins = self.ends - self.begins

    def like(self, i: int, similarity: float) -> np.ndarray:
        """The sets whose Jaccard similarity to set i is at least that, i included if it has any hash."""
        t = self.token[self.first[i] : self.first[i] + self.n[i]]
        a, size = self.begins[t], self.ends[t] - self.begins[t]
        met = self.owners[np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)]
        common = np.bincount(met, minlength=len(self.n))
        return np.flatnonzero((common >= similarity * (self.n + self.n[i] - common) - 1e-9) & (common > 0))


def resembling(part: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The root row of each row's component by exact Jaccard similarity; part as in key_links.

    A row that an earlier one has linked is put off: it is compared only if its
    component is not the largest in the end, whose rows cannot gain a link that
    rows outside it do not find as well.
    """
    forest, posts = Forest(len(sets)), Postings(sets)

    def compare(i: int) -> np.ndarray:
        j = posts.like(i, similarity)
        forest.add(np.full(len(j), i), j)
        return j

    if part[0] in (1, 2):
        for i in np.flatnonzero(part == (1 if (part == 1).sum() <= (part == 2).sum() else 2)).tolist():
            compare(i)
        return forest.root
    todo = np.ones(len(sets), bool)
    linked = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not linked[i]:
            todo[i] = False
            linked[compare(i)] = True
    for i in np.flatnonzero(todo & (forest.root != np.bincount(forest.root).argmax())).tolist():
        compare(i)
    return forest.root


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of set ids from rows (key, sub, id, grams) sorted by task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kept = None, []

        def done():
            if len(kept) > 1:
                ids = np.array([k[0] for k in kept], np.int64)
                root = resembling(np.array([k[1] for k in kept]), [np.frombuffer(k[2], "<u8") for k in kept], similarity)
                child = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], names=["a", "b"])

        for batch in batches:
            for key, sub, own, grams in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (key, sub >> 2) != task:
                    yield from done()
                    task, kept = (key, sub >> 2), []
                kept.append((own, sub & 3, grams))
        yield from done()

    return rows.mapInArrow(run, "a long, b long")


def _apart(rows: DataFrame) -> DataFrame:
    """rows(key, id, grams, head) with their Jaccard distance (apart) to the head's set instead of it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for grams, head in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(grams, "<u8"), np.frombuffer(head, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                apart.append(1 - common / max(len(a) + len(b) - common, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(apart, pa.float64())], names=["key", "id", "grams", "apart"])

    return rows.mapInArrow(run, "key long, id long, grams binary, apart double")


def _verify(member: DataFrame, similarity: float, hot_sets: int) -> DataFrame:
    """Edges (a, b) by which all components of exact links within each key of member(key, id, grams) hold together.

    A key's sets are compared in one task up to hot_sets hashes. Of larger keys
    all sets are first compared with the one of the least id. Those not linked to
    it (far) are compared with each other and with those of the linked ones (close)
    that the triangle inequality of the Jaccard distance leaves; both are dealt
    into parts, and pairs of parts are tasks.
    """
    n = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.shiftright("sub", 2), "id"]
    weight = F.octet_length("grams") / 8
    hot = cut(member.groupBy("key").agg(F.sum(weight).alias("hashes"), F.min("id").alias("head_id")).where(F.col("hashes") > hot_sets))
    tasks, found = member.select("key", F.lit(0).cast("long").alias("sub"), "id", "grams"), None
    if not hot.isEmpty():
        big = member.join(hot.select("key", "head_id"), "key")
        heads = big.where("id = head_id").select("key", "head_id", F.col("grams").alias("head"))
        others = big.drop("head_id").join(heads, "key").where("id <> head_id")
        scored = cut(_apart(others.select("key", "id", "grams", "head")))
        near = F.col("apart") <= 1 - similarity + 1e-9
        found = scored.where(near).join(hot, "key").select(F.col("id").alias("a"), F.col("head_id").alias("b"))
        far = scored.where(~near).groupBy("key").agg(F.min("apart").alias("least"), F.ceil(F.sum(weight) / hot_sets).alias("far_parts"))
        close = scored.where(near).join(far, "key").where(F.col("apart") >= F.col("least") - (1 - similarity) - 1e-9)
        parts = cut(far.join(close.groupBy("key").agg(F.ceil(F.sum(weight) / hot_sets).alias("close_parts")), "key", "left").na.fill(0, ["close_parts"]))
        rows = scored.withColumn("near", near).join(parts, "key").where(~F.col("near") | (F.col("apart") >= F.col("least") - (1 - similarity) - 1e-9))
        own = F.pmod(F.xxhash64("id"), F.when(F.col("near"), F.col("close_parts")).otherwise(F.col("far_parts"))) + F.when(F.col("near"), F.col("far_parts")).otherwise(0)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("near"), F.col("far_parts")).otherwise(F.col("far_parts") + F.col("close_parts")) - 1))
        rows = rows.withColumn("own", own).withColumn("other", other)
        kind = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
        task = F.least("own", "other") * (F.col("far_parts") + F.col("close_parts")) + F.greatest("own", "other") + 1
        rows = rows.select("key", (task * 4 + kind).cast("long").alias("sub"), "id", "grams")
        tasks = tasks.join(hot.select("key"), "key", "left_anti").union(rows)
    edges = _verified(tasks.repartition(n, "key", F.shiftright("sub", 2)).sortWithinPartitions(*order), similarity)
    return edges if found is None else edges.union(found)


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, candidate_distance: int = 140, hot_key: int = HOT_KEY, hot_sets: int = HOT_SETS) -> DataFrame:
    """doc_id, content, id (of the set of shingles), root, component_id for every document, by links of exact Jaccard similarity.

    Fingerprints only find candidates: among sets that share a key, those at
    candidate_distance or less. At similarity 0.8 fingerprints of 512 bits differ
    in 78 bits, with a deviation of 8 (96 and 9 for 4 of 5 shingles), so 140 is 5
    deviations off at least. Components of candidates are then compared in full.
    """
    ship(docs.sparkSession)
    each = cut(signatures(docs, shingle, words))
    at = F.min(F.struct("doc_id", "content"))
    distinct = cut(each.groupBy("id").agg(F.min("doc_id").alias("least"), at.alias("at"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keys = _keyed(distinct)
    several = keys.groupBy("key").count().where("count > 1")
    rows = cut(keys.join(several, "key", "left_semi")).join(distinct.select("id", "fp"), "id")
    near = stars(_linked(_dealt(rows, "fp", hot_key), words, candidate_distance))
    member = near.select(F.col("a").alias("id"), F.col("b").alias("key")).union(near.select(F.col("b").alias("id"), F.col("b").alias("key")).distinct())
    member = cut(member.join(distinct.select("id", F.col("at.doc_id").alias("at_doc"), F.col("at.content").alias("at_content")), "id"))
    sets = cut(gram_sets(docs, member, shingle))
    return _components(each.select("doc_id", "content", "id"), distinct, stars(_verify(sets, similarity, hot_sets)))


def hex_digits(number):
    """Column of a long's 16 hexadecimal digits, as an unsigned number."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def clean(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, of equal ones that of the least hash of its text.

    Rows without a doc_id cannot stand for a group and all stay.
    """
    found = similar(docs.select("doc_id", "text"), **how).where("doc_id IS NOT NULL")
    first = F.col("doc_id") == F.col("component_id")
    rows = cut(found.groupBy("doc_id", "content").agg(F.first("root").alias("root"), F.first("component_id").alias("component_id"), F.count("*").alias("rows")))
    several = rows.where(first).groupBy("root").agg(F.min("content").alias("winner"), F.count("*").alias("texts")).where("texts > 1")
    beaten = rows.where(first).join(several, "root").where("content <> winner").select("doc_id", "content")
    gone = cut(rows.where(~first).select("doc_id", "content").union(beaten).withColumnsRenamed({"doc_id": "gone_doc", "content": "gone_content"}))
    kept = docs.join(_listed(gone, 32), (docs.doc_id.cast("long") == gone.gone_doc) & (_content() == gone.gone_content), "left_anti")
    if rows.where(first & (F.col("rows") > 1)).isEmpty():
        return kept
    own = _free("content", docs.columns)
    kept = kept.withColumn(own, _content())
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", own]).unionByName(kept.where("doc_id IS NULL")).drop(own)


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
