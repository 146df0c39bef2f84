"""Operators 2, 6 and 8 against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import components, decontaminate, queries, simhash, substring

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def distance_within(item, text):
    """Least edits between item and any passage of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abc", max_size=60))
def test_myers_equals_dynamic_programming(item, text):
    scores = list(decontaminate.Pattern(item).distances(text))
    assert min([*scores, len(item)]) == distance_within(item, text)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_matcher_finds_all_within_budget(data):
    item = data.draw(st.text("abcd ", min_size=30, max_size=80))
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    edited = list(item)
    for _ in range(data.draw(st.integers(0, 8))):
        k = rng.randrange(len(edited) + 1)
        edited[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
    text = decontaminate.normal(data.draw(st.text("abcdx ", max_size=60)) + "".join(edited) + data.draw(st.text("abcdx ", max_size=60)))
    own = decontaminate.normal(item)
    got = decontaminate.Matcher([(1, item)]).find(text)
    if not own:
        assert got == []
        return
    best, k = distance_within(own, text), decontaminate.budget(len(own))
    assert [(i, d) for i, d, *_ in got] == ([(1, best)] if best <= k else [])
    for _, d, begin, end in got:
        assert distance_within(own, text[begin:end]) == d


def test_decontamination(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, ""), (4, "tiny"), (5, "The quick brown fox jumps over the lazy dog near the river bank"), (None, "some other sentence that nobody has written so far")]
    texts = [
        (1, "x " * 5000 + "the QUICK brown\n fox jumped over the lazy dogs near the river bank" + " y" * 5000), (2, None), (3, ""), (4, "a clean text about a quick brown dog and a lazy river"), (5, "tiny"),
        (None, "The quick brown fox jumps over the lazy dog near the river bank"), (1, "repeat of nothing"),
    ]
    docs = spark.createDataFrame(texts, DOCS).selectExpr("*", "7 AS item_id", "text AS begin")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = decontaminate.matches(docs, bench)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got.collect()), key=str) == sorted([(1, 1, 3), (1, 5, 3), (5, 4, 0), (None, 1, 0), (None, 5, 0)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def least_edits(items, text):
    """Least edits between each item and any passage of text, by dynamic programming over all items at once."""
    size = np.array([len(i) for i in items])
    letters = np.full((len(items), size.max() + 1), -1, np.int64)
    for k, item in enumerate(items):
        letters[k, 1 : len(item) + 1] = [ord(c) for c in item]
    place = np.arange(size.max() + 1)
    row, at = np.tile(place, (len(items), 1)), np.arange(len(items))
    best = size.copy()
    for c in map(ord, text):
        new = np.minimum(row + 1, np.roll(row, 1, axis=1) + (letters != c))
        new[:, 0] = 0
        row = np.minimum.accumulate(new - place, axis=1) + place
        best = np.minimum(best, row[at, size])
    return best


def test_matches_equal_all_pairs(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, queries.op2_decontaminate(spark, FOLDER).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 100_000)
    assert len(decontaminate.item_blocks(bench)) > 2
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == whole and whole
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r[0] for r in whole}
    items = [(r.item_id, decontaminate.normal(r.text)) for r in bench.collect()]
    expected = []
    for r in docs.collect():
        text = decontaminate.normal(r.text)
        if len(text) < 6000 or r.doc_id in {w[0] for w in whole}:  # the others would take minutes
            found = least_edits([i for _, i in items], text)
            expected += [(r.doc_id, i, int(d)) for (i, own), d in zip(items, found, strict=True) if d <= decontaminate.budget(len(own))]
    assert sorted(expected) == [w[:3] for w in whole]


def removed(docs, width):
    owner, spans = {}, []
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    last = float("inf")
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            owner[key] = min(owner.get(key, last), last if d is None else d)
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if owner[tuple(w[i : i + width])] < (last if d is None else d):
                gone[i : i + width] = [True] * width
        spans.append((d, w, gone))
    return spans


def expected_digests(docs, width=50):
    return sorted(((d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for d, w, g in removed(docs, width)), key=str)


def digests(spark, docs, **how):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS kind", "2 AS bucket", "'h' AS hits")
    return sorted((tuple(r) for r in substring.dedupe(df, digest=True, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé") + rng.choice(["", ",", "!"])
    shared = [[word() for _ in range(n)] for n in (50, 49, 51, 80, 130)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 30))]
            parts += rng.choice(shared)
        docs.append((rng.randint(0, 60), rng.choice([" ", "\n", "  \t"]).join(parts)))
    return [*docs, docs[0], (None, docs[1][1]), (None, docs[1][1]), (7, None), (8, ""), (9, "a " * 400), (10, "a " * 300), (11, " ".join(f"w{k}" for k in range(30000)))]


@pytest.mark.parametrize(("seed", "hot"), [(1, substring.HOT), (2, 30)])
def test_substring_equals_brute_force(spark, seed, hot):
    docs = passages(seed)
    assert digests(spark, docs, hot=hot) == expected_digests(docs)


def twins(n):
    """Two different words that a polynomial hash modulo 2^64 takes for one."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_mix_up(spark):
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*words[:30], word, *words[30:]])) for k, word in enumerate(twins(1024))]
    docs += [(2 + k, " ".join(" ".join(twins(2)[int(c == "b")] for c in word))) for k, word in enumerate(twins(64))]
    docs = [(d, t if d < 2 else " ".join(t.split())) for d, t in docs]
    assert digests(spark, docs) == expected_digests(docs)
    assert expected_digests(docs)[1][2] == 0


def test_substring_on_the_corpus_and_empty_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op6_substring(spark, FOLDER).collect()), key=str)
    assert got == expected_digests(docs)
    assert digests(spark, []) == []


def test_substring_clean_keeps_white_space_and_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (2, f"Before,\n it.  {text}\nAfter  it", "b"), (3, None, "c")], DOCS + ", rest string")
    got = {r.doc_id: r for r in substring.clean(docs).collect()}
    assert substring.clean(docs).columns == docs.columns
    assert (got[1].text, got[2].text, got[3].text, got[2].rest) == (text, "Before,\n it.  After  it", None, "b")


def simhash_of(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def classes(ids, fps, limit):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(fps)):
        members[find(i)].append(i)
    least = {r: min((ids[i] for i in m if ids[i] is not None), default=None) for r, m in members.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (None, "   "), (902, "Two words"), (903, "two  WORDS"), (904, docs[3][1]), (None, docs[4][1]), (905, "É é"), (906, "é é"), (907, "w " * 100000)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS id", "'f' AS fp", "0 AS component_id")
    fps = [simhash_of(t, 4) for _, t in docs]
    expected = sorted(zip([d for d, _ in docs], [format(f, "016x") for f in fps], classes([d for d, _ in docs], fps, 4), strict=True), key=str)
    got = simhash.groups(df, shingle=4, max_distance=4)
    assert sorted((tuple(r) for r in got.select("doc_id", simhash.hex_digits("id"), "component_id").collect()), key=str) == expected
    assert simhash.groups(df.limit(0), shingle=4, max_distance=4).count() == 0


def test_shingle_hash_is_the_engines(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    hashes, per = simhash.shingle_hashes(np.frombuffer(b"A b  c\td", np.uint8), np.array([0, 8]), 4)
    assert per.tolist() == [1] and int(hashes.view(np.int64)[0]) == r.h


@pytest.mark.parametrize(("hot_key", "n"), [(4096, 0), (8, 0), (4096, 1 << 40)])
def test_links_within_hot_keys(spark, hot_key, n):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)} | {int(x) & 0xFFFF for x in base})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, f.to_bytes(8, "little")) for s, f in zip(signed, fps, strict=True)], "id long, fp binary")
    plan = simhash.block_plan(4, n)
    assert len(plan) == (70 if n else 15)
    star = components.stars(simhash.edges(df, plan, 4, hot_key)).collect()
    root = {s: s for s in signed} | {r.a: r.b for r in star}
    expected = classes(signed, fps, 4)
    groups = lambda labels: {frozenset(s for s, x in zip(signed, labels, strict=True) if x == y) for y in labels}
    assert groups([root[s] for s in signed]) == groups(expected)


@pytest.mark.parametrize("parts", [False, True])
def test_key_links_equal_all_pairs(parts):
    rng = np.random.default_rng(8)
    for words, limit in ((1, 4), (2, 30)):
        base = rng.integers(0, 1 << 64, (70, words), dtype=np.uint64)
        flips = rng.random((700, 64 * words)) < limit / 200 / words
        fps = base[rng.integers(0, 70, 700)] ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")
        fps[:300] = base[0] ^ np.packbits(rng.random((300, 64 * words)) < 0.03, axis=1, bitorder="little").view("<u8")
        part = np.array([1, 2])[np.arange(700) % 2] if parts else np.zeros(700, np.int64)
        near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int64) <= limit
        if parts:
            near &= part[:, None] != part[None]
        whole = simhash.Forest(700)
        whole.add(*np.nonzero(near))
        got = simhash.links(np.zeros(700, np.int64), part, fps, limit)
        if not parts:
            assert np.array_equal(got, whole.root)
        else:  # more links of one part may be found as well
            for root in np.unique(whole.root):
                assert len(set(got[whole.root == root].tolist())) == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.a: r.b for r in components.stars(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components.stars(edges.limit(0)).count() == 0


def test_near_dedup_finds_planted_copies(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k % 97}" for k in range(4000)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        docs.append((d, " ".join(text)))
        if d % 3 == 0:
            near = list(text)
            for k in rng.sample(range(len(near)), max(1, len(near) // 100)):
                near[k] = "edited"
            docs.append((1000 + d, " ".join(near)))
        if d % 5 == 0:
            docs.append((2000 + d, " ".join(text)))
    df = spark.createDataFrame([(*r, "x") for r in docs] + [(None, docs[0][1], "y"), (7, docs[7][1], "z")], DOCS + ", id string")
    kept = simhash.clean(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(60)) and ids.count(None) == 1


@pytest.mark.parametrize("size", [25, 100, 1000])
def test_keys_of_sets_find_pairs_right_at_the_limit(size):
    rng = np.random.default_rng(size)
    pairs, common = 400, size * 8 // 9 + 1  # common / (2 size - common) is 0.8 or a little more
    hashes = []
    for _ in range(pairs):
        all_ = rng.integers(0, 1 << 64, 2 * size - common, dtype=np.uint64)
        hashes += [all_[:size], all_[-size:]]
    keys = simhash.band_keys(np.concatenate(hashes), np.full(2 * pairs, size))
    assert (keys[::2] == keys[1::2]).any(1).all()
    assert abs((keys[::2] == keys[1::2]).mean() - (common / (2 * size - common)) ** simhash.ROWS) < 0.05
    assert not (keys[1:-1:2] == keys[2::2]).any()


@pytest.mark.parametrize(("hot_key", "hot_sets"), [(1 << 15, 1 << 20), (3, 300)])
def test_clean_equals_brute_force_jaccard(spark, hot_key, hot_sets):
    rng = random.Random(9)
    docs = [(900, "one two"), (901, "One  two"), (902, None), (903, " "), (904, "a b c d e f g h"), (905, "a b c d e f g h i"), (906, "a b c d e f g")]
    for d in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((12, 30, 120, 300)))]
        for k in range(6):
            near = list(text)
            for at in rng.sample(range(len(near)), k * len(near) // 120):
                near[at] = "edited"
            docs.append((10 * d + k, " ".join(near[: len(near) - rng.randrange(3)])))
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    expected = {min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in root}
    kept = simhash.clean(spark.createDataFrame(docs, DOCS), hot_key=hot_key, hot_sets=hot_sets)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_near_dedup_of_repeated_ids(spark):
    one, other = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    docs = [(1, one), (1, other), (1, other + " more"), (2, one + " more"), (2, one + " more"), (3, other), (4, "c " * 70), (4, "c " * 70), (None, one), (None, None)]
    kept = simhash.clean(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS content", "2 AS gone_doc"))
    assert kept.columns == ["doc_id", "text", "content", "gone_doc"]
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == 5 and {(1, one), (4, "c " * 70), (None, one), (None, None)} < set(rows) and {(1, other), (1, other + " more")} & set(rows)
    assert simhash.clean(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("kernel", "most"), [("probe", 9), ("own", 60)])
def test_substring_kernels_hold_little(kernel, most):
    """Bytes held at once for a byte of a slice of text, and for a candidate (20 bytes); slices and buckets are of bounded size."""
    rng = np.random.default_rng(3)
    if kernel == "probe":
        size, n = substring.BATCH_BYTES, 1200
        texts = [" ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, size * 3 // n // 6)) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array(texts)], names=["at", "void", "text"])
        work = substring._probe(7, 50)
    else:
        size = 1_000_000
        hashes, ids = rng.integers(0, 500_000, size).astype("<u8"), substring.Ids(np.sort(rng.integers(0, 5000, size)), np.zeros(size, bool))
        table = pa.Table.from_batches([substring._batch([(1, 1, size, hashes.tobytes(), np.zeros(size, "<u4").tobytes(), ids.pack())])])
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in work(iter([batch]))) if kernel == "probe" else substring._own((pa.scalar(1),), table).num_rows
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and held < most * size, held / size
