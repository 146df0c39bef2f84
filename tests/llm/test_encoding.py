"""Operators 1 and 3: the automaton and the token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm import bpe, queries, rans

LETTERS = "aabcdefghijklmnoprstuvwyz   \n\t.,'!#12 éÅ漢字😀՘͸\x1c\x85\xa0　ÇABCTHEªºʰǅ²½_-'s"
TEXTS = st.one_of(st.text(LETTERS, max_size=60), st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", " the", "ing", " ", "\n", "don't", "x" * 70, "‍"]), max_size=12).map("".join))
ROWS = [(1, "plain words, and more. Words"), (2, None), (3, ""), (3, ""), (4, "a  b\n\n c\t"), (None, "x<|endoftext|>y"), (5, "long " * 30000), (6, "z" * 50000), (1, "plain words, and more. Words")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_automaton_equals_library(text):
    library = _cached_library()
    ids = np.frombuffer(bpe.encoder(bpe.TOKENIZER).encode(text), "<u4")
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(bpe.TOKENIZER).automaton.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_kept_pieces_equal_library(text):
    got = rans.tokenizer(bpe.TOKENIZER).texts(pa.array(["first ", text, None, " last"]))
    expected = [_cached_library().encode(t, add_special_tokens=False).ids for t in ("first ", text, "", " last")]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == expected


def _cached_library(known=[]):  # noqa: B006
    if not known:
        known.append(Tokenizer.from_file(bpe.TOKENIZER))
    return known[0]


def test_words_of_the_corpus_equal_library(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = bpe.encoder(bpe.TOKENIZER)
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == known.ids


def merged(word, merges):
    """Plain rule-by-rule merging."""
    parts = list(word)
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if parts[k : k + 2] == [a, b]:
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_gadgets_on_small_alphabets(data):
    letters = bpe.byte_letters()
    tokens, merges = list("ab"), []
    for _ in range(data.draw(st.integers(0, 9))):
        a, b = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    vocab = {c: k for k, c in enumerate(letters.values())} | {t: 256 + k for k, t in enumerate(tokens[2:])}
    names = {k: t for t, k in vocab.items()}
    automaton = bpe.Automaton(vocab, merges)
    word = data.draw(st.text("ab", min_size=1, max_size=25))
    assert [names[k] for k in automaton.word(word.encode())] == merged(word, merges)


def test_bpe_query(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "doc_id AS ids", "'x' AS decoded")
    got = bpe.encode(df, decode=True)
    assert got.columns == ["doc_id", "ids", "decoded", "_ids", "_decoded"]
    for r in got.collect():
        texts = {t or "" for d, t in ROWS if d == r.doc_id}
        assert r._decoded in texts
        assert np.frombuffer(r._ids, "<u4").tolist() == library.encode(r._decoded, add_special_tokens=False).ids
    assert got.count() == len(ROWS)
    again = bpe.decode(got.select("doc_id", "_ids").withColumnRenamed("_ids", "ids"))
    assert sorted(r.decoded for r in again.collect()) == sorted((t or "") for _, t in ROWS)
    empty = bpe.encode(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_bpe_digests(spark, library):
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4")
        assert tuple(rows[r.doc_id])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20000), st.integers(1, 60000), st.floats(0.1, 3), st.integers(0, 99))
def test_segments_round_trip(n, symbols, skew, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.random(n) ** (1 + 3 * skew) * symbols).astype(np.uint32)
    row = rans.encode_segment(ids) | {"bucket": 0, "segment": 0}
    assert (rans.decode_segment(row) == ids).all()


def test_blocks_are_read_alone_and_damage_is_found(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 1000)
    ids = np.random.default_rng(1).integers(0, 300, 4500).astype(np.uint32)
    row = rans.encode_segment(ids) | {"bucket": 0, "segment": 0}
    assert row["block_first"] == [0, 1000, 2000, 3000, 4000]
    assert (rans.decode_segment(row, range(2, 3)) == ids[2000:3000]).all()
    payload = bytearray(row["payload"])
    payload[row["block_offset"][3] + 5] ^= 1
    bad = row | {"payload": bytes(payload)}
    assert (rans.decode_segment(bad, range(0, 3)) == ids[:3000]).all()
    with pytest.raises(ValueError, match="block 3"):
        rans.decode_segment(bad)


def test_token_files(spark, library, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS bucket")
    got = sorted(rans.round_trip(df, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(r.ids)) and ids[-1] == rans.END_ID
        assert library.decode(ids[:-1].tolist(), skip_special_tokens=False) in {t or "" for d, t in ROWS if d == r.doc_id}
        start += len(ids)
    assert rans.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rows", [3, 40])
def test_hot_ids_fill_several_buckets(spark, library, rows):
    docs = [(None, f"null {k}") for k in range(60)] + [(7, f"seven {k}") for k in range(80)] + [(d, f"text {d}") for d in range(40)] + [(-5, "x")] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cuts = rans.bounds(df, rows, 1, 1000)
    tokens = rans.tokenize(df, cuts=cuts).select("doc_id", "place", "bucket").collect()
    order = sorted(tokens, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.place))
    assert [r.bucket for r in order] == sorted(r.bucket for r in tokens) and max(r.bucket for r in tokens) < cuts.buckets
    if rows == 3:
        assert len({r.bucket for r in tokens if r.doc_id is None}) > 9 and len({r.bucket for r in tokens if r.doc_id == 7}) > 9
    got = sorted(rans.round_trip(df, rows_per_bucket=rows, least=1).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    assert sorted(r.n_tokens for r in got) == sorted(count(t) for _, t in docs)
    assert rans.bounds(df, 1, 1, 8).buckets <= 9


def test_token_files_of_the_corpus(spark, library):
    folder, start = "/root/testdata/sf0.001", 0
    rows = {r.doc_id: r for r in queries.op3_rans(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
