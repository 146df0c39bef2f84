"""Operators 4, 5, 7, 9, 10 and the pipeline."""

import hashlib
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reelspark.llm import decontaminate, htmltree, langid, quality, queries, sharding, warc
from reelspark.session import ARROW_BYTES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a&amp;amp;b &lt;i&gt;&nbsp; c&#233;", "a&amp;b <i> cé"),
        ("<body><nav>menu</nav><p>one<p>two <b>bold</b> word<br>next</p>tail<footer>f</footer>", "one\ntwo bold word next\ntail"),
        ("<article><h1>T</h1><p>x</p><div class='comments'><p>no</p></div><aside>no</aside><p>y</p></article><p>outside</p>", "T\nx\ny"),
        ("<main><header><h1>T</h1></header><form>q</form><p>x</main>", "T\nx"),
        ("<header>no</header><div id=cookie-notice>no</div><div class='AD banner'>no</div><div role=search>no</div><p hidden>no</p><p>x</p>", "x"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- c <p> --><title>t</title><p title='a>b'>x</p><noscript>n</noscript>", "x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<p>cut of", "cut of"), ("<p>cut <a hre", "cut"), ("<p>a</p></div></p>b", "a\nb"),
        ("<P CLASS=x>Up</P><![CDATA[no]]><?php no ?>", "Up"), ("a < b and c > d", "a < b and c > d"), ("<article>" + "<p>w</p>" * 5000, "\n".join(["w"] * 5000)),
    ],
)
def test_extraction(html, text):
    assert htmltree.extract(htmltree.Page(html)) == text


def test_style_tree_drops_what_pages_share(spark, monkeypatch):
    pages = [(k, f"http://Site.example/{k}", f"<body><div class=x1>Read our other pages today</div><div class=x2><p>Unique text number {k} of this page.</p><p>More {k * 7}</p></div><div class=x3>All rights {k % 2}</div>") for k in range(30)]
    pages += [(100, "http://other.example/", "<body><div class=x1>Read our other pages today</div><p>z</p>"), (101, None, None), (102, "nonsense", ""), (0, *pages[0][1:])]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string").selectExpr("*", "1 AS host", "2 AS low")
    got = {r.page_id: r.text for r in htmltree.main_text(df).collect()}
    assert got[3] == "Unique text number 3 of this page.\nMore 21"
    assert got[100] == "Read our other pages today\nz" and got[101] == got[102] == ""
    monkeypatch.setattr(htmltree, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in htmltree.main_text(df).collect()} == got
    assert htmltree.main_text(df).count() == len(pages) and htmltree.main_text(df.limit(0)).count() == 0
    tree = {r.importance for r in htmltree.style_tree(htmltree.features(df.selectExpr("'h' AS host", "html"))).collect()}
    assert all(0 <= x <= 1 for x in tree)


def test_pages_of_the_corpus(spark):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op4_html(spark, FOLDER).collect():
        inside = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("rows", [
    [(k, "x" * (k % 50)) for k in range(500)], [(1, "same")] * 300 + [(2, None), (None, "é"), (None, None)], [(5, "y" * 100000), (1, ""), (9, "z")], [],
])
def test_sharding(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "'p' AS part", "0 AS total").repartition(7)
    got = sharding.shard(df).collect()
    first = lambda d: (d is not None, d or 0)
    size = lambda t: len((t or "").encode()) + 1
    total = sum(size(t) for _, t in rows)
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    got.sort(key=lambda r: (r.shard, r.slot))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=first)
    before, slots = 0, Counter()
    for r in got:
        assert r.shard == before * 16 // total and r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r.size


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_warc_round_trip(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
    big = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" + "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\r\nX: y", big), (3, None, big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (None, "http://a/n", big), (None, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload", "3 AS row")
    path = f"file://{tmp_path}/warc"
    got = warc.round_trip(df, path, payload=True).collect()
    seen = sorted(((r.response.page_id, r.response.type, r.response.refers_to, r.response.payload_bytes, r.response.payload_digest) for r in got), key=str)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 3
        expected.append((page, "revisit" if again else "response", 3 if again else None, len(data), hashlib.sha1(data).hexdigest()))
    assert seen == sorted(expected, key=str)
    assert all(r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id == r.capture_id for r in got)
    assert all(bytes(r.response.payload) == (big if r.response.page_id == 3 else "small").encode() for r in got if r.response.page_id in (3, 4, 5))
    assert warc.round_trip(df.limit(0)).count() == 0
    text = b"".join(zlib.decompress(bytes(r.content), 31) for r in spark.read.format("binaryFile").load(path + "/*.gz").collect())
    assert text.count(b"WARC-Type: revisit") == text.count(b"WARC-Refers-To-Date: 1970") == 3


def test_large_pages_have_smaller_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_PAGE", 100)
    monkeypatch.setattr(warc, "CAPTURES_PER_FILE", 64)
    rows = [(k, f"http://a/{k}", "x" * (50 if k % 2 else 1000) + str(k)) for k in range(60)]
    path = f"file://{tmp_path}/warc"
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, payload=True).collect()
    assert {r.response.page_id: bytes(r.response.payload).decode() for r in got} == {k: h for k, _, h in rows}
    sizes = sorted(warc_file.content.count(b"WARC-Type: response") for warc_file in (type("F", (), {"content": zlib.decompress(bytes(r.content), 31)}) for r in spark.read.format("binaryFile").load(path + "/*.gz").collect()))
    assert sizes[-1] == 30 and max(sizes[:-1]) <= 4 and sum(sizes) == 60


def test_warc_reader_refuses_damage():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(record * 2)] == [b"abc"] * 2
    for bad in (record[:-6], b"x" + record, record[:-4]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_captures_without_request(spark):
    rows = [("r", "response", None), ("m", "metadata", "r"), ("q", "request", "gone"), ("i", "warcinfo", None)]
    got = warc.captures(spark.createDataFrame(rows, "record_id string, type string, concurrent_to string")).collect()
    assert sorted((r.capture_id, r.response is not None, r.request is not None, r.metadata is not None) for r in got) == [("gone", False, True, False), ("r", True, False, True)]


def test_captures_with_several_records_of_a_kind(spark):
    rows = [("r", "response", None), ("q3", "request", "r"), ("q1", "request", "r"), ("q2", "request", "r"), ("m", "metadata", "r")]
    (got,) = warc.captures(spark.createDataFrame(rows, "record_id string, type string, concurrent_to string")).collect()
    assert (got.request.record_id, got.metadata.record_id, [r.record_id for r in got.others]) == ("q1", "m", ["q2", "q3"])
    twice = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert next(warc.parse(twice))[0]["warc-concurrent-to"] == "<b>"


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op9_langid(spark, folder).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(k, "the quick thing was there with them " * 5, "en") for k in range(60)] + [(100 + k, "le chat était élégant où çà " * 5, "fr") for k in range(60)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 :: 34", "fr"), (None, "the thing there", "de"), (0, rows[0][1], "en"), (503, "the thing " * 30000, None), (504, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS held_out", "1 AS score")
    got = {r.doc_id: r for r in langid.predict(df).collect()}
    assert [got[k].lang_pred for k in (0, 100, 500, 501, 502, 503)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[500].score == 0 and got[504].lang_pred in ("en", "fr") and not got[None].held_out
    assert langid.predict(df).count() == len(rows) and langid.predict(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(df.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


def test_prediction_equals_a_plain_convolution(spark):
    net = langid.Network(["a", "b", "c"])
    text = "Some words, élan & 漢字 " * 40
    x, row, letters = langid.windows(pa.array([text, "", "short"]))
    assert row.tolist() == [0] * (len(x) - 1) + [2]
    expected = []
    for window in x:
        pooled = []
        for k in langid.WIDTHS:
            filters = net.w[f"filter{k}"].reshape(k, langid.VECTOR, langid.FILTERS)
            sums = [sum(net.w["vector"][window[i + j]] @ filters[j] for j in range(k)) for i in range(langid.WINDOW - k + 1)]
            pooled.append(np.maximum(np.max(sums, axis=0) + net.w[f"bias{k}"], 0))
        z = np.exp(np.concatenate(pooled) @ net.w["out"] + net.w["out_bias"])
        expected.append(z / z.sum())
    assert np.allclose(net.probabilities(x, net.tables()), expected, atol=1e-5)
    assert letters[0] == sum(c.isalpha() and c.isascii() or not c.isascii() for c in bytes(x[0]).decode("latin-1"))


def test_equal_probabilities_and_order_of_samples(spark):
    rows = [(k, "same text here " * 3, lang) for k, lang in enumerate(["b", "a"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = (langid.sample(x, 10) for x in (df, df.repartition(5)))
    assert one[0] == ["a", "b"] and (one[1] == other[1]).all() and (one[2] == other[2]).all()


def test_network_gradients():
    net = langid.Network(["a", "b"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 30)).astype(np.uint8), np.array([0, 1, 1, 0])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    loss = lambda: -np.log(net.probabilities(x, net.tables())[np.arange(4), y]).mean()
    grads = net.step(x, y)
    for name in net.w:
        flat, at = net.w[name].reshape(-1), int(np.argmax(np.abs(grads[name])))
        old, eps = flat[at], 1e-5
        flat[at] = old + eps
        up = loss()
        flat[at] = old - eps
        down = loss()
        flat[at] = old
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[at]) < 1e-4


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(again), n < 50 or 100 * sum(again) > 50 * n


TRICKY = [None, "", " ", "\n\n", "a\nb\na\n", "a\nb\na", "x y z\x1cw \x0b\x0cq", "é#ß\t|", "a a a a", "l\r\nl\n l\nl", "w " * 20000, "\n".join(["same line here"] * 30)]


def test_statistics_equal_brute_force(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    stats = quality.statistics(pa.array(texts, pa.string()))
    got = list(zip(*(stats[c].tolist() for c in quality.COUNTS), quality.base_failed(stats).tolist(), strict=True))
    assert got == [counted(t) for t in texts]
    assert len(quality.statistics(pa.array([], pa.string()))["n_words"]) == 0


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(0, 0.1, (300, 3)), rng.normal(3, 0.5, (10, 3))])
    scores = quality.IsolationForest(rows).scores(rows)
    assert scores[300:].min() > np.quantile(scores[:300], 0.95)
    assert quality.threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([True, True, False, False]), np.zeros(4, bool)) == pytest.approx((0.5, 1.0))


def test_quality_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, folder).collect()
    good = [r.kept for r in rows if truth.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if truth.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05 and not any(r.kept for r in rows if r.base_failed)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TRICKY)] + [(None, " ".join(f"word{k}" for k in range(80)))] * 2, "doc_id long, text string").selectExpr("*", "1 AS quality", "true AS kept")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    for few in (labels, labels.limit(0)):
        got = quality.judge(docs, few).collect()
        assert len(got) == len(TRICKY) + 2 and all(r.kept != r.base_failed for r in got)
    assert quality.clean(docs, labels).columns == docs.columns and quality.clean(docs, labels).count() == 2
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        rows = kept.collect()
        assert len(rows) == len({r.doc_id for r in rows}) and {r.doc_id for r in rows} <= set(before)
        if name != "substring_dedup":
            assert all(r == before[r.doc_id] for r in rows), name
        if name == "quality_rules":
            assert not any(counted(r.text)[-1] for r in rows)
        if name == "benchmark_decontamination":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert not any(i in decontaminate.normal(r.text) for r in rows for i in items)
            gone = [r for d, r in before.items() if d not in {x.doc_id for x in rows}]
            assert all(decontaminate.Matcher(list(enumerate(items))).find(decontaminate.normal(r.text)) for r in gone)
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in kept.collect()} and all(r.n_tokens * 4 == len(r.ids) for r in final)
    assert len({hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()} ^ {r.decoded_sha256 for r in final}) == 0


def test_all_queries_are_registered():
    names = [k for k in entry.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_boxes_inside_articles_go(spark):
    page = "<html><body><article><h1>Title {k}</h1><p>Text of its own {k}</p><div class='box'><p>Read our other stories</p></div><p>More text {k}</p></article></body></html>"
    df = spark.createDataFrame([(k, "http://h.org/x", page.format(k=k)) for k in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltree.main_text(df).collect()} == {k: f"Title {k}\nText of its own {k}\nMore text {k}" for k in range(12)}


def test_style_tree_decides_inside_articles(spark):
    own = "<p>Text of its own {k}</p><p>Join our club today</p><p>More text {k}</p>"
    page = f"<html><body><nav>menu</nav><article><h1>Title {{k}}</h1>{own}<div class='box'><p>Read our other stories</p></div></article><footer>f</footer></body></html>"
    pages = [(k, f"http://h.org/{k}", page.format(k=k)) for k in range(20)]
    pages += [(100 + k, "http://copies.org/x", page.format(k=0)) for k in range(30)]  # copies are one page, which nothing is shared with
    pages += [(200 + k, "http://empty.org/x", f"<body><div class=x>Nothing but this</div><i>{'' if k else 'x'}</i></body>") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltree.main_text(df).collect()}
    off = {r.page_id: r.text for r in htmltree.main_text(df, min_pages=10**9).collect()}
    assert all(got[k] == f"Title {k}\nText of its own {k}\nMore text {k}" for k in range(20))
    assert all(off[k] == f"Title {k}\nText of its own {k}\nJoin our club today\nMore text {k}\nRead our other stories" for k in range(20))
    assert all(got[100 + k] == off[100 + k] == off[0] for k in range(30)) and all(off[200 + k].startswith("Nothing") for k in range(20))


def test_verdict_equals_brute_force_paths():
    rng = np.random.default_rng(4)
    rows = np.abs(np.concatenate([rng.normal(0, 0.1, (300, 7)), rng.normal(0, 0.1, (30, 7)) + [0, 2, 0, 0, 0, 0, 0], rng.normal(0, 0.1, (30, 7)) + [0, 0, 0, 1, 0, 0, 0]]))
    rows[:20] = rows[0]  # ties
    good = np.arange(360) < 300
    judge = quality.Judge(rows, good)
    highest, kept = judge.scores(rows)
    for i in range(360):
        best, fine = 0.0, True
        for view, forest, limit in judge.used:
            total = 0.0
            for feature, split, child, length in forest.trees:
                node = 0
                while child[node][0] != node:
                    node = child[node][int(rows[i, view][feature[node]] > split[node])]
                total += length[node]
            score = 2 ** -(total / len(forest.trees) / forest.scale)
            best, fine = max(best, score), fine and score <= limit + 1e-12
        assert abs(best - highest[i]) < 1e-9 and fine == kept[i]
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.1 and {v[0] for v, _, _ in judge.used if len(v) == 1} >= {1, 3}
    assert len(set(highest[:20].tolist())) == 1


def test_lines_that_polynomials_mix_up():
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    text = f"{word}\n{word.translate(str.maketrans('ab', 'ba'))}\n"
    stats = quality.statistics(pa.array([text, text + text]))
    assert stats["n_dup_lines"].tolist() == [0, 2]


def test_pipeline_of_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    good = [text(90) for _ in range(8)]
    item = text(30)
    rows = [
        (1, good[0], "a"), (1, good[0], "a"), (None, good[1], "b"), (None, good[1], None), (None, None, "n"), (2, None, None), (3, "", None), (4, good[2], None),
        (5, good[2] + " more words", None), (6, good[3] + " " + item, None), (None, good[4] + " " + item, None), (7, "short text", None), (8, good[5] + " " + good[4], None),
        (9, good[4] + " " + good[6] + " " + good[7], None),
    ]
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").selectExpr("doc_id", "text", "extra AS content", "1 AS gone_doc", "length(text) AS n_chars", "'k' AS key")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id for r in got), key=str) == [1, 4, 8, 9, None, None]
    found = {(r.doc_id, r.decoded_sha256) for r in got}
    assert {(1, digest(good[0])), (4, digest(good[2])), (None, digest(good[1])), (8, digest(f"{good[5]} {good[4]}")), (9, digest(f"{good[6]} {good[7]}"))} == found
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_pipeline_bounds_arrow_batches(spark, tmp_path):
    """Bytes bound a batch, however few rows that are; a smaller limit of the session stays."""
    spark.range(3000).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 800) text").coalesce(1).write.parquet(path := f"{tmp_path}/documents.parquet")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for own, most in ((None, ARROW_BYTES), ("1m", 1 << 20)):
        session = spark.newSession()
        if own:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
        docs = session.read.parquet(path)
        assert corpus_pipeline.substring_dedup(session, docs, str(tmp_path)).count() == 3000
        sizes = docs.mapInArrow(run, "n long, size long").collect()
        assert sum(r.n for r in sizes) == 3000 and len(sizes) > 1 and max(r.size for r in sizes) < most + 20_000


GIVEN_BACK = """
import sys
import numpy as np, pyarrow as pa
from reelspark.llm.textcore import lean, lean_group

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

pins = []

def work(*args):  # small pieces below one that stays
    some = [np.ones(12_000) for _ in range(2000)]
    pins.append(np.ones(12_000))
    return len(some)

def run(batches):
    for batch in batches:
        work()
        yield batch

before = resident()
if sys.argv[1] == "lean":
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
else:
    assert lean_group(work)(None, None) == 2000
print(resident() - before)
"""


@pytest.mark.parametrize("kind", ["lean", "lean_group"])
def test_workers_give_back_memory(kind):
    root = Path(corpus_pipeline.__file__).parent
    out = subprocess.run([sys.executable, "-c", GIVEN_BACK, kind], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 60  # of 190 MB
