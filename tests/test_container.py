"""Containers: building, walking, the data source, audio packets and sidecar texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import codecs
from reelspark.sources import container, pagefile, textfiles
from reelspark.sources.container import Stream
from reelspark.sources.pagefile import PageFileSource


def sample(pages=20, start=0):
    video, audio = Stream(0, 1, "M2Y0", 16, 16, 30, 1), Stream(1, 2, "PC16", 0, 0, 0, 0)
    return container.build([video, audio], [[(0, 1, k, b"M2Y0" + bytes([k % 256]) * (k + 1)), (1, 0, k, b"pcm")] for k in range(start, start + pages)])


def walk(data, **how):
    return list(container.packets_of(lambda at, n: data[at : at + n], len(data), container.first_page(data), **how))


def test_walk_gives_what_was_built():
    got = walk(sample())
    assert len(got) == 40 and all(p.crc_ok for p in got)
    assert [p.frame for p in got if p.sid == 0] == list(range(20))
    assert [p.pts for p in got if p.sid == 0] == [k * 1000 for k in range(20)]
    assert container.streams_of(sample())[0] == Stream(0, 1, "M2Y0", 16, 16, 30, 1)


def test_walks_end_at_damage_or_refuse_it():
    data = sample()
    assert len(walk(data[:-3])) == 38
    assert len(walk(data[:-3] + b"tail" * 20)) >= 38
    with pytest.raises(ValueError, match="no page"):
        walk(data[:-3], strict=True)
    with pytest.raises(ValueError, match="not a page container"):
        container.first_page(b"nothing" * 20)
    broken = bytearray(data)
    broken[-1] ^= 1
    assert not walk(bytes(broken))[-1].crc_ok


def test_body_heads():
    body = b"M2Y1" + bytes(4) + (7).to_bytes(4, "little") + bytes([1, 9, 0, 0]) + b"".join(n.to_bytes(4, "little") for n in (2, 0, 1)) + bytes([33, 0, 44])
    assert container.body_head(body) == {"codec": "M2Y1", "frame": 7, "keyframe": True, "sizes": [2, 0, 1], "nkeep": 9, "plane_qp": [33, 44]}
    assert container.body_head(b"M2Y1") is None
    assert container.body_head(b"RAWV" * 9) is None


def test_assets_replace_the_bundle():
    once = container.add_assets(sample(), [("menu.cover", 1, b"abc")])
    twice = container.add_assets(once, [("menu.cover", 1, b"abcd"), ("x", 2, b"")])
    assert [(a[0], a[3]) for a in container.assets_of(twice)] == [("menu.cover", 4), ("x", 0)]
    assert container.assets_of(sample()) == [] and container.assets_of(twice[:-1]) == []
    assert len(walk(twice)) == 40


def test_files_and_data_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.bin").write_bytes(sample(10, 10 * k))
    files = container.read_files(spark, str(tmp_path))
    a = container.read_packets(files).drop("file", "body").collect()
    spark.dataSource.register(PageFileSource)
    df = spark.read.format("pagefile").option("splitBytes", 400).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 6
    assert sorted(a) == sorted(df.drop("file", "body").collect()) and len(a) == 60
    assert container.read_streams(files).count() == 6
    points = container.seek_points(container.read_packets(files, body=4), F.col("sid") == 0, most=4)
    assert points.count() == 12


@pytest.mark.parametrize("split", [33, 64, 100, 1 << 20])
def test_ranges_hold_each_page_once(tmp_path, split):
    data = sample(12)
    plain = list(container.packets_of(lambda a, n: data[a : a + n], len(data), container.first_page(data)))
    indexed = container.with_index(data, [(0, 96)], 12)
    for kind, content in {"plain": data, "index": indexed, "bundle": container.add_assets(indexed, [("poster", 1, data)])}.items():
        (file := tmp_path / kind).write_bytes(content)
        options = {"path": str(file), "splitBytes": str(split)}
        got = [row for run in pagefile.ranges(pagefile._files(options), options) for batch in pagefile._read(run, options) for row in batch.to_pylist()]
        assert [(r["page_offset"], r["seq"], r["ordinal"], r["body"]) for r in got] == [(p.page_offset, p.seq, p.ordinal, p.body) for p in plain], kind


def test_stream_takes_each_file_once(spark, tmp_path):
    spark.dataSource.register(PageFileSource)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for k in range(4):
        (source / f"f{9 - k}.bin").write_bytes(sample(5, 5 * k))  # later names sort earlier
        if k % 2:
            query = spark.readStream.format("pagefile").load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
            query.processAllAvailable()
            query.stop()
            assert spark.read.parquet(out).where("sid = 0").count() == 5 * (k + 1)


def test_audio_packets(spark):
    rng = np.random.default_rng(1)
    pcm = np.cumsum(rng.integers(-300, 300, (5, 33)), axis=1)
    first, nibbles = codecs.encode(pcm)
    again = codecs.decode(first, nibbles)
    assert np.abs(again - pcm).max() < 2000 and (again[:, 0] == pcm[:, 0]).all()
    data = codecs.packet(7, int(first[0]), nibbles[0])
    assert len(data) == 20 + 16
    frame, start, back = codecs.parse(data)
    assert (frame, start) == (7, int(first[0])) and (back == nibbles[0]).all()
    rows = codecs.encode_frames(spark.createDataFrame([(1, [0] * 9), (2, [40000] * 9)], "frame long, samples array<int>")).collect()
    assert [r.max_error for r in rows] == [0, 0]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\nthere\n\n2\n00:00:05,000 --> 00:00:04,000\nnever\n3\n00:00:06.000 --> 00:00:07.500\nlast")
    got = textfiles.cues(textfiles.lines(spark, str(tmp_path / "a.srt"))).orderBy("cue").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1000, 2000, "Hi\nthere"), (6000, 7500, "last")]
    (tmp_path / "a.chapters").write_text("# c\n0:10|First\nbad line here\n1:00:00 Second\n75\n")
    got = textfiles.chapters(textfiles.lines(spark, str(tmp_path / "a.chapters"))).orderBy("n").collect()
    assert [(r.seconds, r.label) for r in got] == [(10.0, "First"), (3600.0, "Second"), (75.0, "Chapter 3")]
    (tmp_path / "a.ini").write_text("top=1\n[Sound]\nvolume = 900\nvolume = 70\n#x=1\n[Video]\nbright=no\n")
    rows = textfiles.lines(spark, str(tmp_path / "a.ini"))
    assert [(r.block, r.key, r.value) for r in textfiles.manifest(rows).orderBy("n").collect()] == [(None, "top", "1"), ("Sound", "volume", "900"), ("Sound", "volume", "70"), ("Video", "bright", "no")]
    got = textfiles.settings(rows, {"volume": (0, 50, 10), "bright": (0, 9, 5)}).collect()
    assert {r.key: r.value for r in got} == {"volume": 50, "bright": 5}


def test_merge_and_mux_as_rows_equal_those_in_memory(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(container, "PART_PAGES", 3)
    stream = container.Stream(0, container.VIDEO, "M2Y1", 16, 16, 25, 1)
    frames = [[(0, 0, k, b"x" * (k + 1))] for k in range(8)]
    segments = [container.build([stream], frames[:4]), container.build([stream], frames[3:6], 3), container.build([stream], frames[5:], 5)]
    rows = spark.createDataFrame([("a", k, min(k, 1), s) for k, s in enumerate(segments)], "file string, segment long, skip int, content binary")
    whole = lambda parts: b"".join(bytes(r.content) for r in parts.orderBy("part").collect())
    merged = container.merge(segments, [0, 1, 1])
    parts = container.merged(rows)
    assert whole(parts) == merged and parts.count() == 3
    audio = spark.createDataFrame([("a", k, b"s" * k) for k in (1, 2, 7, 9)], "file string, frame long, body binary")
    sounds = [b"s" * k if k in (1, 2, 7) else b"\0\0" for k in range(8)]
    muxed = container.muxed(spark.createDataFrame([("a", merged)], "file string, content binary"), audio, b"\0\0")
    assert whole(muxed) == container.mux(merged, sounds, b"\0\0")
    got = container.read_parts(muxed).orderBy("seq", "sid").collect()
    assert [(r.page_offset, r.sid, bytes(r.body)) for r in got] == [(p.page_offset, p.sid, p.body) for p in container.packets_of(lambda a, n: whole(muxed)[a : a + n], len(whole(muxed)), 128)]
    with pytest.raises(Exception, match="expected page 4, got 5"):
        container.merged(rows.withColumn("skip", F.when(F.col("segment") == 1, 2).otherwise(F.col("skip")))).collect()
