"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import numbers as N
from reelspark.functions import strings as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "rate"), [("24", (24, 1)), ("24000/1001", (24000, 1001)), ("48000/2002", (24000, 1001)), ("23.976", None), ("0/0", None), ("N/A", None), (None, None), ("1/70001", None)])
def test_frame_rates(spark, text, rate):
    got = one(spark, N.parse_frame_rate(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == rate


def test_ticks_and_samples(spark):
    assert one(spark, N.frame_ticks(24000, F.lit(24000), F.lit(1001))) == 30030000
    assert one(spark, N.samples_per_frame(48000, F.lit(24000), F.lit(1001))) == 2002
    assert one(spark, N.samples_per_frame(48000, F.lit(24), F.lit(1))) == 2000
    assert one(spark, N.samples_per_frame(48000, F.lit(30), F.lit(1))) == 1600
    assert one(spark, N.samples_per_frame(44100, F.lit(24000), F.lit(1001))) is None


def test_sizes(spark):
    assert one(spark, N.pcm_bytes(F.lit(10.0), 48000, 2)) == 1_920_000
    assert one(spark, N.adpcm_bytes(F.lit(100.0), 16000, F.lit(24000), F.lit(1001))) == 345 * 2398
    assert one(spark, N.adpcm_bytes(F.lit(100.0), 16000, F.lit(0), F.lit(0))) is None
    assert one(spark, N.pcm_bytes(F.lit(0.0), 48000, 2)) is None


def limited(sample, master, channel, soft):
    wide = sample * master * min(max(channel, 0), 100)
    v = abs(wide) // 10000 * (1 if wide >= 0 else -1)
    if soft and v > 28000:
        v = 28000 + (v - 28000 >> 2)
    elif soft and v < -28000:
        v = -28000 + (v + 28000 >> 2)
    return min(max(v, -32768), 32767)


def test_gain(spark):
    cases = [(s, m, c, soft) for s in (-32768, -20000, -1, 0, 7, 32767) for m in (0, 50, 100, 333) for c in (-5, 33, 100, 120) for soft in (True, False)]
    rows = spark.createDataFrame(cases, "s int, m int, c int, soft boolean").withColumn("got", N.gain(F.col("s"), F.col("m"), F.col("c"), F.col("soft"))).collect()
    assert [r.got for r in rows] == [limited(*r[:4]) for r in rows]


def test_division_rounds_as_said(spark):
    assert one(spark, N.div(F.lit(-7), 2)) == -3
    assert one(spark, N.floor_div(F.lit(-7), 2)) == -4
    assert one(spark, N.ceil_frames(F.lit(7), 2)) == 4
    assert one(spark, N.div(F.lit(7), F.lit(0))) is None


def test_pixels_hashes_and_bytes(spark):
    assert one(spark, N.rgb565(F.lit(200), F.lit(100), F.lit(50))) == 52006
    assert one(spark, N.fnv1a(F.lit("a/b"))) == 0x3A8E75C1
    assert one(spark, N.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, N.le(F.lit(bytes(bytearray((4000000000).to_bytes(4, "little")))), F.lit(0), 4)) == 4000000000
    assert one(spark, N.bitmask(F.array(*(F.lit(b) for b in (True, False, False, True, False, True, True, True))))) == "97"


@pytest.mark.parametrize(
    ("file", "expected"),
    [
        ("Show Name - S01E02 - Title.vid", ("Show Name", 1, 2)), ("Show.Name.S02E10.1080p.vid", ("Show Name", 2, 10)), ("show s03e07.vid", ("show", 3, 7)),
        ("Long Running Show - S12E345.vid", ("Long Running Show", 12, 345)), ("Series Title - S05E01.vid", ("Series Title", 5, 1)),
        ("Just A Movie.vid", None), ("Movie.1920x1080.vid", None), ("S01E02.vid", None), ("", None), (None, None),
    ],
)
def test_series(spark, file, expected):
    got = one(spark, S.series(F.lit(file).cast("string")))
    assert (tuple(got) if got else None) == expected


def test_texts(spark):
    assert one(spark, S.collapse_spaces(F.lit(" a \t\r\n b  "))) == "a b "
    assert one(spark, S.strip_tags(F.lit("a<i>b</i> > c <unclosed"))) == "ab  c "
    assert one(spark, S.label(F.lit(" Chapter | One\n" + "x" * 60))) == ("Chapter / One " + "x" * 60)[:39]
    assert one(spark, S.year(F.lit("from 1799 to 1987 and 2001"))) == 1987
    assert one(spark, S.triplet(F.lit("1, 2,256"), 0, 255)) is None
    assert one(spark, S.triplet(F.lit("1, 2,255"), 0, 255)) == [1, 2, 255]


def test_times(spark):
    assert one(spark, S.parse_seconds(F.lit("1:02:03"))) == 3723.0
    assert one(spark, S.parse_seconds(F.lit(" 2:03 "))) == 123.0
    assert one(spark, S.parse_seconds(F.lit("a:b"))) is None
    assert one(spark, S.parse_cue_time(F.lit("00:01:02,500 --> "))) == 62500
    assert one(spark, S.parse_cue_time(F.lit("00:61:02,500"))) is None
    assert one(spark, S.clock_ms(F.lit(3723004))) == "01:02:03.004"
    assert one(spark, S.clock_short(F.lit(59))) == "00:59"


def test_natural_order(spark):
    names = ["file10", "file2", "File1", "file002b", "a"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["a", "File1", "file2", "file002b", "file10"]
