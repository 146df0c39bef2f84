"""Exact timing, rational, audio and pixel arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks a second, the largest part of a stored frame rate, and the soft limiter's knee.
TICKS, MAX_PART, KNEE = 30000, 65535, 28000
#: Fixed values of the audio packet estimate: header bytes, first sample's bytes, bits of each further sample.
PACKET_HEADER, FIRST_SAMPLE, SAMPLE_BITS = 10, 2, 4


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """Integer division that truncates towards zero; null if b is 0."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def floor_div(a, b) -> Column:
    """Integer division that rounds down."""
    q, a, b = div(a, b), _c(a).cast("long"), _c(b).cast("long")
    return q - F.when((q * b != a) & ((a < 0) != (b < 0)), 1).otherwise(0)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def gcd(a, b) -> Column:
    """Greatest common divisor of two non-negative numbers below 2^31: eight steps, and the 38 more that there can be only where those do not do."""
    start = F.struct(_c(a).cast("long").alias("a"), _c(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    steps = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)
    return let(steps(start, 8), lambda s: F.when(s["b"] == 0, s["a"]).otherwise(steps(s, 38)["a"]))


def parse_frame_rate(text: Column) -> Column:
    """Struct (num, den) of "a" or "a/b", reduced; null for decimals, zeros and parts too large to store."""
    shape = r"^\s*(\d{1,9})(?:/(\d{1,9}))?\s*$"
    num = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).cast("long")
    den = F.coalesce(F.nullif(F.regexp_extract(text, shape, 2), F.lit("")).cast("long"), F.lit(1).cast("long"))

    def reduced(p: Column) -> Column:
        by = F.when(p["den"] == 1, F.lit(1).cast("long")).otherwise(gcd(p["num"], p["den"]))
        rate = let(by, lambda g: F.struct(div(p["num"], g).alias("num"), div(p["den"], g).alias("den")))
        return let(rate, lambda r: F.when((r["num"] <= MAX_PART) & (r["den"] <= MAX_PART), r))

    return let(F.struct(num.alias("num"), den.alias("den")), lambda p: F.when((p["num"] > 0) & (p["den"] > 0), reduced(p)))


def frame_ticks(frame, num, den) -> Column:
    return div(_c(frame).cast("long") * TICKS * _c(den), num)


def samples_per_frame(rate, num, den) -> Column:
    """Null unless samples divide exactly into 1 to 65535 a frame."""
    total = _c(rate).cast("long") * _c(den)
    return F.when((total % _c(num) == 0) & div(total, num).between(1, MAX_PART), div(total, num))


def ceil_frames(num, den) -> Column:
    return -floor_div(-_c(num).cast("long"), den)


def clamp(x, low, high) -> Column:
    """Null stays null, which least and greatest would pass over."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), _c(low)), _c(high)))


def gain(sample, master, channel, limiter) -> Column:
    """A sample after master and channel per cent, soft knee on request, saturated to 16 bits."""
    v = div(_c(sample).cast("long") * _c(master) * clamp(channel, 0, 100), 10000)
    bent = F.when(v > KNEE, KNEE + F.shiftright(v - KNEE, 2)).when(v < -KNEE, -KNEE + F.shiftright(v + KNEE, 2)).otherwise(v)
    return clamp(F.when(_c(limiter), bent).otherwise(v), -32768, 32767)


def aspect_fit(num, den, width: int, height: int) -> Column:
    """Struct (w, h, x, y): the largest even box of the aspect num/den in a canvas, centred on even offsets."""
    wide = _c(num).cast("long") * height >= _c(den).cast("long") * width
    w = F.when(wide, width).otherwise(div(_c(num).cast("long") * height, den))
    h = F.when(wide, div(_c(den).cast("long") * width, num)).otherwise(height)
    w, h = (F.greatest(F.lit(2).cast("long"), v - v % 2) for v in (w, h))
    x, y = div(width - w, 2), div(height - h, 2)
    return F.struct(w.alias("w"), h.alias("h"), (x - x % 2).alias("x"), (y - y % 2).alias("y"))


def rgb565(r, g, b) -> Column:
    return F.shiftleft(F.shiftright(_c(r).cast("int"), 3), 11).bitwiseOR(F.shiftleft(F.shiftright(_c(g).cast("int"), 2), 5)).bitwiseOR(F.shiftright(_c(b).cast("int"), 3))


def luma(r, g, b) -> Column:
    return F.shiftright(_c(r).cast("int") * 54 + _c(g).cast("int") * 183 + _c(b).cast("int") * 19, 8)


def bitmask(bits: Column) -> Column:
    """An array of booleans as hexadecimal digits, first element in the highest bit; length a multiple of 4."""
    number = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc * 2 + x.cast("int"))
    nibbles = F.transform(F.sequence(F.lit(0), div(F.size(bits), 4).cast("int") - 1), lambda k: F.lower(F.hex(number(F.slice(bits, k * 4 + 1, 4)))))
    return F.array_join(nibbles, "")


def pcm_bytes(seconds, rate, channels) -> Column:
    """Null unless the duration is known and positive."""
    return F.when(_c(seconds) > 0, F.bround(_c(seconds) * _c(rate)).cast("long") * F.greatest(_c(channels), F.lit(1)) * 2)


def adpcm_bytes(seconds, rate, num, den) -> Column:
    """Packets of a frame each; null without duration or frame rate."""
    known = (_c(seconds) > 0) & (_c(num) > 0) & (_c(den) > 0)
    per = F.bround(_c(rate).cast("double") * _c(den) / F.nullif(_c(num), F.lit(0))).cast("long")
    frames = F.greatest(F.lit(1).cast("long"), F.bround(_c(seconds) * _c(num) / F.nullif(_c(den), F.lit(0))).cast("long"))
    packet = PACKET_HEADER + FIRST_SAMPLE + div(F.greatest(F.lit(0).cast("long"), per - 1) * SAMPLE_BITS + 7, 8)
    return F.when(known & (per > 0), frames * packet)


def eta(current, total, speed) -> Column:
    """Seconds left; null unless total and speed are known and positive."""
    return F.when((_c(total) > 0) & (_c(speed) > 0), (_c(total) - F.least(_c(current), _c(total))) / _c(speed))


def percent(current, total) -> Column:
    return F.when(_c(total) > 0, clamp(_c(current) * 100.0 / _c(total), 0.0, 100.0))


def smoke_window(duration, wanted: int) -> Column:
    """Struct (start, length) in seconds: a minute in if the source is long enough, else the middle."""
    length = F.least(F.lit(wanted).cast("long"), F.greatest(F.lit(1).cast("long"), _c(duration).cast("long")))
    start = F.when(_c(duration) >= length + 120, F.lit(60.0)).otherwise(F.greatest(F.lit(0.0), (_c(duration) - length) / 2))
    return F.struct(start.cast("double").alias("start"), length.alias("length"))


def le(data: Column, offset, size: int) -> Column:
    """An unsigned little-endian number of 1 to 7 bytes (or 8 with the top bit clear) at a byte offset."""
    digits = F.concat(*(F.hex(F.substring(data, _c(offset) + k + 1, F.lit(1))) for k in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes."""
    digits = F.hex(F.encode(text, "utf-8"))
    byte = lambda k: F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("long")
    places = F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda k: k > 0)
    return F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, k: (h.bitwiseXOR(byte(k)) * 16777619).bitwiseAND(F.lit(4294967295)))


def round_div(a, b) -> Column:
    """Integer division to the nearest, halves away from zero; 0 where b is not positive."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    size = div(F.abs(a) + div(b, 2), b)
    return F.when(b > 0, F.when(a >= 0, size).otherwise(-size)).otherwise(0)


def yuv565(y, u, v) -> Column:
    """A video-range YUV sample as a packed 16-bit colour, by the usual integer weights."""
    base, u, v = (_c(y).cast("int") - 16) * 298 + 128, _c(u).cast("int") - 128, _c(v).cast("int") - 128
    parts = (base + v * 409, base - u * 100 - v * 208, base + u * 516)
    return rgb565(*(clamp(F.shiftright(p, 8), 0, 255) for p in parts))
