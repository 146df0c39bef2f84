"""Lenient parsers and formatters of labels, times, names and logs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.numbers import div

LABEL_CHARS, CUE_CHARS, PREVIEW = 39, 192, 19


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Runs of space, tab and line ends become one space; a leading one goes, a trailing one stays."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), "^ ", "")


def preview(c: Column) -> Column:
    """Struct (line1, line2, truncated) of two lines of PREVIEW characters."""
    return F.struct(F.substring(c, 1, PREVIEW).alias("line1"), F.substring(c, PREVIEW + 1, PREVIEW).alias("line2"), (F.length(c) > 2 * PREVIEW).alias("truncated"))


#: Fixed value: what counts as a year.
YEAR = r"(1[89]\d{2}|20\d{2})"


def year(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, YEAR, 1)).cast("long")


def series(c: Column) -> Column:
    """Struct (series, season, episode) of the first SxxEyy behind a name; null if there is none."""
    # a season or episode has 1 to 4 digits; without a name before it a match does not count
    shape = r"(?i)^(.*?)s(\d{1,4})e(\d{1,4})"
    name = F.rtrim(F.regexp_extract(c, shape, 1), F.lit(" .-_"))
    season, episode = (null_if_empty(F.regexp_extract(c, shape, k)).cast("long") for k in (2, 3))
    return F.when(season.isNotNull() & (name != ""), F.struct(F.translate(name, "._", "  ").alias("series"), season.alias("season"), episode.alias("episode")))


def strip_tags(c: Column, most: int = CUE_CHARS) -> Column:
    """Without <...>; an unclosed one takes the rest, a stray > goes; cut to most characters."""
    return F.substring(F.regexp_replace(c, r"<[^>]*>|<[^>]*$|>", ""), 1, most)


def label(c: Column) -> Column:
    return F.substring(F.trim(F.translate(c, "|\r\n", "/  ")), 1, LABEL_CHARS)


def triplet(c: Column, low: int, high: int) -> Column:
    """Array of three whole numbers in range, or null."""
    shape = r"^\s*(-?\d{1,6})\s*,\s*(-?\d{1,6})\s*,\s*(-?\d{1,6})\s*$"
    parts = [null_if_empty(F.regexp_extract(c, shape, k)).cast("int") for k in (1, 2, 3)]
    good = parts[0].isNotNull()
    for p in parts:
        good = good & p.between(low, high)
    return F.when(good, F.array(*parts))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def with_extension(c: Column, extension: str) -> Column:
    """The path with its file's extension replaced, or added where there is none."""
    return F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(extension))


def natural_key(c: Column, width: int = 20) -> Column:
    """A key whose order is that of the text with runs of digits compared as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0")).otherwise(p)), "")


def parse_seconds(c: Column) -> Column:
    """H:M:S, M:S or seconds; null for anything else."""
    parts = F.split(F.trim(c), ":")
    whole = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    three = whole(0) * 3600 + whole(1) * 60 + whole(2)
    two = whole(0) * 60 + whole(1)
    n = F.size(parts)
    return F.when(n == 3, three.cast("double")).when(n == 2, two.cast("double")).when(n == 1, F.get(parts, F.lit(0)).try_cast("double"))


def parse_cue_time(c: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm (or a point) at the start of a text; null unless minutes and seconds are under 60."""
    shape = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
    h, m, s, ms = (null_if_empty(F.regexp_extract(c, shape, k)).cast("long") for k in range(1, 5))
    return F.when((m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + ms)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock_short(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; whole seconds."""
    h, m, s = div(seconds, 3600), div(seconds, 60) % 60, seconds.cast("long") % 60
    return F.when(h > 0, F.concat_ws(":", _two(h), _two(m), _two(s))).otherwise(F.concat_ws(":", _two(m), _two(s)))


def clock_ms(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    h, m, s = div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60
    return F.concat(F.concat_ws(":", _two(h), _two(m), _two(s)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def clock_hour(ms: Column) -> Column:
    """H:MM:SS of milliseconds, to the nearest second and halves to even."""
    total = F.bround(ms / 1000.0).cast("long")
    return F.concat_ws(":", div(total, 3600).cast("string"), _two(div(total, 60) % 60), _two(total % 60))


def key_values(c: Column, prefix: str) -> Column:
    """Map of the k=v tokens of a line that begins with prefix; tokens without = are skipped."""
    rest = F.substring(c, F.lit(len(prefix) + 1), F.length(c))
    tokens = F.filter(F.split(rest, " "), lambda t: t.rlike(r"^[^=]+=[^=]*$"))
    pairs = F.transform(tokens, lambda t: F.struct(F.split_part(t, F.lit("="), F.lit(1)).alias("key"), F.split_part(t, F.lit("="), F.lit(2)).alias("value")))
    return F.when(c.startswith(prefix), F.map_from_entries(pairs))
