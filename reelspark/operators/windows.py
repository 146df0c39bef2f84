"""Ordered analytics within keys: offsets, continuity, islands, smoothing, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, by: list[str], order: list, size: str) -> DataFrame:
    """begin and end of each row: the sizes before it, and with it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(size).over(w)).withColumn("begin", F.col("end") - F.col(size))


def breaks(df: DataFrame, by: list[str], order: list, begin: str, end: str) -> DataFrame:
    """gap: begin less the previous row's end (null for a key's first row), and ok."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = F.col(begin) - F.lag(end).over(w)
    return df.withColumn("gap", gap).withColumn("ok", F.coalesce(gap == 0, F.lit(True)) & (F.col(end) > F.col(begin)))


def sequence_gaps(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """A row for each key: rows, first and whether order goes up by exactly 1."""
    w = Window.partitionBy(*by).orderBy(order)
    step = df.withColumn("_step", F.col(order) - F.lag(order).over(w))
    return step.groupBy(*by).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.coalesce(F.bool_and(F.col("_step") == 1), F.lit(True)).alias("contiguous"))


def runs(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """by, value, length, number of each run of equal values in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    marked = df.withColumn("number", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "number", value).agg(F.count("*").alias("length"))


def fill_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """name: the last value that is not null up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def _by_cell(df: DataFrame, by: list[str], cell: Column) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_cell", cell), [*by, "_cell"]


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with other's further columns, by keys that may be null."""
    renamed = other.withColumnsRenamed({k: f"_o{n}" for n, k in enumerate(keys)})
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{n}"))
    return df.join(renamed, same).drop(*(f"_o{n}" for n in range(len(keys))))


def numbered(df: DataFrame, by: list[str], order: list, cell: Column, name: str, total: str | None = None) -> DataFrame:
    """name: each row's place from 1 within by; total: how many rows by has.

    For keys of few values, whose rows would all be sorted in one task: cell cuts
    each key's order into pieces (it must not fall along the order), which are
    numbered by themselves; what comes before a piece is the sum of its
    predecessors' counts, of which there is one row each.
    """
    rows, keys = _by_cell(df, by, cell)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by)
    before = F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.withColumn("_before", before)
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(own))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = _joined(rows.withColumn("_inside", inside), counts.drop("_n"), keys)
    return placed.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_cell", "_inside", "_before")


def previous(df: DataFrame, by: list[str], order: str, value: str, cell: Column, name: str) -> DataFrame:
    """name: the value of the row before, null for a key's first; cut into cells as in numbered, and a cell's first row takes the last of the cell before."""
    rows, keys = _by_cell(df, by, cell)
    ends = rows.groupBy(*keys).agg(F.max_by(F.struct(value), order).alias("_last"))
    ends = ends.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*by).orderBy("_cell"))).drop("_last")
    inside = F.lag(F.struct(value)).over(Window.partitionBy(*keys).orderBy(order))
    both = _joined(rows.withColumn("_inside", inside), ends, keys)
    return both.withColumn(name, F.coalesce("_inside", "_edge")[value]).drop("_cell", "_inside", "_edge")


def smoothed(df: DataFrame, by: list[str], order: list[str], value: str, weight: float = 0.25) -> DataFrame:
    """by, n, ema: weight * x + (1 - weight) * before over a key's positive values in order; the first one seeds.

    Written out, the k-th value from the end counts weight * (1 - weight) ** k, the
    seed (1 - weight) ** k: a sum over a sorted window, which spills, and no array.
    """
    valid = F.coalesce(F.col(value) > 0, F.lit(False))
    newest = Window.partitionBy(*by).orderBy(F.col("_valid").desc(), *(F.col(c).desc() for c in order))
    rows = df.withColumn("_valid", valid)
    rows = rows.withColumn("_k", F.row_number().over(newest) - 1).withColumn("_seed", ~F.coalesce(F.lead("_valid").over(newest), F.lit(False)))
    share = F.pow(F.lit(1 - weight), F.col("_k")) * F.when(F.col("_seed"), 1.0).otherwise(weight)
    return rows.groupBy(*by).agg(F.count(F.when(F.col("_valid"), 1)).alias("n"), F.sum(F.when(F.col("_valid"), share * F.col(value))).alias("ema"))


def until_misses(df: DataFrame, by: list[str], order: list, found: Column, limit: int) -> DataFrame:
    """Rows of a scan that stops after limit misses in a row once something was found; the stopping miss is the last row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = df.withColumn("_hit", found).withColumn("_hits", F.sum(F.col("_hit").cast("long")).over(w))
    own = Window.partitionBy(*by, "_hits").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    missed = hit.withColumn("_missed", F.when(F.col("_hits") > 0, F.sum((~F.col("_hit")).cast("long")).over(own)).otherwise(0))
    stopped = missed.withColumn("_stopped", F.max((F.col("_missed") >= limit).cast("int")).over(w) - (F.col("_missed") == limit).cast("int"))
    first = stopped.withColumn("_stops", F.sum((F.col("_missed") == limit).cast("long")).over(w))
    return first.where("_stops = 0 OR (_stops = 1 AND _missed = " + str(limit) + ")").select(*df.columns)


def cues(lines: DataFrame, by: list[str], order: str, starts: Column, ends: Column, text: str) -> DataFrame:
    """by, cue, text of each block of lines from a starting line up to a blank one or the next start."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_start", starts).withColumn("cue", F.sum(F.col("_start").cast("long")).over(w))
    own = Window.partitionBy(*by, "cue").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    live = marked.withColumn("_over", F.sum(ends.cast("long")).over(own)).where((F.col("cue") > 0) & (F.col("_over") == 0) & ~F.col("_start"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    return live.groupBy(*by, "cue").agg(joined.alias("text"))
