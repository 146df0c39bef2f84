"""Joins that are more than an equality: as-of, interval, positional, diffs, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, points: DataFrame, by: list[str], order: str, carry: list[str], tie: str, cell: int | None = None) -> DataFrame:
    """Each probe with carry's values of the last point at or before it (of the same by).

    Both sides become one sorted stream for each key: one exchange, no pairs. Of
    points at the same place the largest tie counts. With a cell, a key's stream
    is cut into cells of that width, which different tasks sort; what comes from
    before a cell is the last point of the cells before, of which a key has one
    row each.
    """
    columns = probes.columns
    left = probes.select(*columns, F.lit(1).alias("_side"), F.lit(None).alias("_tie"), *(F.lit(None).cast(points.schema[c].dataType).alias(f"_{c}") for c in carry), F.lit(None).cast("boolean").alias("_is"))
    right = points.select(
        *(F.col(c) if c in by or c == order else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in columns),
        F.lit(0).alias("_side"), F.col(tie).alias("_tie"), *(F.col(c).alias(f"_{c}") for c in carry), F.lit(True).alias("_is"),
    )
    packed = F.when(F.col("_is"), F.struct(*(F.col(f"_{c}").alias(c) for c in carry)))
    both = left.unionByName(right)
    if cell is None:
        keys, found = list(by), F.col("_found")
    else:
        both = both.withColumn("_cell", F.floor(F.col(order) / cell).cast("long"))
        keys = [*by, "_cell"]
        latest = both.groupBy(*keys).agg(F.max(F.when(F.col("_is"), F.struct(order, "_tie", *(f"_{c}" for c in carry)))).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        earlier = latest.select(*keys, F.last("_last", ignorenulls=True).over(before).alias("_before"))
        renamed = earlier.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)), "_before")
        same = F.lit(True)
        for k, c in enumerate(keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
        found = F.coalesce("_found", F.when(F.col("_before").isNotNull(), F.struct(*(F.col("_before")[f"_{c}"].alias(c) for c in carry))))
    w = Window.partitionBy(*keys).orderBy(order, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_found", F.last(packed, ignorenulls=True).over(w)).where("_side = 1")
    if cell is not None:
        seen = seen.join(renamed, same, "left")
    return seen.withColumn("_found", found).select(*columns, *(F.col("_found")[c].alias(f"point_{c}") for c in carry))


def interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, pick: list[str], cell: int) -> DataFrame:
    """Each point with pick's values of the first span (by start, then pick) with start <= at < end, nulls if there is none.

    Time is cut into cells of cell * 2 ** level, and a span goes to the least level
    whose cells are as long as it, so to two cells at most. A point goes to its cell
    of each level that spans have (counted first), and they meet by equality: no side is
    compared with all of the other, and a long span costs no more than a short one.
    """
    down = lambda c, level: F.floor(c / (F.lit(cell) * F.pow(F.lit(2.0), level))).cast("long")
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(cell))).cast("int"))
    real = spans.where(length > 0).withColumn("_level", level)
    cells = real.withColumn("_cell", F.explode(F.sequence(down(F.col(start), F.col("_level")), down(F.col(end) - 1, F.col("_level")))))
    right = cells.select(*(F.col(c).alias(f"_{c}") for c in dict.fromkeys([*by, start, end, *pick])), "_cell", "_level")
    levels = [r[0] for r in real.select("_level").distinct().collect()] or [0]  # 63 at most
    left = points.withColumn("_own_level", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumn("_own", down(F.col(at), F.col("_own_level")))
    same = (F.col("_own") == F.col("_cell")) & (F.col("_own_level") == F.col("_level"))
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = left.join(right, same & (F.col(f"_{start}") <= F.col(at)) & (F.col(at) < F.col(f"_{end}")), "left")
    first = F.min(F.when(F.col("_cell").isNotNull(), F.struct(F.col(f"_{start}"), *(F.col(f"_{c}") for c in pick)))).alias("_first")
    return joined.groupBy(*points.columns).agg(first).select(*points.columns, *(F.col("_first")[f"_{c}"].alias(f"span_{c}") for c in pick))


def positional(video: DataFrame, audio: DataFrame, on: str, fill: dict[str, Column]) -> DataFrame:
    """Every video row with the audio of its position; missing audio is filled, audio beyond the video cut."""
    out = video.join(audio, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def difference(left: DataFrame, right: DataFrame, on: list[str], compare: list[str]) -> DataFrame:
    """on, status: rows that are missing on a side or differ in a compared column."""
    a = left.select(*on, F.struct(*compare).alias("_a"))
    b = right.select(*on, F.struct(*compare).alias("_b"))
    both = a.join(b, on, "full_outer")
    status = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*on, status.alias("status")).where("status IS NOT NULL")


def plan_status(planned: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """key, status of planned rows (added, changed, unchanged) and of existing ones that are not planned (removed)."""
    p = planned.select(key, F.col(content).alias("_new"), F.lit(True).alias("_p"))
    e = existing.select(key, F.col(content).alias("_old"), F.lit(True).alias("_e"))
    status = F.when(F.col("_p").isNull(), "removed").when(F.col("_e").isNull(), "added").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return p.join(e, key, "full_outer").select(key, status.alias("status"))


def first_owner(df: DataFrame, content: str, order: str) -> DataFrame:
    """All rows with `owner`: the first row (by order) with the same content; null content owns itself.

    The owners are a combining aggregate joined back, so equal contents are not
    gathered into one window.
    """
    owners = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(order).alias("owner"))
    return df.join(owners, content, "left").withColumn("owner", F.coalesce("owner", order))


def tiered(asked: DataFrame, tiers: list[DataFrame], key: str, value: str, same: Column) -> DataFrame:
    """asked with the value of the first tier that knows the key and whose identity check holds, and that tier's number."""
    out, found, tier = asked, F.lit(None), F.lit(None).cast("int")
    for k, table in enumerate(tiers):
        out = out.join(table.select(F.col(key).alias(f"_k{k}"), F.struct(*table.columns).alias(f"_t{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    values = [F.when(same(F.col(f"_t{k}")), F.col(f"_t{k}")[value]) for k in range(len(tiers))]
    found = F.coalesce(*values)
    for k in reversed(range(len(tiers))):
        tier = F.when(values[k].isNotNull(), k + 1).otherwise(tier)
    return out.select(*asked.columns, found.alias(value), tier.alias("tier"))
