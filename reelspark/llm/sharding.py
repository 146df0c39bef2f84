"""Sharding into contiguous shards of nearly equal bytes, by global prefix sums.

Law `bytes`: rows stand in ascending doc_id order, a row's size is its text's
UTF-8 bytes plus 1, and a row goes to the shard in whose share of the total the
bytes before it fall. DataFrame operations only, and texts are never shuffled:

1. rows shrink to (doc_id, size, checksum) where they are read and are dealt by
   range, with a row number as the last key so that equal rows part as well;
2. that narrow table is checkpointed with the number of its partition, so that
   all later steps see one dealing;
3. the totals of the partitions (a row each) give the bytes and rows before each
   partition, and a window within each partition the rest.

Defined cases: null texts have size 1 and checksum 0; null doc_ids come first;
rows with equal doc_id are ordered by checksum, those equal in all are
interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.session import cut

SHARDS = 16
ROWS_PER_PARTITION, LEAST_PARTITIONS = 250_000, 64


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null: the law moves rows when shards are added)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = max(LEAST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.select("doc_id").count() // ROWS_PER_PARTITION))
    order = ["doc_id", "text_crc32", "row"]
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    # one row for each partition: as many as `parts`, whatever the rows
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        dealt.withColumn("to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.row_number().over(inside) - 1)
        .join(totals, "part")
        .withColumn("begin", F.col("bytes_before") + F.col("to") - F.col("size"))
        .withColumn("number", F.col("rows_before") + F.col("number"))
        .withColumn("shard", F.expr(f"cast(begin * {shards} div total as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("number") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
