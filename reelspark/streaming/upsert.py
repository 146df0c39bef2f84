"""A keyed table fed by a stream: the latest row of each key, idempotent by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    """Folders of rows by batch number: each batch writes its own keys only, every EVERY-th one the table up to there.

    A batch that is run again replaces its folder, so the table stays the same. A
    reader takes the newest whole table and the batches behind it.
    """

    EVERY = 32

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def folder(self, n: int) -> str:
        return f"{self.path}/{n:012d}"

    def read(self, n: int) -> DataFrame:
        """The table after batch n."""
        return self.latest(self.spark.read.parquet(*(self.folder(k) for k in range(n - n % self.EVERY, n + 1))))

    def latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys and c not in self.order]
        best = F.max(F.struct(*self.order, *rest)).alias("_best")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "_best.*").select(*rows.columns)

    def apply(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch."""
        rows = batch.unionByName(self.read(n - 1)) if n and n % self.EVERY == 0 else batch
        self.latest(rows).write.mode("overwrite").parquet(self.folder(n))
