"""Connected components of a graph given as edges, by alternating star operations.

Each round makes every node point at the smallest neighbour it knows (large star
over all neighbours, small star over the smaller ones), so paths shrink by half
and the graph ends as one star for each component. Edges are checkpointed in the
shared folder after each round; nothing but two sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import cut


def _least(pairs: DataFrame) -> DataFrame:
    """The smallest v of each u; dealt anew, so that a join with hubs in pairs can be split."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    found = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return found.distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(down)
    found = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return found.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """a (node), b (the smallest node of its component) for all nodes of edges(a, b) but the smallest ones themselves."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == state:
            return edges
        state = tuple(now)
        edges = cut(_small(_large(edges)))
