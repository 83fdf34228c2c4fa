"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots; root is the least node of the component.

    Aggregates are minima only, so that a hot node never gathers its neighbours in one task. A round ends in a stored table; the
    rounds end when every edge points at a root, about log2 of the longest path.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = store(_small_star(_large_star(now).distinct()).where("u <> v").distinct())
        forget(now)
        now = after
        # done when no target of an edge is itself a source, and each source has one target
        chained = now.select(F.col("v").alias("u")).distinct().join(now.select("u").distinct(), "u", "left_semi")
        double = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not chained.union(double.select("u")).take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
