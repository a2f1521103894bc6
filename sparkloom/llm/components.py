"""Connected components by alternating large and small stars (Kiveris et al., Connected Components in MapReduce and Beyond)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import forget, written


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with u's least neighbour m. Both sides are written tables, so that a star's centre can be split over tasks."""
    return edges.join(least, "u")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each a has one edge, and no b is an a."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("child")))
    return ends.groupBy("u").agg(F.sum("child").alias("n"), F.min("child").alias("least")).where("n > 1 or n > least").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it reaches, for every node of edges (a, b).

    Self-loops and repeated edges change nothing; no edges give no rows. Each round is a few joins and sums over
    written tables, so lineage stays short; rounds grow with the logarithm of the nodes, and stars need none.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(stars):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(_hung(both, near).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = _hung(large, least).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        old, stars = stars, written(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        forget(old, near, large, least)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
