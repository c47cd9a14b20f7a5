"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the node's least neighbour; repeats go in the small star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return near.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is a root or hangs on one root, once."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("all")).where("below > 1 or (below = 1 and all > 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b), longs, in any order and number -> (node, root), one row a linked node; root is the least node reachable.

    The rounds' number grows with the logarithm of the longest path. Nothing but whether a round
    was the last comes to the driver, and every table is checkpointed in the shared folder.
    """
    edges = settled(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _stars(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = settled(_small_star(_large_star(edges)))
    raise RuntimeError("components did not settle")
