"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed: each step is a min per node (combined before the shuffle)
and an equi-join, whose hub nodes adaptive execution splits. Every round is cut by
a checkpoint, so a lost executor costs at most that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node that has a lesser one has just that, and it has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("root").alias("root"))
    return held.where("below > 1 or below = 1 and root = 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long); root is the least node reachable.

    Self links, repeated links and nulls are ignored; nodes without a link to another node
    are not in the result. An empty table gives an empty result.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
