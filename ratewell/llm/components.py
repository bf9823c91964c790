"""Connected components of a graph of any size, by alternating stars.

Each round links every neighbour of a node to the node's least neighbour, first among the larger ones, then among the
smaller ones, until the edges are stars around the least node of each component. Rounds grow with the logarithm of the
longest chain. A hub is read with partial aggregation and joined by a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import discard, settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, its component's least node, for every node of the edges (a, b) that is not a root itself.

    Loops and repeated edges are allowed; an empty table gives no rows. Nulls must be left out before.
    """
    stars = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        before, stars = stars, settle(_small(_large(stars)), "stars")
        discard(before)
        mark = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
