"""Connected components of a table of links, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("_a"), F.least("a", "m").alias("m")), "cc-large")
    moved = both.filter("b > a").join(least, F.col("a") == F.col("_a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. Edges have a > b."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a"), "cc-small")
    moved = edges.join(least, F.col("a") == F.col("_a")).filter("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("_a").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node.

    Each round is two joins over the table of links; rounds grow with the logarithm of
    the longest chain. Nothing but a count and a checksum comes to the driver. A node
    with many links has them split by the adaptive skew join; minima are combined
    before the shuffle.
    """
    edges = stored(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")

    def state(df: DataFrame):
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(h % 998_244_353)).first())
    seen = state(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)), "cc-round")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select("b", F.col("b").alias("component")).distinct().toDF("node", "component"))
