"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and nodes that are one have none."""
    ends = edges.groupBy("a").agg(F.count("*").alias("n"))
    more = ends.filter("n > 1").select("a").unionByName(edges.select(F.col("b").alias("a")).join(ends, "a", "left_semi"))
    return more.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(a bigint, b bigint) to (node bigint, root bigint): the smallest node reachable, for nodes with links.

    Large-star and small-star steps alternate until only stars are left; each writes its edges to the shared folder,
    so a lost executor repeats one step. Edges never exceed the number of links and never reach the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        around = both(edges)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every larger neighbour of a node is linked to the node's smallest neighbour
        large = around.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        # every smaller neighbour of a node, and the node itself, is linked to its smallest one
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(small)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
