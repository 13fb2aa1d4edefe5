"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import release
from gridcast.session import stage


def _towards(edges: DataFrame, small: bool) -> DataFrame:
    """One step of the star method: link the neighbours of each node to the least of them.

    ``edges`` has a > b. The small step lets a node see its lesser neighbours, the large step all of them; it moves the greater ones.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if small:
        links = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        links = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return links.where("a > b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a > b) is either the root of its edges or has one edge, to its root; one aggregation that counts on the map side."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: any orderable type); the root is the least node it can be reached from.

    Large-star and small-star steps in turn, each an aggregation and a join, until the edges form stars; the number of rounds grows with
    the logarithm of the longest chain, and edges that are stars from the start take none. Only that finding reaches the driver.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _stars(edges):
        done = stage(_towards(_towards(edges, small=False), small=True))
        release(edges)
        edges = done
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
