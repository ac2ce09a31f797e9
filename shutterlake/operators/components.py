"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_path, write


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, or to itself where it is the least."""
    both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(links.select("u", "v"))
    least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    return links.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which has none itself."""
    ends = links.select(F.col("u").alias("node"), "v").union(links.select("v", F.lit(None)))
    nodes = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v").isNull()).alias("above"))
    return nodes.where("lo < hi OR (lo IS NOT NULL AND above > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another: component is the smallest node reachable.

    Alternating large and small stars: each round links nodes to smaller ones without adding links, until every node
    hangs on the least of its component. The number of rounds grows with the square of the logarithm of the longest path
    at most (14 for a path of 5,000 nodes, 17 for one of 50,000), and there is no limit to it. A round is partial
    aggregations and joins on nodes, so a hub of any degree is summed before the shuffle and Spark may split its join.
    Rounds are written to the shared folder; of one round, only whether it was the last comes to the driver.
    Edges with a null end and loops are left out."""
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    folder, turn = shared_path(spark, "components"), 0
    links = write(ends, f"{folder}/0")
    while not _settled(links):
        turn += 1
        links = write(_small_star(_large_star(links)), f"{folder}/{turn}")
        remove(spark, f"{folder}/{turn - 1}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
