"""Trees given as a table of nodes and their parents, closed by pointer doubling.

In round k every node knows its ancestor 2 ** k steps up. It hands what it has gathered from below to that ancestor, takes from
it what that one has gathered from above, and points to the ancestor's ancestor. A tree of depth d is so closed in log2(d) + 1
rounds, of a shuffle join and a partial aggregation each, however deep, wide or lopsided it is; nothing holds a whole path.
Rounds are written to the shared folder; of one round, only the number of nodes that still point somewhere comes to the driver.
Where that number stays as it was, the nodes left lead into a cycle (a tree node that far down would have had an ancestor that
has just arrived); they stand for themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path, write
from .ordering import running

#: What two values from below make, and how many of them are gathered.
MERGES: dict[str, tuple[Callable[[str], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def _jump(now: DataFrame, below: Mapping[str, str], above: Mapping[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """now a round later, with `done`: the node points nowhere and nobody has pointed to it, so nobody will and nobody needs it."""
    live = now.where("up IS NOT NULL")
    ahead = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), *(F.col(n).alias(f"_{n}") for n in above))
    moved = live.join(ahead, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), *below, *(f(F.col(f"_{n}"), F.col(n)).alias(n) for n, f in above.items()))
    rows = moved.unionByName(now.where("up IS NULL"))
    gained = live.groupBy(F.col("up").alias("_to")).agg(F.count("*").alias("_n"), *(MERGES[kind][0](n).alias(f"_{n}") for n, kind in below.items()))
    rows = rows.join(gained, F.col("id") == F.col("_to"), "left")
    return rows.select("id", "up", *(MERGES[kind][1](F.col(n), F.col(f"_{n}")).alias(n) for n, kind in below.items()), *above, (F.col("up").isNull() & F.col("_to").isNull()).alias("done"))


def closed(nodes: DataFrame, below: Mapping[str, str] | None = None, above: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """nodes (id, up, and the named columns) with `loop` instead of up: each column of below (name: "sum" or "min") taken over the node
    and all nodes under it, each column of above (name: function of what is above and what is here) over the way from the root to the node.

    ids must be distinct, and a parent one of them or null. Nodes that lead into a cycle have loop set and their values as they were.
    A node leaves the rounds as soon as it points nowhere and nothing is as far below it as a round reaches, so that a few deep
    branches cost rounds of their own size."""
    spark, below, above = nodes.sparkSession, dict(below or {}), dict(above or {})
    folder, turn, before = shared_path(spark, "tree"), 0, -1
    names = ["id", *below, *above]
    now = first = write(nodes.select("id", "up", *below, *above), f"{folder}/0")
    out = []
    while (left := now.where("up IS NOT NULL").count()) not in (0, before):
        turn, before = turn + 1, left
        both = write(_jump(now, below, above), f"{folder}/{turn}", by="done")
        out.append(both.where("done").select(names))
        now = both.where("NOT done").drop("done")
    done = reduce(DataFrame.unionByName, [*out, now.where("up IS NULL").select(names)]).withColumn("loop", F.lit(False))
    if left:
        done = done.unionByName(first.join(now.where("up IS NOT NULL").select("id"), "id", "left_semi").select(names).withColumn("loop", F.lit(True)))
    return done


def forest(folders: DataFrame, key: str = "folder_id", parent: str = "parent_id") -> DataFrame:
    """(id, up) of every folder once: of repeated ids the smallest parent counts, a parent that is no folder does not."""
    once = folders.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("parent"))
    known = once.select(F.col("id").alias("up"))
    return once.join(known, F.col("parent") == F.col("up"), "left").select("id", "up")


def added(above: Column, here: Column) -> Column:
    return above + here


def outline(nodes: DataFrame) -> DataFrame:
    """nodes (id, up) with depth and `place`, 0-based in a depth-first listing: siblings by id, roots by id, nodes of cycles last, as roots; their `up` is null here.

    A node comes after its parent and all that is under its earlier siblings, so its place is a sum along its way from the root."""
    sized = closed(nodes.withColumn("size", F.lit(1).cast("long")), {"size": "sum"})
    rows = sized.join(nodes, "id").withColumn("up", F.when(~F.col("loop"), F.col("up")))
    rows = running(rows, [F.col("up").asc_nulls_first(), F.col("loop"), F.col("id")], F.col("size"), "before")
    rows = write(rows, shared_path(nodes.sparkSession, "outline"))
    first = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("_up")).agg(F.min("before").alias("_first"))
    inner = rows.where("up IS NOT NULL").join(first, F.col("up") == F.col("_up")).select("id", "up", F.lit(1).cast("long").alias("depth"), (1 + F.col("before") - F.col("_first")).alias("place"))
    roots = rows.where("up IS NULL").select("id", "up", F.lit(0).cast("long").alias("depth"), F.col("before").alias("place"))
    placed = closed(inner.unionByName(roots), above={"depth": added, "place": added}).drop("loop")
    return placed.join(rows.select("id", "up"), "id").select("id", "up", F.col("depth").cast("int").alias("depth"), "place")
