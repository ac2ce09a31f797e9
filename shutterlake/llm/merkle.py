"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots, and a proof for every row.

Levels are windows: partitioned by group and parent index, an ordered list over the full frame has the hashes of a run, from
which come the parent's preimage and each node's siblings. Every node stands once in such a list. Leaves move once for a number
of levels: rows are dealt by group and block (fanout ** levels consecutive nodes), which all windows of the block share, so that
no task sees more of a group than some blocks; of a block one row, its top, goes on to the next levels. Proofs come back by
joins of a block's rows with its top, once for that many levels.

Defined results: null fields are hashed as `-`; a null group is a group of its own and comes first; null keys come first in
their group; repeated keys stand in the order of their leaves, and equal rows are told apart by place only. A group of one row
has its leaf as its root; so has a dataset of one group the group's. An empty table gives no rows. Other columns of the input
may have any name. Texts are read once, by the leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .common import table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(field: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value as text."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the encoded fields."""
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def _climbed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes (grp, idx, n, hash and any other) with block, `top` (hash of the node above after those levels) and `steps`, an
    entry (left, right) per level that the group has: the hashes beside the node's ancestor in its run."""
    rows = nodes.withColumn("block", F.expr(f"idx div {fanout**levels}")).repartition("grp", "block").withColumn("top", F.col("hash"))
    steps = []
    for k in range(levels):
        width = fanout**k
        run = Window.partitionBy("grp", "block", F.expr(f"idx div {width * fanout}")).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list(F.when(F.col("idx") % width == 0, F.col("top"))).over(run))
        place, more = F.expr(f"cast(idx div {width} % {fanout} as int)"), F.col("n") > width
        left, right = F.slice("run", F.lit(1), place), F.slice("run", place + 2, F.lit(fanout))
        steps.append(f"step_{k}")
        rows = rows.withColumn(steps[-1], F.when(more, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
        rows = rows.withColumn("top", F.when(more, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("top")))
    return rows.withColumn("steps", F.array_compact(F.array(*steps))).drop("run", *steps)


def _proved(nodes: DataFrame, fanout: int, levels: int, largest: int, above: DataFrame | None = None) -> DataFrame:
    """nodes with `root` of their tree and all `steps` to it. largest: nodes of the largest group. above: (grp, and what every row of the group gets)."""
    size, stages = fanout**levels, [nodes]
    while largest > size:
        tops = _climbed(stages[-1].select("grp", "idx", "n", "hash"), fanout, levels).where(F.col("idx") % size == 0)
        stages.append(written(tops.select("grp", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("hash")), "merkle-level"))
        largest = -(-largest // size)
    proved = _climbed(stages[-1], fanout, levels).withColumnRenamed("top", "root").drop("block")
    for below in reversed(stages[:-1]):
        upper = written(proved.select(F.col("grp").alias("up_grp"), F.col("idx").alias("up_idx"), "root", F.col("steps").alias("up_steps")), "merkle-proof")
        joined = _climbed(below, fanout, levels).join(upper, (F.col("grp") == F.col("up_grp")) & (F.col("block") == F.col("up_idx")))
        proved = joined.withColumn("steps", F.concat("steps", "up_steps")).drop("top", "block", "up_grp", "up_idx", "up_steps")
    return proved


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = 2, levels: int = 6, **carry: Column) -> DataFrame:
    """(key, group, leaf, subroot, root, steps, and the carried columns) per row. steps: (left, right) per level from the leaf to the root.

    carry: further columns over the rows, such as the leaf of another version; they move with the leaf, so keep them small."""
    if fanout < 2 or levels < 1:
        raise ValueError("a run has 2 nodes at least, a block 1 level")
    leaves = written(rows.select(F.col(key).alias("key"), F.col(group).alias("label"), digest(*(F.col(f) for f in fields)).alias("hash"), *(c.alias(f"carry_{n}") for n, c in carry.items())), "merkle-leaves")
    placed = written(positions(leaves, [F.col("label"), F.col("key"), F.col("hash")], "place"), "merkle-places")
    found = written(placed.groupBy("label").agg(F.min("place").alias("first"), F.count("*").alias("n")), "merkle-groups")
    groups = written(positions(found, [F.col("label")], "grp"), "merkle-groups")
    size = groups.agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()  # two numbers
    names = groups.select(F.col("label").alias("named"), "first", "n", "grp")
    nodes = placed.join(names, F.col("label").eqNullSafe(F.col("named"))).withColumn("idx", F.col("place") - F.col("first")).drop("named", "first", "place")
    inner = written(_proved(written(nodes, "merkle-nodes"), fanout, levels, size.largest or 0), "merkle-rows")
    subroots = inner.where("idx = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("idx"), F.lit(size.groups).cast("long").alias("n"), F.col("root").alias("hash"))
    outer = written(_proved(written(subroots, "merkle-subroots"), fanout, levels, size.groups), "merkle-root").select(F.col("idx").alias("of"), F.col("root").alias("all"), F.col("steps").alias("last"))
    whole = inner.join(outer, F.col("grp") == F.col("of"))
    return whole.select(F.col("key").alias(key), F.col("label").alias(group), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("all").alias("root"), F.concat("steps", "last").alias("steps"), *(F.col(f"carry_{n}").alias(n) for n in carry))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_text(steps: Column) -> Column:
    """The siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and proofs of documents by language, and whether rows of which some are changed still fold to the root."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit, digest(*(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS)))
    rows = manifest(docs, changed=changed).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
