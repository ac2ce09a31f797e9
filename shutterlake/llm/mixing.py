"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source is cut into blocks of block_docs documents. In the ideal, fluid mix every source that has blocks left
advances at its weight; block j of source i may start (release) when the fluid mix begins it and is due (deadline)
when the fluid mix has finished it, both in whole slots. Earliest deadline first over the released blocks meets
every deadline, as the fluid mix itself shows that all fit, so after any number of slots each source has had within
less than one block of its share. When a source runs out, the others share its slots in proportion to their weights.

Weights are whole numbers, so that all times are exact fractions: given ones in the proportion in which they are written
(as far as their sum stays within SCALE), others, and those by size, rounded to a sum of SCALE, which moves a source by
less than a block in 10^9 slots. A positive weight counts as one unit at least. Sources of weight 0 (and those
that given weights do not name) have no place in the mix: they follow after it, mixed evenly.

EDF goes from slot to slot, so a first pass walks through all slots with nothing but the next block of every source in
hand, and notes these at the start of every stretch of STRETCH slots; the stretches are then worked out on their own,
spread over the cluster. The first pass is one row and one task: a slot is one block, and costs time in proportion to
the number of sources (about 5 microseconds for 20 of them, 0.1 ms for 500), so block_docs should be larger for larger
inputs (10^7 blocks take a minute with 20 sources). It is meant for up to some thousands of sources; for one source per
host it would take too long.

A document's place within its source is a rank by hash of the id, taken in sub-buckets of a few thousand documents
with offsets summed from their counts, so that a source with a third of all rows is not ranked in one task.
Only the id and source move, and what is to be carried along.

Defined results: rows with a null source are a source of their own; null ids rank by an empty id; repeated rows are
each placed; every row is placed exactly once (the last block of a source may be short); an empty table gives an
empty result; other columns are not looked at, whatever their names are. Weights must be finite and not negative.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SCALE, STRETCH, BLOCK_DOCS, RANKED = 1 << 30, 1024, 64, 4096
#: The next block of a source: its window; whether the fluid mix ends it at a whole slot; the source's parts and blocks, and (before, rest)
#: when it runs out; and how many sources have run out when the fluid mix ends the block, with (before, rest) of the last of them.
_NEXT = "array<struct<deadline:bigint,key:int,release:bigint,block:bigint,whole:boolean,parts:bigint,blocks:bigint,before:bigint,rest:bigint,gone:int,past:bigint,left:bigint>>"


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """The weights, read as decimal fractions, as whole numbers: in their exact proportion if these sum to SCALE at most, else rounded to that sum."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    unit = lcm(*(v.denominator for v in exact.values()))
    parts = {k: int(v * unit) for k, v in exact.items()}
    shared, total = gcd(*parts.values()), sum(parts.values())
    if total <= SCALE * max(1, shared):
        return {k: v // max(1, shared) for k, v in parts.items()}
    return {k: max(1, round(Fraction(v * SCALE, total))) if v else 0 for k, v in parts.items()}


def source_parts(docs: DataFrame, weights: dict[str, float] | None, block_docs: int) -> DataFrame:
    """(source, n, blocks, parts, late): parts by the given weights, else in proportion to the square root of the size; late: weight 0."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("share", F.sqrt("n"))
        total = sizes.agg(F.sum("share").alias("total"))
        sizes = sizes.crossJoin(F.broadcast(total)).withColumn("parts", F.greatest(F.lit(1), F.round(F.col("share") / F.col("total") * SCALE)))  # total: one row
    else:
        if any(not 0 <= v < float("inf") for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        share = F.lit(0)
        for k, v in whole_parts(weights).items():
            share = F.when(F.col("source") == k, v).otherwise(share)
        sizes = sizes.withColumn("parts", share)
    parts = F.col("parts").cast("long")
    return sizes.select("source", "n", F.ceil(F.col("n") / block_docs).alias("blocks"), F.greatest(parts, F.lit(1)).cast("long").alias("parts"), (parts == 0).alias("late"))


def _phases(sources: DataFrame) -> DataFrame:
    """One row `all`: the sources in the order in which they run out. Once a source's blocks are gone, `before` blocks of it and the
    earlier ones are done and the others have `rest` parts, so the fluid mix stands at slot before + blocks / parts * rest."""
    gone = Window.orderBy(F.col("blocks") / F.col("parts")).rangeBetween(Window.unboundedPreceding, 0)  # one row per source
    rows = sources.select("key", "parts", "blocks", F.sum("blocks").over(gone).alias("before"), F.sum("parts").over(gone).alias("spent"))
    total = sources.agg(F.sum("parts").alias("sum"), F.sum("blocks").alias("slots"))
    rows = rows.crossJoin(F.broadcast(total))  # total: one row
    one = F.struct((F.col("blocks") / F.col("parts")).alias("at"), "key", "parts", "blocks", "before", (F.col("sum") - F.col("spent")).alias("rest"))
    return rows.groupBy("sum", "slots").agg(F.array_sort(F.collect_list(one)).alias("all"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _job(s: Column, j: Column) -> Column:
    """Block j of a source with its window, s being block j - 1."""

    def run_out(n: Column) -> Column:
        last = F.get("all", n - 1)
        return F.struct(n.alias("gone"), last["before"].alias("past"), last["rest"].alias("left"))

    def gone(x: Column) -> Column:
        return x["blocks"] * s["parts"] <= (j + 1) * x["parts"]

    same = F.struct(s["gone"].alias("gone"), s["past"].alias("past"), s["left"].alias("left"))
    own = F.struct(s["gone"].alias("gone"), s["before"].alias("past"), s["rest"].alias("left"))
    later = F.coalesce(gone(F.get("all", s["gone"])), F.lit(False))
    phase = F.when(j + 1 >= s["blocks"], own).when(later, _let(F.size(F.filter("all", gone)), run_out)).otherwise(same)

    def window(p: Column) -> Column:
        work = (j + 1) * p["left"]
        end, whole = p["past"] + F.call_function("div", work, s["parts"]), work % s["parts"] == 0
        release = s["deadline"] - F.when(s["whole"], 0).otherwise(1)
        kept = (s[c].alias(c) for c in ("parts", "blocks", "before", "rest"))
        return F.struct(F.when(whole, end).otherwise(end + 1).alias("deadline"), s["key"].alias("key"), release.alias("release"), j.alias("block"), whole.alias("whole"), *kept, *(p[c].alias(c) for c in ("gone", "past", "left")))

    return _let(phase, window)


def _pick(ahead: Column, slot: Column) -> Column:
    """Of the next blocks of all sources, the released one that is due first; of equals, that of the first source by name."""
    return F.array_min(F.filter(ahead, lambda x: x["release"] <= slot))


def _without(ahead: Column, pick: Column) -> Column:
    """The next blocks after this one has had its slot."""
    return F.filter(F.transform(ahead, lambda x: F.when(x["key"] == pick["key"], _job(x, x["block"] + 1)).otherwise(x)), lambda x: x["block"] < x["blocks"])


def schedule(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(source, block, slot) of all blocks of (source, blocks, parts)."""
    sources = sources.withColumn("key", F.row_number().over(Window.orderBy("source")))  # one row per source
    one = _phases(sources)

    def until(t: Column) -> Column:
        return F.sequence(t, F.least(t + stretch, F.col("slots")) - 1)

    def walk(state: Column, t: Column) -> Column:
        ahead = F.aggregate(until(t), state["ahead"], lambda a, slot: _let(_pick(a, slot), lambda pick: _without(a, pick)))
        return F.struct(ahead.alias("ahead"), F.concat(state["cuts"], F.array(F.struct(t.alias("t"), state["ahead"].alias("ahead")))).alias("cuts"))

    zero = F.lit(0).cast("long")
    none = {"deadline": zero, "whole": F.lit(True), "gone": F.lit(0), "past": zero, "left": F.col("sum")}
    first = F.transform("all", lambda s: _let(F.struct(*(s[c].alias(c) for c in ("key", "parts", "blocks", "before", "rest")), *(v.alias(c) for c, v in none.items())), lambda x: _job(x, zero))).cast(_NEXT)
    start = F.struct(first.alias("ahead"), F.array().cast(f"array<struct<t:bigint,ahead:{_NEXT}>>").alias("cuts"))
    cuts = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(stretch).cast("long")), start, walk, lambda s: s["cuts"])
    rows = written(one.select(F.inline(cuts)), "mix-cuts").repartition("t")
    rows = rows.crossJoin(F.broadcast(one))  # one row of all sources

    def step(state: Column, slot: Column) -> Column:
        def taken(pick: Column) -> Column:
            done = F.array(F.struct(pick["key"].alias("key"), pick["block"].alias("block")))
            return F.struct(_without(state["ahead"], pick).alias("ahead"), F.concat(state["out"], done).alias("out"))

        return _let(_pick(state["ahead"], slot), taken)

    start = F.struct(F.col("ahead"), F.array().cast("array<struct<key:int,block:bigint>>").alias("out"))
    rows = rows.select("t", F.posexplode(F.aggregate(until(F.col("t")), start, step, lambda s: s["out"])).alias("at", "job"))
    rows = rows.select(F.col("job.key").alias("key"), F.col("job.block").alias("block"), (F.col("t") + F.col("at")).alias("slot"))
    return rows.join(sources.select("key", "source"), "key").select("source", "block", "slot")


def places(docs: DataFrame, sources: DataFrame, block_docs: int) -> DataFrame:
    """docs (id, source and any others) with block and rank."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    buckets = sources.select("source", F.ceil(F.col("n") / RANKED).alias("buckets"))
    rows = docs.join(buckets, "source").withColumn("h", number).withColumn("sub", F.col("h") % F.col("buckets"))
    counts = rows.groupBy("source", "sub").agg(F.count("*").alias("k"))
    before = counts.select("source", "sub", (F.sum("k").over(Window.partitionBy("source").orderBy("sub")) - F.col("k")).alias("before"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source", "sub").orderBy("h", F.col("id").asc_nulls_first())) - 1)
    at = F.col("before") + F.col("rn")
    return ranked.join(before, ["source", "sub"]).select(*docs.columns, F.floor(at / block_docs).alias("block"), (at % block_docs).alias("rank"))


_NULL = "\x00null"


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, the carried columns, block, slot, rank, position): position orders the mix; slot is the block's place in it."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)).alias("source"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)))
    sources = written(source_parts(rows.select("source"), weights, block_docs), "mix-sources")
    first = sources.where("NOT late")
    plan = written(schedule(first), "mix-schedule")
    if weights is not None:  # what has no weight follows
        ahead = first.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("ahead"))
        late = schedule(sources.where("late")).crossJoin(F.broadcast(ahead))  # ahead: one row
        plan = plan.unionByName(written(late.select("source", "block", (F.col("slot") + F.col("ahead")).alias("slot")), "mix-late"))
    placed = places(rows, sources, block_docs).join(plan, ["source", "block"])
    return placed.select("id", F.when(F.col("source") != _NULL, F.col("source")).alias("source"), *(F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)), "block", "slot", "rank", (F.col("slot") * block_docs + F.col("rank")).alias("position"))


def op5(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
