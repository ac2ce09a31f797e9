"""The user's workspace: visit lists, caches, review queue, sampling, histories and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def recent_list(visits: DataFrame, key: str, at: str = "at", most: int = 40) -> DataFrame:
    """(key, at) of the keys visited last, each once, latest first."""
    return visits.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(most)


def within_budget(files: DataFrame, budget: int, key: str = "asset_id", at: str = "created", size: str = "bytes") -> DataFrame:
    """The newest files whose running size stays within the budget (sizes missing: 0); the one that crosses it and all older ones go.

    Sizes are summed per month first, so only files of the months up to the one that crosses the budget are put in order; of
    those, ranges of the order are summed each on its own."""
    size_ = F.coalesce(F.col(size), F.lit(0))
    month = F.date_trunc("month", at)
    newer = Window.orderBy(F.desc_nulls_last("_month")).rowsBetween(Window.unboundedPreceding, -1)  # one row per month
    months = files.groupBy(month.alias("_month")).agg(F.sum(size_).alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(newer), F.lit(0)))
    near = files.join(F.broadcast(months.where(F.col("_before") <= budget).select("_month")), month.eqNullSafe(F.col("_month")), "left_semi")
    return running(near, [F.desc_nulls_last(at), F.desc(key)], size_, "_total").where(F.col("_total") + size_ <= budget).select(files.columns)


def sample(rows: DataFrame, n: int, seed: int, key: str = "asset_id", excluding: DataFrame | None = None) -> DataFrame:
    """n rows, uniform and without replacement, the same for the same seed."""
    rows = rows if excluding is None else rows.join(excluding, key, "left_anti")
    return rows.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n)


def review_queue(queue: DataFrame, removed: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, position): the queue (asset_id, ordinal), each id at its first place, without removed and unknown ids."""
    first = queue.groupBy("asset_id").agg(F.min("ordinal").alias("position"))
    return first.join(removed, "asset_id", "left_anti").join(assets, "asset_id", "left_semi")


def history(old: DataFrame, new: DataFrame, key: str = "asset_id", at: str = "at") -> DataFrame:
    """Records of old and new; of the records marked `replaced` only the last of each key, of the others all."""
    both = old.unionByName(new)
    last = Window.partitionBy(key).orderBy(F.desc(at))
    replaced = both.where("replaced").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    return replaced.unionByName(both.where(~F.coalesce("replaced", F.lit(False))))


def tallies(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


def adjacent(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows with `previous`: the value of the row before in its group."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def progress(completed: Column, total: Column, finished: Column) -> Column:
    """Fraction done, from 0 to 1; of nothing, 1 if finished and else 0."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), completed / total))).otherwise(F.when(finished, 1.0).otherwise(0.0))
