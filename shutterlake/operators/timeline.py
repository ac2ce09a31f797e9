"""Timelines: periods with previews, journal days, days of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period


def timeline(assets: DataFrame, grain: str, previews: int = 6, journal: DataFrame | None = None) -> DataFrame:
    """(start, end, n, preview): per year, month or day the count and the newest ids as a list; assets without a date are left out.

    Counts are partial sums. Previews come from a window with a group limit, which Spark cuts per task before the shuffle, so a
    period with a third of all assets sends six rows per task. journal (day): days without assets come with count 0."""
    start, end = period(F.col("created"), grain)
    rows = assets.where(F.col("created").isNotNull()).select(start.alias("start"), end.alias("end"), "created", "asset_id")
    counts = rows.groupBy("start", "end").agg(F.count("*").alias("n"))
    order = Window.partitionBy("start").orderBy(F.desc("created"), F.desc("asset_id"))
    first = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= previews)
    lists = first.groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "asset_id"))), lambda x: x["asset_id"]).alias("preview"))  # `previews` entries at most
    out = counts.join(lists, "start")
    if journal is None:
        return out
    j_start, j_end = period(F.col("day"), grain)
    noted = journal.select(j_start.alias("start"), j_end.alias("end")).distinct().join(out.select("start"), "start", "left_anti")
    return out.unionByName(noted.select("start", "end", F.lit(0).cast("long").alias("n"), F.array().cast(out.schema["preview"].dataType).alias("preview")))


def random_day(assets: DataFrame, seed: int) -> DataFrame:
    """The assets of one day, chosen by hash of the day and seed."""
    days = assets.select(F.to_date("created").alias("day")).where(F.col("day").isNotNull()).distinct()
    one = days.orderBy(F.md5(F.concat_ws(":", "day", F.lit(seed))), "day").limit(1)
    return assets.withColumn("day", F.to_date("created")).join(F.broadcast(one), "day", "left_semi")
