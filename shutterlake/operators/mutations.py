"""Changes to Parquet tables as new snapshots: upserts, deletes with cascade, membership, retry state. Each function returns the new table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..sources.shared import written
from .library import album_counts


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by key. Columns of keep, and those that new lacks, stay as they were; rows of new are unique by key.

    One join on the key; null values in new do overwrite."""
    keys = [key] if isinstance(key, str) else key
    own = [c for c in new.columns if c not in keys and c not in keep]
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in own), F.lit(True).alias("_new"))
    both = old.join(fresh, keys, "full_outer")
    return both.select(*(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in old.columns))


def latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row of each key by order; as an aggregate, so a frequent key is reduced before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def delete_cascade(assets: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, members) without the ids of gone."""
    ids = gone.select("asset_id").distinct()
    return assets.join(ids, "asset_id", "left_anti"), members.join(ids, "asset_id", "left_anti")


def replace_memberships(members: DataFrame, albums: DataFrame, replacement: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The membership of the given albums replaced; second, album counts of the assets that were or are in them.

    Memberships of unknown assets are not taken over."""
    ids = albums.select("album_id").distinct()
    before = members.join(ids, "album_id", "left_semi")
    after = replacement.join(ids, "album_id", "left_semi").join(assets, "asset_id", "left_semi").select("album_id", "asset_id").distinct()
    whole = members.join(ids, "album_id", "left_anti").select("album_id", "asset_id").unionByName(after)
    affected = before.select("asset_id").union(after.select("asset_id")).distinct()
    counts = album_counts(assets.join(affected, "asset_id", "left_semi"), whole.join(affected, "asset_id", "left_semi"))
    return whole, counts


def add_members(members: DataFrame, more: DataFrame, assets: DataFrame) -> DataFrame:
    """Insert or ignore; unknown assets are left out."""
    return members.select("album_id", "asset_id").union(more.join(assets, "asset_id", "left_semi").select("album_id", "asset_id")).distinct()


def join_album(albums: DataFrame, members: DataFrame, assets: DataFrame, album_id: int, title: str, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(albums, members, album counts of the listed assets) after the assets of ids were put into a user album, which takes the title and is made where it is missing.

    Assets that are in it already, and unknown ones, change nothing."""
    spark = albums.sparkSession
    new = spark.range(1).select(F.lit(album_id).cast("long").alias("album_id"), F.lit(title).alias("title"))
    known = ids.select("asset_id").distinct().join(assets.select("asset_id"), "asset_id", "left_semi")
    whole = add_members(members, known.select(F.lit(album_id).cast("long").alias("album_id"), "asset_id"), assets)
    counts = album_counts(known, whole.join(known, "asset_id", "left_semi"))
    return upsert(albums, new, "album_id").withColumn("kind", F.coalesce("kind", F.lit("user"))), whole, counts


def remove_everywhere(tables: tuple[DataFrame, ...], gone: DataFrame, key: str = "asset_id") -> tuple[DataFrame, ...]:
    """The tables, as those of assets, vectors and texts, without the ids of gone. Taking vectors away alone does so too: the row goes with its vector."""
    ids = gone.select(key).distinct()
    return tuple(t.join(ids, key, "left_anti") for t in tables)


def _retry_at(now: datetime) -> Column:
    """now plus 30 seconds times 2 to the old count of failures, an hour at most."""
    wait = F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.col("failures")))
    return (F.lit(now).cast("timestamp") + F.make_interval(secs=wait.cast("decimal(18,6)"))).cast("timestamp_ntz")


def mark_failed(rows: DataFrame, failed: DataFrame, now: datetime) -> DataFrame:
    """status, failures and retry_at of the failed rows: now plus 30 seconds times 2 to the old count, an hour at most."""
    hit = failed.select("asset_id").distinct().withColumn("_hit", F.lit(True))
    both = rows.join(hit, "asset_id", "left")
    new = {"status": F.lit("failed"), "retry_at": _retry_at(now), "failures": F.col("failures") + 1}
    return both.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def defer(rows: DataFrame, deferred: DataFrame, until: datetime) -> DataFrame:
    """The deferred rows stay pending, with a retry time."""
    hit = deferred.select("asset_id").distinct().withColumn("_hit", F.lit(True))
    new = {"status": F.lit("pending"), "retry_at": F.lit(until).cast("timestamp_ntz")}
    both = rows.join(hit, "asset_id", "left")
    return both.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def store_text(rows: DataFrame, texts: DataFrame, version: int) -> DataFrame:
    """rows with the recognised texts (asset_id, lines) put in: joined by line, normalised, blank as null; text_version marks the attempt."""
    said = texts.select("asset_id", normalise(F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")).alias("text"), F.lit(version).alias("text_version"))
    rows = rows if "text_version" in rows.columns else rows.withColumn("text_version", F.lit(None).cast("int"))
    both = rows.join(said.select("asset_id", F.col("text").alias("_text"), F.col("text_version").alias("_version")), "asset_id", "left")
    new = {"text": F.col("_text"), "text_version": F.col("_version")}
    return both.select(*(F.when(F.col("_version").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def encoded(texts: list[str | None], encode: Callable[[str], list[float]]) -> list[list[float] | None]:
    """A vector per text, null for one that fails. An encoder with `encode_all` gets all texts in one call; if that call fails, one after another."""
    owner = getattr(encode, "__self__", encode)
    if hasattr(owner, "encode_all"):
        try:
            return [[float(x) for x in v] for v in owner.encode_all(texts)]
        except Exception:  # noqa: BLE001, S110  some text is at fault: the next lines find it
            pass

    def one(text: str | None) -> list[float] | None:
        try:
            return [float(x) for x in encode(text)]
        except Exception:  # noqa: BLE001  the row is marked, whatever the encoder raised
            return None

    return [one(t) for t in texts]


def index_step(rows: DataFrame, encode: Callable[[str], list[float]], now: datetime) -> DataFrame:
    """One pass over pending or failed rows that are due: their text is encoded, in batches on the executors.

    A row whose encoding fails is marked failed with a later retry; the others become ready. Running it again goes on where it stopped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"asset_id": batch["asset_id"], "_vector": encoded(list(batch["text"]), encode)})

    due = F.col("status").isin("pending", "failed") & (F.col("retry_at").isNull() | (F.col("retry_at") <= F.lit(now).cast("timestamp_ntz")))
    tried = rows.where(due).select("asset_id", "text").mapInPandas(run, "asset_id long, _vector array<double>").withColumn("_tried", F.lit(True))
    both = rows.join(tried, "asset_id", "left")
    done, kind = F.col("_vector").isNotNull(), rows.schema["vector"].dataType
    new = {
        "vector": F.when(done, F.col("_vector").cast(kind)).otherwise(F.col("vector")),
        "status": F.when(done, "ready").otherwise("failed"),
        "retry_at": F.when(~done, _retry_at(now)),
        "failures": F.when(done, 0).otherwise(F.col("failures") + 1),
    }
    return both.select(*(F.when(F.col("_tried"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns))


def requeue(rows: DataFrame) -> DataFrame:
    """Vectors dropped and everything pending again, as when the matrix is rebuilt."""
    return rows.withColumns({"vector": F.lit(None).cast(rows.schema["vector"].dataType), "status": F.lit("pending"), "failures": F.lit(0), "retry_at": F.lit(None).cast("timestamp_ntz")})


def first_per_path(rows: DataFrame, path: str = "path", order: str = "ordinal") -> DataFrame:
    """The first row of each path; rows without a path all stay."""
    first = Window.partitionBy(path).orderBy(order)
    named = rows.where(F.col(path).isNotNull()).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return named.unionByName(rows.where(F.col(path).isNull()))


def repicked(rows: DataFrame, picked: DataFrame, path: str = "path", order: str = "ordinal", keep: tuple[str, ...] = ()) -> DataFrame:
    """first_per_path with a picked row put in: it refreshes the row of its path, but for the order and the columns of keep, or comes anew."""
    return upsert(first_per_path(rows, path, order), picked, path, keep=(order, *keep))


def natural_upsert(old: DataFrame, new: DataFrame, keys: list[str], key: str, order: str) -> DataFrame:
    """old with the latest row (by order) of each natural key in new: what exists keeps its id in `key`, what is new gets the hash of its natural key."""
    fresh = latest(new, keys, order).drop(order)
    made = F.md5(F.to_json(F.array(*(F.col(k).cast("string") for k in keys))))
    return upsert(old, fresh, keys, keep=(key,)).withColumn(key, F.coalesce(key, made))


def without_owners(owners: DataFrame, owned: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(owners, owned) without the owners of gone, and without what they own."""
    ids = gone.select(key).distinct()
    return owners.join(ids, key, "left_anti"), owned.join(ids, key, "left_anti")


def if_idle(before: DataFrame, after: DataFrame, state: DataFrame) -> DataFrame:
    """A change applied ahead of the sync: after, if state (one row: indexed, running) has an index and no run is under way, else before.

    The sync that follows finds the change done; upserts, memberships and deletes change nothing when they come again."""
    return before if state.where("indexed AND NOT running").isEmpty() else after


def slotted(stored: DataFrame, more: DataFrame, dimension: int) -> DataFrame:
    """(asset_id, vector, slot) of the vectors of more that stored (asset_id, slot) lacks: slots without a gap after the last one, by asset_id.

    Vectors of another dimension are left out, and of two vectors of an asset the greater one. Ranges of ids are numbered each in its task; only their counts are added up."""
    last = stored.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("_next"))
    one = more.where(F.size("vector") == dimension).groupBy("asset_id").agg(F.max("vector").alias("vector"))
    fresh = one.join(stored.select("asset_id"), "asset_id", "left_anti").repartitionByRange("asset_id")
    parts = written(fresh.withColumn("_part", F.spark_partition_id()), "slots")
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("asset_id")) - 1
    numbered = parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").join(F.broadcast(last))
    return numbered.select("asset_id", "vector", (F.col("_next") + F.col("_offset") + F.col("_own")).cast("long").alias("slot"))


def fold(changes: DataFrame) -> DataFrame:
    """(asset_id, op, and the last values): all changes of a batch as one per asset. A delete anywhere wins, so late rows of a deleted asset do nothing."""
    value = F.max_by(F.struct("at", "bytes"), F.struct("sequence")).alias("v")
    rows = changes.groupBy("asset_id").agg(F.bool_or(F.col("op") == "delete").alias("gone"), value)
    return rows.select("asset_id", F.when(F.col("gone"), "delete").otherwise("upsert").alias("op"), F.col("v.at").alias("at"), F.col("v.bytes").alias("bytes"))


def apply_changes(table: DataFrame, folded: DataFrame) -> DataFrame:
    """table (asset_id, at, bytes) after the folded changes; applying them again changes nothing."""
    rest = table.join(folded.where("op = 'delete'"), "asset_id", "left_anti")
    return upsert(rest, folded.where("op = 'upsert'").select("asset_id", "at", "bytes"), "asset_id")


#: A table of the latest change of every asset, deletions too.
LATEST = "asset_id long, sequence long, gone boolean, at timestamp_ntz, bytes long"


def merge_latest(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored (LATEST) and changes (sequence, at, asset_id, op, bytes): of each asset the one with the greatest sequence.

    The result does not depend on the order or number of times that changes are merged in; one aggregation with partial results."""
    new = changes.select("asset_id", "sequence", (F.col("op") == "delete").alias("gone"), "at", "bytes")
    last = F.max_by(F.struct("gone", "at", "bytes"), "sequence").alias("v")
    both = stored.select("asset_id", "sequence", "gone", "at", "bytes").unionByName(new)
    return both.groupBy("asset_id").agg(F.max("sequence").alias("sequence"), last).select("asset_id", "sequence", "v.gone", "v.at", "v.bytes")
