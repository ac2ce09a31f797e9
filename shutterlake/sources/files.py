"""Files as sources and sinks: media folders, JSON snapshots, evaluation logs, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.mutations import slotted
from .shared import exists

#: File endings of images.
IMAGES = ("jpg", "jpeg", "png", "heic", "heif", "gif", "tif", "tiff", "bmp", "webp", "dng")


def folder(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, name, folder, size, modified) of the images below a folder; hidden files and folders are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split(F.expr("substring(path, length(" + "'" + path.rstrip("/").replace("'", "''") + "') + instr(path, '" + path.rstrip("/").replace("'", "''") + "'))"), "/")
    named = files.withColumn("_parts", parts).withColumn("name", F.element_at("_parts", -1))
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    shown = ending.isin(*endings) & ~F.exists("_parts", lambda p: p.startswith("."))
    return named.where(shown).select("path", "name", F.array_join(F.slice("_parts", 2, F.size("_parts") - 2), "/").alias("folder"), "size", "modified")


def listing(files: DataFrame) -> DataFrame:
    """Newest first; files without a time last."""
    return files.orderBy(F.desc_nulls_last("modified"), "path")


def subfolders(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, newest), by name, digits by value."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("newest")).orderBy(natural_key(F.col("folder")), "folder")


def save_report(rows: DataFrame, path: str) -> None:
    """A report as JSON; it replaces the one before."""
    rows.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_albums(albums: DataFrame, path: str, version: int = 1) -> None:
    albums.withColumn("snapshot_version", F.lit(version)).write.mode("overwrite").json(path)


def restore_albums(spark: SparkSession, path: str, schema: str, known: DataFrame, version: int = 1) -> DataFrame:
    """Saved albums that still exist; none of another version; ValueError if nothing is left."""
    saved = spark.read.schema(schema + ", snapshot_version int").json(path)
    rows = saved.where(F.col("snapshot_version") == version).drop("snapshot_version").join(known, "album_id", "left_semi")
    if rows.isEmpty():
        raise ValueError("the snapshot has another version, or nothing in it exists")
    return rows


def _records(lines: DataFrame, kinds: tuple[str, ...], column: str, order: str | None) -> DataFrame:
    """(kind, query, rest) of lines `kind|query|rest`; other lines are skipped. With order, only the last line of each kind and query."""
    pattern = rf"^({'|'.join(kinds)})\|([^|]+)\|(.*)$"
    said = F.trim(column)
    kind, query, rest = (F.regexp_extract(said, pattern, k).alias(n) for k, n in ((1, "kind"), (2, "query"), (3, "rest")))
    rows = lines.where(said.rlike(pattern)).select(kind, query, rest, *([F.col(order).alias("_order")] if order else []))
    return rows.groupBy("kind", "query").agg(F.max_by("rest", "_order").alias("rest")) if order else rows


def evaluation_log(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """(kind, query, rank, item, score) of lines `eval|query|item:score item:score ...` and `similar|...`, ranks from 1.

    An item may hold colons, as the score follows the last one; words without a score are skipped. order: a column by which a
    later line of a query replaces an earlier one; without it all lines count."""
    hit = r"^(.*):([^:]*)$"
    words = F.transform(F.split("rest", r"\s+"), lambda w: F.struct(F.regexp_extract(w, hit, 1).alias("item"), F.regexp_extract(w, hit, 2).try_cast("double").alias("score")))
    rows = _records(lines, ("eval", "similar"), column, order).select("kind", "query", F.posexplode(F.filter(words, lambda w: w["score"].isNotNull())).alias("at", "hit"))
    return rows.select("kind", "query", (F.col("at") + 1).alias("rank"), "hit.item", "hit.score")


def evaluation_plans(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """(query, field, value) of lines `evalplan|query|field=value|field=value ...`; a field without `=` has an empty value, the last of two equal fields counts."""
    rows = _records(lines, ("evalplan",), column, order).select("query", F.posexplode(F.split("rest", r"\|")).alias("at", "token"))
    field, value = F.substring_index("token", "=", 1), F.when(F.contains("token", F.lit("=")), F.regexp_extract("token", r"(?s)^[^=]*=(.*)$", 1)).otherwise("")
    by = ["query", "field"] if order else ["query", "field", "at"]
    return rows.select("query", field.alias("field"), value.alias("value"), "at").groupBy(*by).agg(F.max_by("value", "at").alias("value")).select("query", "field", "value")


def evaluation_meta(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query, item, latitude, longitude, date), as text, of lines `evalmeta|query|item|latitude,longitude,date`; parts that are missing are empty."""
    rest = F.regexp_extract("rest", r"^([^|]+)\|([^,]*),?([^,]*),?(.*)$", 0)
    pick = lambda k: F.regexp_extract("rest", r"^([^|]+)\|([^,]*),?([^,]*),?(.*)$", k)
    rows = _records(lines, ("evalmeta",), column, None).where(rest != "")
    return rows.select("query", *(pick(k).alias(n) for k, n in enumerate(("item", "latitude", "longitude", "date"), 1)))


def shares(listing: DataFrame) -> DataFrame:
    """(name, comment) of the disk shares in a listing (name, type, comment): the lower 28 bits of the type are 0 and the name has no `$` at its end. By name, digits by value."""
    disk = F.col("type").cast("long").bitwiseAND(0x0FFFFFFF) == 0
    return listing.where(disk & ~F.col("name").endswith("$")).select("name", "comment").orderBy(natural_key(F.col("name")), "name")


def append_vectors(spark: SparkSession, path: str, more: DataFrame, dimension: int) -> None:
    """Append vectors (asset_id, vector) to a Parquet table with slots; assets that it has already are left out, so a run that was cut short can be repeated."""
    old = stored_vectors(spark, path)
    slotted(old, more, dimension).write.mode("append").parquet(path)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, vector, slot) of the table, empty where there is none."""
    schema = "asset_id long, vector array<double>, slot long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def journal_lines(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """(part, ordinal, line): entries (day, text) newest first, then notes (asset_id, text) by id, as Markdown."""
    first = entries.select(F.lit(0).alias("part"), (-F.unix_date("day")).cast("long").alias("ordinal"), F.concat(F.lit("## "), F.col("day").cast("string"), F.lit("\n\n"), "text", F.lit("\n")).alias("line"))
    return first.unionByName(notes.select(F.lit(1).alias("part"), F.col("asset_id").cast("long").alias("ordinal"), F.concat(F.lit("- "), F.col("asset_id").cast("string"), F.lit(": "), "text").alias("line")))


def save_journal(entries: DataFrame, notes: DataFrame, path: str) -> None:
    """Text files whose names and lines are in order."""
    journal_lines(entries, notes).orderBy("part", "ordinal").select("line").write.mode("overwrite").text(path)
