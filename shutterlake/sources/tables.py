"""Canonical tables of a media library over the driver's tables, as DataFrames and as the same SQL views.

assets       one row per photo or video (from orders)
albums       one row per album (from supplier); kind is user, smart or shared
members      distinct (album_id, asset_id) (from lineitem)
searchable   assets with text, place, indexing state and unit vector (from documents, embeddings and labels)
changes      a change feed: sequence, asset_id, op (from events)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("asset_id"),
        F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("media_type"),
        (F.col("o_orderpriority") == "1-URGENT").alias("favorite"),
        F.when(key % 17 != 0, F.floor(F.col("o_totalprice") * 100)).cast("long").alias("bytes"),
        (600 + key * 37 % 4000).cast("int").alias("width"),
        (600 + key * 53 % 4000).cast("int").alias("height"),
        (key % 8).cast("int").alias("subtype"),
        (key % 11 == 0).alias("live"),
    )


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 5 < 3, "user").when(F.col("s_suppkey") % 5 == 3, "smart").otherwise("shared")
    return s.select(F.col("s_suppkey").alias("album_id"), F.col("s_name").alias("title"), kind.alias("kind"), F.col("s_nationkey").alias("folder_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return line.select(F.col("l_suppkey").alias("album_id"), F.col("l_orderkey").alias("asset_id")).distinct()


def vectors(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(asset_id, vector, more columns of embeddings) of the searchable assets: no more is read than ids, vectors and these."""
    e, d = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents").select("doc_id")
    return e.join(d, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vector"), *more)


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, b = (read(spark, sf_dir, n) for n in ("documents", "embeddings", "labels"))
    key = F.col("vec_id")
    joined = e.join(d, key == F.col("doc_id")).join(b.select(F.col("doc_id").alias("label_id"), "quality"), key == F.col("label_id"), "left")
    x, y = F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double")
    return joined.select(
        key.alias("asset_id"),
        F.timestamp_add("DAY", (key * 7 % 1461).cast("int"), F.lit("2020-01-01").cast("timestamp")).cast("timestamp_ntz").alias("created"),
        F.when(F.col("lang") == "en", 1).otherwise(2).alias("media_type"),
        (F.col("quality") == 1).alias("favorite"),
        F.when(key % 4 != 0, F.greatest(F.lit(-90.0), F.least(F.lit(90.0), x * 300))).alias("latitude"),
        F.when(key % 4 != 0, F.greatest(F.lit(-180.0), F.least(F.lit(180.0), y * 600))).alias("longitude"),
        F.when(key % 6 != 0, F.col("text")).alias("text"),
        F.when(key % 5 == 0, "pending").when(key % 5 == 4, "failed").otherwise("ready").alias("status"),
        (key % 5 * 3 % 8).cast("int").alias("failures"),
        F.when(key % 10 == 4, F.timestamp_add("DAY", (key % 90).cast("int"), F.lit("2023-12-01").cast("timestamp"))).cast("timestamp_ntz").alias("retry_at"),
        F.col("embedding").alias("vector"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return e.select(F.col("event_id").alias("sequence"), F.col("ts").alias("at"), (F.col("user_id") * 3).alias("asset_id"), op.alias("op"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"))


#: The same tables as SQL views.
VIEWS = {
    "assets": """SELECT o_orderkey AS asset_id, o_orderdate AS created, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS media_type, o_orderpriority = '1-URGENT' AS favorite,
  CASE WHEN o_orderkey % 17 <> 0 THEN floor(o_totalprice * 100)::BIGINT END AS bytes, (600 + o_orderkey * 37 % 4000)::INT AS width, (600 + o_orderkey * 53 % 4000)::INT AS height, (o_orderkey % 8)::INT AS subtype, o_orderkey % 11 = 0 AS live FROM orders""",
    "albums": "SELECT s_suppkey AS album_id, s_name AS title, CASE WHEN s_suppkey % 5 < 3 THEN 'user' WHEN s_suppkey % 5 = 3 THEN 'smart' ELSE 'shared' END AS kind, s_nationkey AS folder_id FROM supplier",
    "members": "SELECT DISTINCT l_suppkey AS album_id, l_orderkey AS asset_id FROM lineitem WHERE l_returnflag = 'R'",
    "searchable": """SELECT vec_id AS asset_id, TIMESTAMP '2020-01-01' + to_days((vec_id * 7 % 1461)::INT) AS created, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS media_type, quality = 1 AS favorite,
  CASE WHEN vec_id % 4 <> 0 THEN greatest(-90, least(90, embedding[1]::DOUBLE * 300)) END AS latitude, CASE WHEN vec_id % 4 <> 0 THEN greatest(-180, least(180, embedding[2]::DOUBLE * 600)) END AS longitude,
  CASE WHEN vec_id % 6 <> 0 THEN text END AS text, CASE WHEN vec_id % 5 = 0 THEN 'pending' WHEN vec_id % 5 = 4 THEN 'failed' ELSE 'ready' END AS status, (vec_id % 5 * 3 % 8)::INT AS failures,
  CASE WHEN vec_id % 10 = 4 THEN TIMESTAMP '2023-12-01' + to_days((vec_id % 90)::INT) END AS retry_at, embedding::DOUBLE[] AS vector
  FROM embeddings JOIN documents ON vec_id = documents.doc_id LEFT JOIN labels ON labels.doc_id = vec_id""",
    "changes": '''SELECT event_id AS sequence, ts AS "at", user_id * 3 AS asset_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'insert' ELSE 'update' END AS op, floor(value * 1000)::BIGINT AS bytes FROM events''',
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """A statement whose CTEs are the named views, followed by body (which may go on with `, x AS (...)`)."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{'' if body.lstrip().startswith(',') else ' '}{body}"
