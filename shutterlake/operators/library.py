"""The metadata index: statistics, unsorted assets, paging, ranks, albums and folders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from . import trees
from .ordering import positions
from .predicates import SlideshowFilter

NEWEST = (F.desc, "created"), (F.desc, "asset_id")


def newest() -> list[Column]:
    return [f(c) for f, c in NEWEST]


def unsorted(assets: DataFrame, members: DataFrame) -> DataFrame:
    """Assets that are in no album."""
    return assets.join(members, "asset_id", "left_anti")


def index_stats(assets: DataFrame, albums: DataFrame, members: DataFrame) -> DataFrame:
    """One row: assets, albums, unsorted. Counts meet as one-row tables."""
    counts = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, df in (("assets", assets), ("albums", albums), ("unsorted", unsorted(assets, members)))]
    both = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return both.agg(*(F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("assets", "albums", "unsorted")))


def search_stats(assets: DataFrame, now: Column) -> DataFrame:
    """Seven counts over searchable assets in one pass."""
    c = {
        "total": F.lit(True),
        "embedded": F.col("vector").isNotNull(),
        "pending": F.col("status") == "pending",
        "failed": F.col("status") == "failed",
        "waiting": (F.col("status") == "pending") & (F.col("retry_at") > now),
        "with_location": F.col("latitude").isNotNull(),
        "with_text": F.col("text").isNotNull(),
    }
    return assets.agg(*(F.count_if(x).alias(name) for name, x in c.items()))


def album_counts(assets: DataFrame, members: DataFrame) -> DataFrame:
    """(asset_id, album_count) of every asset."""
    counts = members.groupBy("asset_id").agg(F.count("*").alias("album_count"))
    return assets.select("asset_id").join(counts, "asset_id", "left").withColumn("album_count", F.coalesce("album_count", F.lit(0)))


def refreshed_counts(assets: DataFrame, members: DataFrame, affected: DataFrame) -> DataFrame:
    """album_counts of the affected assets alone; both sides are cut down first."""
    ids = affected.select("asset_id").distinct()
    return album_counts(assets.join(ids, "asset_id", "left_semi"), members.join(ids, "asset_id", "left_semi"))


def recent(assets: DataFrame, n: int) -> DataFrame:
    return assets.orderBy(*newest()).limit(max(0, n))


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, rows offset to offset + limit; for walking through a table use keyset_page."""
    return rows.orderBy(*newest()).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, after: int, limit: int = 500, key: str = "asset_id") -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def rank_of(rows: DataFrame, assets: DataFrame, asset_id: int) -> DataFrame:
    """One row `rank`: how many of rows sort ahead (newest first) of that asset, in rows or not; 0 if it is unknown.

    The asset's place is one broadcast row, and the count is a partial aggregate: nothing is sorted."""
    at = assets.where(F.col("asset_id") == asset_id).select(F.struct("created", "asset_id").alias("place")).limit(1)
    ahead = rows.join(F.broadcast(at), F.struct("created", "asset_id") > F.col("place"))
    return ahead.agg(F.count("*").alias("rank"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with a 0-based `rank`, newest first."""
    return positions(rows, newest(), "rank")


def page_of(numbered: DataFrame, page_size: int) -> DataFrame:
    """numbered (with rank) with page and the offset of its page."""
    return numbered.withColumn("page", F.floor(F.col("rank") / page_size)).withColumn("page_offset", F.col("page") * page_size)


def page_count(rows: DataFrame, page_size: int = 200) -> DataFrame:
    return rows.agg(F.ceil(F.count("*") / page_size).alias("pages"))


def playlist(rows: DataFrame, flt: SlideshowFilter, start: int) -> DataFrame:
    """Of the rows newest first: those that pass, with their position among those, and `start_index`, the kept rows before offset start."""
    kept = ranked(rows).where(flt.column())
    before = kept.agg(F.count_if(F.col("rank") < start).alias("start_index"))
    return ranked(kept.drop("rank")).join(F.broadcast(before)).withColumnRenamed("rank", "position")


def ordered_lookup(rows: DataFrame, ids: list[int], key: str = "asset_id") -> DataFrame:
    """The rows of a list of ids in the order of the list, first mention first; unknown ids are left out. `position` has the order."""
    asked = rows.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], f"{key} long")
    listed = asked.select(F.col(key)).withColumn("position", F.array_position(F.array(*(F.lit(int(i)) for i in dict.fromkeys(ids))), F.col(key)) - 1)
    return rows.join(F.broadcast(listed), key)


def albums_of(asset_id: int, albums: DataFrame, members: DataFrame) -> DataFrame:
    """User albums that hold the asset."""
    own = members.where(F.col("asset_id") == asset_id)
    return albums.where(F.col("kind") == "user").join(own, "album_id", "left_semi")


def guarded(members: DataFrame, assets: DataFrame) -> DataFrame:
    """Memberships whose asset exists."""
    return members.join(assets, "asset_id", "left_semi")


def absent(stored: DataFrame, scanned: DataFrame, key: str = "asset_id") -> DataFrame:
    """Stored rows that a full scan did not find: what reconciliation deletes."""
    return stored.join(scanned, key, "left_anti")


def catalogue(albums: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """Albums with asset_count and the newest member as preview; smart albums without assets go; shared ones have no folder."""
    inside = members.join(assets.select("asset_id", "created"), "asset_id")
    facts = inside.groupBy("album_id").agg(F.count("*").alias("asset_count"), F.max_by("asset_id", F.struct("created", "asset_id")).alias("preview"))
    rows = albums.dropDuplicates(["album_id"]).join(facts, "album_id", "left").withColumn("asset_count", F.coalesce("asset_count", F.lit(0)))
    rows = rows.where((F.col("kind") != "smart") | (F.col("asset_count") > 0))
    return rows.withColumn("folder_id", F.when(F.col("kind") != "shared", F.col("folder_id")))


def empty_albums(catalogued: DataFrame) -> DataFrame:
    return catalogued.where((F.col("kind") == "user") & (F.col("asset_count") == 0))


def album_order(albums: DataFrame) -> list[Column]:
    """User, smart, shared; then title with numbers by value."""
    return [F.when(F.col("kind") == "user", 0).when(F.col("kind") == "smart", 1).otherwise(2), natural_key(F.col("title")), F.col("album_id")]


def pinned(albums: DataFrame, pins: list[int]) -> DataFrame:
    return ordered_lookup(albums, pins, "album_id")


def dock(albums: DataFrame, visits: DataFrame, n: int = 24) -> DataFrame:
    """The n albums visited last; without visits, the first n albums by title. visits: album_id, at."""
    last = visits.groupBy("album_id").agg(F.max("at").alias("at"))
    by_title = albums.orderBy(natural_key(F.col("title")), "album_id").limit(n).select("album_id", F.lit(1).alias("fallback"), F.lit(None).cast("timestamp").alias("at"))
    recent_ = albums.join(last, "album_id").orderBy(F.desc("at"), "album_id").limit(n).select("album_id", F.lit(0).alias("fallback"), "at")
    both = by_title.unionByName(recent_)  # 2 n rows at most
    least = both.agg(F.min("fallback").alias("least"))
    return both.join(F.broadcast(least), F.col("fallback") == F.col("least")).select("album_id", "at")


def dock_list(albums: DataFrame, which: str, joined: DataFrame | None = None, visits: DataFrame | None = None, starred: list[int] | None = None, query: str = "", reverse: bool = False, n: int = 24) -> DataFrame:
    """User albums of a list of the dock, with their 0-based `position`.

    all: by title; joined: those with a row in joined (album_id), by title; starred: in the order of that list of ids, unknown
    ones left out; recent: by last visit (album_id, at), and the first n by title where there is none. query keeps titles that
    hold it in any case; reverse turns the list round. Positions are taken over one list of albums that a person looks at."""
    users, by_title = albums.where(F.col("kind") == "user"), [natural_key(F.col("title")), F.col("album_id")]
    if which == "recent":
        rows = users.join(dock(users, visits, n), "album_id")
        order = [F.desc_nulls_last("at"), *by_title]
    elif which == "starred":
        rows, order = ordered_lookup(users, starred or [], "album_id").withColumnRenamed("position", "ordinal"), [F.col("ordinal")]
    elif which in ("all", "joined"):
        rows, order = users if which == "all" else users.join(joined, "album_id", "left_semi"), by_title
    else:
        raise ValueError(f"no such list: {which}")
    if said := query.strip().lower():
        rows = rows.where(F.lower("title").contains(said))
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    if reverse:
        rows = rows.withColumn("position", F.count("*").over(Window.partitionBy()) - 1 - F.col("position"))
    return rows.select(*albums.columns, F.col("position").cast("long").alias("position"))


def folder_previews(folders: DataFrame, albums: DataFrame) -> DataFrame:
    """(folder_id, preview): the first preview in a folder, its own albums (folder_id, album_id, title, preview) by title before those of the folders below it, depth first; null if none has one."""
    own = albums.where("folder_id IS NOT NULL AND preview IS NOT NULL").groupBy("folder_id").agg(F.min_by("preview", F.struct(natural_key(F.col("title")), "album_id")).alias("preview"))
    nodes = trees.outline(trees.forest(folders)).join(own.withColumnRenamed("folder_id", "id"), "id", "left")
    first = F.when(F.col("preview").isNotNull(), F.struct("place", "preview"))
    inside = trees.closed(nodes.select("id", "up", first.alias("first")), {"first": "min"})
    return inside.select(F.col("id").alias("folder_id"), F.col("first.preview").alias("preview"))


def signature(rows: DataFrame, authorised: str) -> DataFrame:
    """One row: authorisation, count, first and last id in library order."""
    order = F.struct("created", "asset_id")
    s = rows.agg(F.count("*").alias("n"), F.max_by("asset_id", order).alias("first"), F.min_by("asset_id", order).alias("last"))
    return s.select(F.concat_ws("|", F.lit(authorised), "n", F.coalesce(F.col("first").cast("string"), F.lit("")), F.coalesce(F.col("last").cast("string"), F.lit(""))).alias("signature"))


def if_ready(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """rows if meta (key, value) says index_ready = 1, else none."""
    ready = meta.where("key = 'index_ready' AND value = '1'").select(F.lit(1).alias("_ready")).limit(1)
    return rows.join(F.broadcast(ready)).drop("_ready")


def folder_paths(folders: DataFrame) -> DataFrame:
    """(folder_id, depth, path): every folder with its way from the root, itself last; folders on or below a cycle are roots of depth 0.

    path is as long as the tree is deep; folder_outline orders a listing without it."""
    nodes = trees.forest(folders).withColumn("path", F.array("id"))
    rows = trees.closed(nodes, above={"path": F.concat})
    return rows.select(F.col("id").alias("folder_id"), (F.size("path") - 1).alias("depth"), "path")


def folder_outline(folders: DataFrame) -> DataFrame:
    """(folder_id, depth, place): place orders a depth-first listing, siblings by id; folders on or below a cycle come last, as roots."""
    return trees.outline(trees.forest(folders)).select(F.col("id").alias("folder_id"), "depth", "place")


def folder_rollup(folders: DataFrame, counts: DataFrame) -> DataFrame:
    """(folder_id, albums, assets): counts (folder_id, albums, assets) summed over each folder and all below it. Folders on or below a cycle have their own counts."""
    own = counts.select(F.col("folder_id").alias("id"), *(F.col(c).cast("long").alias(c) for c in ("albums", "assets")))
    nodes = trees.forest(folders).join(own, "id", "left").na.fill(0, ["albums", "assets"])
    return trees.closed(nodes, {"albums": "sum", "assets": "sum"}).select(F.col("id").alias("folder_id"), "albums", "assets")


def empty_folders(folders: DataFrame, counts: DataFrame) -> DataFrame:
    """The topmost folders without an album anywhere below."""
    empty = folder_rollup(folders, counts).where("albums = 0").select("folder_id")
    rows = folders.join(empty, "folder_id")
    above = empty.select(F.col("folder_id").alias("parent_id"))
    return rows.join(above, "parent_id", "left_anti").select("folder_id")


def tree_rows(folders: DataFrame, expanded: Iterable[int], ordered: bool = False) -> DataFrame:
    """(folder_id, depth) of a tree view: folders whose ancestors are all expanded; with ordered, also their `place` in the listing."""
    ids = [int(x) for x in expanded]
    nodes = trees.forest(folders)
    shown = F.col("up").isNull() | F.col("up").isin(ids)
    rows = trees.closed(nodes.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.coalesce(shown, F.lit(False)).alias("shown")), above={"depth": trees.added, "shown": lambda a, b: a & b})
    rows = rows.where("shown OR loop").select(F.col("id").alias("folder_id"), F.when(F.col("loop"), 0).otherwise(F.col("depth")).alias("depth"))
    return rows.join(folder_outline(folders).drop("depth"), "folder_id") if ordered else rows
