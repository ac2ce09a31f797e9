"""Registered queries of the metadata index: scans, filters, paging, ranks, albums and folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import library as L
from ..operators import predicates as P
from ..operators import timeline as T
from ..operators import workspace as W
from ..sources import tables as S
from ..sources.tables import with_views

TODAY = datetime(2001, 6, 15)
_D = "to_days(1)"
NEW = "ORDER BY created DESC, asset_id DESC"


def _folders(spark, sf):
    """Folders: nations below regions, and the nations' own."""
    n = S.read(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("folder_id"), F.col("n_regionkey").alias("parent_id"))
    r = S.read(spark, sf, "region").select(F.col("r_regionkey").alias("folder_id"), F.lit(None).cast("int").alias("parent_id"))
    return r.unionByName(n)


def _folder_counts(spark, sf):
    kept = L.catalogue(S.albums(spark, sf), S.members(spark, sf), S.assets(spark, sf)).where("folder_id IS NOT NULL")
    return kept.groupBy((F.col("folder_id") + 100).cast("int").alias("folder_id")).agg(F.count("*").alias("albums"), F.sum("asset_count").alias("assets"))


def _threads(spark, sf):
    """Conversations as trees of folders: a turn lies in the turn before it; every turn is an album, its characters are assets."""
    turns = S.read(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    name = lambda back: F.concat_ws(":", F.col("conv_id"), F.col("turn") - back)
    folders = turns.select(name(0).alias("folder_id"), name(1).alias("parent_id"))
    counts = turns.groupBy(name(0).alias("folder_id")).agg(F.count("*").alias("albums"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("assets"))
    return folders, counts


_CATALOGUE = """catalogue AS (SELECT a.album_id, a.title, a.kind, CASE WHEN kind <> 'shared' THEN folder_id END AS folder_id, coalesce(n, 0) AS asset_count, preview FROM albums a LEFT JOIN
  (SELECT album_id, count(*) AS n, arg_max(asset_id, row(created, asset_id)) AS preview FROM members JOIN assets USING (asset_id) GROUP BY album_id) f USING (album_id) WHERE kind <> 'smart' OR coalesce(n, 0) > 0)"""
_FOLDERS = """folders AS (SELECT r_regionkey AS folder_id, NULL::INT AS parent_id FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation),
counts AS (SELECT folder_id + 100 AS folder_id, count(*) AS albums, sum(asset_count) AS assets FROM catalogue WHERE folder_id IS NOT NULL GROUP BY 1),
walk AS (SELECT folder_id, 0 AS depth, [folder_id] AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, depth + 1, list_append(path, f.folder_id) FROM walk w JOIN folders f ON f.parent_id = w.folder_id),
rolled AS (SELECT above AS folder_id, coalesce(sum(albums), 0)::BIGINT AS albums, coalesce(sum(assets), 0)::BIGINT AS assets FROM (SELECT folder_id, unnest(path) AS above FROM walk) x LEFT JOIN counts USING (folder_id) GROUP BY 1)"""

_KEY = "lower(regexp_replace(regexp_replace(title, '([0-9]+)', '0000000000\\1', 'g'), '0+([0-9]{10})($|[^0-9])', '\\1\\2', 'g'))"
_CONTENT = {"landscape": "width > height", "portrait": "height > width", "square": "width > 0 AND height > 0 AND abs(width - height) * 20 <= greatest(width, height)", "panorama": "subtype & 1 <> 0", "high_quality": "width >= 1920 OR height >= 3000"}


def _filter_counts(spark, sf):
    flt = {k: P.SlideshowFilter(k, screen=(1920, 3000)) for k in _CONTENT}
    counts = S.assets(spark, sf).agg(*(F.count_if(f.column()).alias(k) for k, f in flt.items()))
    return counts.unpivot([], list(flt), "filter", "n")


_REFINED = P.SlideshowFilter("landscape", no_screenshots=True, favorites_only=True, photos_only=True)
_REFINED_SQL = "width > height AND subtype & 4 = 0 AND favorite AND media_type = 1"


def _unsorted(spark, sf):
    return L.unsorted(S.assets(spark, sf), S.members(spark, sf))


_UNSORTED = "uns AS (SELECT * FROM assets WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.asset_id = assets.asset_id))"


def _journal(spark, sf):
    return spark.sql("SELECT CAST(d AS DATE) AS day FROM VALUES ('1994-12-25'), ('1996-02-29'), ('1996-03-01'), ('2002-01-01') AS t (d)")


def _preview(df):
    return df.withColumn("preview", F.array_join(F.transform("preview", lambda x: x.cast("string")), ","))


def _timeline(grain, journal=False):
    def run(spark, sf):
        return _preview(T.timeline(S.assets(spark, sf), grain, journal=_journal(spark, sf) if journal else None)).select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "n", "preview")

    return run


def _timeline_sql(grain, journal=False):
    out = f"""p AS (SELECT date_trunc('{grain}', created)::DATE AS start, (date_trunc('{grain}', created) + INTERVAL 1 {grain})::DATE AS "end", created, asset_id FROM assets WHERE created IS NOT NULL),
t AS (SELECT start, "end", count(*) AS n, array_to_string(list(asset_id ORDER BY created DESC, asset_id DESC)[1:6], ',') AS preview FROM p GROUP BY ALL)"""
    more = f""" UNION ALL SELECT DISTINCT date_trunc('{grain}', d)::DATE, (date_trunc('{grain}', d) + INTERVAL 1 {grain})::DATE, 0, '' FROM (SELECT unnest([DATE '1994-12-25', DATE '1996-02-29', DATE '1996-03-01', DATE '2002-01-01']) AS d) WHERE date_trunc('{grain}', d)::DATE NOT IN (SELECT start FROM t)"""
    return with_views(f", {out} SELECT * FROM t" + (more if journal else ""), "assets")


def _visits(spark, sf):
    return S.read(spark, sf, "events").select((F.col("user_id") % 10).alias("album_id"), F.col("ts").cast("timestamp").alias("at"))


def _ratio(w, h):
    return F.when(h > 0, F.round(w / h, 6))


QUERIES = {
    "scan_scope": lambda s, d: P.scan(S.assets(s, d), "favorites", datetime(1996, 1, 1), datetime(1997, 1, 1)).select("asset_id", "created"),
    "scan_live": lambda s, d: P.scan(S.assets(s, d), "live").select("asset_id"),
    "ordered_lookup": lambda s, d: L.ordered_lookup(S.assets(s, d), [7, 3, 99999999, 12, 3, 5]).select("asset_id", "position", "media_type"),
    "recent_n": lambda s, d: L.recent(S.assets(s, d), 100).select("asset_id", "created"),
    "keyset_page": lambda s, d: L.keyset_page(S.assets(s, d), 200, 500).select("asset_id", "bytes"),
    "slideshow_filter_counts": _filter_counts,
    "slideshow_refined": lambda s, d: S.assets(s, d).where(_REFINED.column()).select("asset_id", _ratio(F.col("width"), F.col("height")).alias("ratio")),
    "slideshow_playlist": lambda s, d: L.playlist(S.assets(s, d), _REFINED, 2000).select("asset_id", "position", "start_index"),
    "keyword_video": lambda s, d: S.assets(s, d).where(P.keyword("Videos")).select("asset_id"),
    "keyword_year": lambda s, d: S.assets(s, d).where(P.keyword("1997")).select("asset_id"),
    "album_title_search": lambda s, d: P.title_matches(S.albums(s, d), "SUPPLIER#00000000").select("album_id", "title", "shared"),
    "on_this_day": lambda s, d: P.on_this_day(S.assets(s, d), TODAY).select("asset_id", "created"),
    "unsorted_page": lambda s, d: L.page(_unsorted(s, d), 200, 100).select("asset_id"),
    "unsorted_count_filtered": lambda s, d: _unsorted(s, d).where(_REFINED.column()).agg(F.count("*").alias("n")),
    "unsorted_rank": lambda s, d: L.rank_of(_unsorted(s, d), S.assets(s, d), 77),
    "ranked_pages": lambda s, d: L.page_of(L.ranked(_unsorted(s, d)), 200).select("asset_id", "rank", "page", "page_offset"),
    "page_count": lambda s, d: L.page_count(_unsorted(s, d)),
    "index_stats": lambda s, d: L.index_stats(S.assets(s, d), S.albums(s, d), S.members(s, d)),
    "search_index_stats": lambda s, d: L.search_stats(S.searchable(s, d), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")),
    "album_count_refresh": lambda s, d: L.refreshed_counts(S.assets(s, d), S.members(s, d), S.changes(s, d).select("asset_id")),
    "album_counts": lambda s, d: L.album_counts(S.assets(s, d), S.members(s, d)),
    "album_membership_lookup": lambda s, d: L.albums_of(2, S.albums(s, d), S.members(s, d)).select("album_id", "title"),
    "membership_guard": lambda s, d: L.guarded(S.members(s, d), S.assets(s, d).where("asset_id % 3 = 0")).select("album_id", "asset_id"),
    "reconcile_absent": lambda s, d: L.absent(S.assets(s, d), S.assets(s, d).where("asset_id % 5 <> 0")).select("asset_id"),
    "album_catalogue": lambda s, d: L.catalogue(S.albums(s, d), S.members(s, d), S.assets(s, d)).select("album_id", "kind", "folder_id", "asset_count", "preview"),
    "album_order": lambda s, d: S.albums(s, d).select("album_id", "kind", text.natural_key(F.col("title")).alias("title_key")),
    "empty_albums": lambda s, d: L.empty_albums(L.catalogue(S.albums(s, d), S.members(s, d), S.assets(s, d))).select("album_id"),
    "pinned_albums": lambda s, d: L.pinned(S.albums(s, d), [4, 2, 123456789, 9]).select("album_id", "position"),
    "album_dock": lambda s, d: L.dock(S.albums(s, d), _visits(s, d), 5).select("album_id", F.col("at").cast("timestamp_ntz").alias("at")),
    "album_dock_fallback": lambda s, d: L.dock(S.albums(s, d), _visits(s, d).where("false"), 5).select("album_id"),
    "library_signature": lambda s, d: L.signature(S.assets(s, d), "full"),
    "readiness_gate": lambda s, d: L.if_ready(S.assets(s, d), s.sql("SELECT 'index_ready' AS key, '1' AS value")).select("asset_id"),
    "folder_rollup": lambda s, d: L.folder_rollup(_folders(s, d), _folder_counts(s, d)),
    "empty_folders": lambda s, d: L.empty_folders(_folders(s, d), _folder_counts(s, d)),
    "folder_previews": lambda s, d: L.folder_previews(_folders(s, d), L.catalogue(S.albums(s, d), S.members(s, d), S.assets(s, d)).select((F.col("folder_id") + 100).cast("int").alias("folder_id"), "album_id", "title", "preview")),
    "unsorted_filtered_page": lambda s, d: L.page(_unsorted(s, d).where(_REFINED.column()), 200, 20).select("asset_id"),
    "album_dock_joined": lambda s, d: L.dock_list(S.albums(s, d), "joined", joined=S.members(s, d).where("asset_id = 2")).select("album_id", "position"),
    "album_dock_starred": lambda s, d: L.dock_list(S.albums(s, d), "starred", starred=[7, 1, 123456789, 2], query="supplier").select("album_id", "position"),
    "album_dock_all": lambda s, d: L.dock_list(S.albums(s, d), "all", query="00001", reverse=True).select("album_id", "position"),
    "note_search": lambda s, d: P.note_search(S.read(s, d, "documents").select(F.col("doc_id").alias("asset_id"), F.col("text").alias("note")), " ÉN ").select("asset_id"),
    "folder_outline": lambda s, d: L.folder_outline(_folders(s, d)),
    "thread_rollup": lambda s, d: L.folder_rollup(*_threads(s, d)),
    "folder_tree": lambda s, d: L.tree_rows(_folders(s, d), [1, 3]).select("folder_id", "depth"),
    "timeline_year": _timeline("year"),
    "timeline_month": _timeline("month"),
    "timeline_day_journal": _timeline("day", True),
    "anniversary_days": lambda s, d: S.assets(s, d).select("asset_id", dates.days_until_next(F.to_date("created"), F.lit(TODAY).cast("date")).alias("days")),
    "month_grid": lambda s, d: S.assets(s, d).select(*(c.cast("int").alias(n) for c, n in zip(dates.month_grid(F.to_date("created")), ("blank", "days"), strict=True)), F.date_trunc("month", "created").cast("date").alias("month")).distinct(),
    "season_filter": lambda s, d: P.scan(S.assets(s, d), "photos", *dates.season_range(1997, "winter")).select("asset_id"),
    "rolling_window_filter": lambda s, d: P.scan(S.assets(s, d), "all", *dates.rolling_range(TODAY, 90)).select("asset_id"),
    "week_filter": lambda s, d: P.scan(S.assets(s, d), "all", *dates.week_range(TODAY, -1)).select("asset_id"),
    "recent_list_lru": lambda s, d: W.recent_list(_visits(s, d).withColumn("at", F.col("at").cast("timestamp_ntz")), "album_id", most=8),
    "lru_eviction": lambda s, d: W.within_budget(S.assets(s, d), 20_000_000_000).select("asset_id"),
    "review_queue": lambda s, d: W.review_queue(S.changes(s, d).select("asset_id", F.col("sequence").alias("ordinal")), S.assets(s, d).where("asset_id % 4 = 0"), S.assets(s, d)),
    "decision_tallies": lambda s, d: W.tallies(S.changes(s, d).select(F.col("op").alias("decision"))),
    "adjacent_pairs": lambda s, d: W.adjacent(S.changes(s, d), "asset_id", ["sequence"], "bytes").select("sequence", "previous"),
    "random_sample": lambda s, d: W.sample(S.assets(s, d), 50, 7, excluding=S.members(s, d)).select("asset_id"),
    "random_day": lambda s, d: T.random_day(S.assets(s, d), 3).select("asset_id", "day"),
}

_A = ("assets",)
ORACLE = {
    "scan_scope": with_views("SELECT asset_id, created FROM assets WHERE media_type IN (1, 2) AND favorite AND created >= DATE '1996-01-01' AND created < DATE '1997-01-01'", *_A),
    "scan_live": with_views("SELECT asset_id FROM assets WHERE live", *_A),
    "ordered_lookup": with_views("SELECT asset_id, (CASE asset_id WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 12 THEN 3 ELSE 4 END)::BIGINT AS position, media_type FROM assets WHERE asset_id IN (7, 3, 12, 5)", *_A),
    "recent_n": with_views(f"SELECT asset_id, created FROM assets {NEW} LIMIT 100", *_A),
    "keyset_page": with_views("SELECT asset_id, bytes FROM assets WHERE asset_id > 200 ORDER BY asset_id LIMIT 500", *_A),
    "slideshow_filter_counts": with_views(" UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) FILTER (WHERE {c}) AS n FROM assets" for k, c in _CONTENT.items()), *_A),
    "slideshow_refined": with_views(f"SELECT asset_id, round(width / height, 6) AS ratio FROM assets WHERE {_REFINED_SQL}", *_A),
    "slideshow_playlist": with_views(f", r AS (SELECT *, row_number() OVER ({NEW}) - 1 AS rn FROM assets), k AS (SELECT * FROM r WHERE {_REFINED_SQL}) SELECT asset_id, row_number() OVER ({NEW}) - 1 AS position, (SELECT count(*) FROM k WHERE rn < 2000) AS start_index FROM k", *_A),
    "keyword_video": with_views("SELECT asset_id FROM assets WHERE media_type = 2", *_A),
    "keyword_year": with_views("SELECT asset_id FROM assets WHERE year(created) = 1997", *_A),
    "album_title_search": with_views("SELECT album_id, title, kind = 'shared' AS shared FROM albums WHERE contains(lower(title), 'supplier#00000000')", "albums"),
    "on_this_day": with_views("SELECT asset_id, created FROM assets WHERE month(created) = 6 AND day(created) = 15 AND year(created) < 2001", *_A),
    "unsorted_page": with_views(f", {_UNSORTED} SELECT asset_id FROM uns {NEW} LIMIT 200 OFFSET 100", "assets", "members"),
    "unsorted_count_filtered": with_views(f", {_UNSORTED} SELECT count(*) AS n FROM uns WHERE {_REFINED_SQL}", "assets", "members"),
    "unsorted_rank": with_views(f", {_UNSORTED} SELECT count(*) AS rank FROM uns, (SELECT created AS c, asset_id AS i FROM assets WHERE asset_id = 77) x WHERE created > c OR created = c AND asset_id > i", "assets", "members"),
    "ranked_pages": with_views(f", {_UNSORTED} SELECT asset_id, rank, rank // 200 AS page, rank // 200 * 200 AS page_offset FROM (SELECT asset_id, row_number() OVER ({NEW}) - 1 AS rank FROM uns)", "assets", "members"),
    "page_count": with_views(f", {_UNSORTED} SELECT ceil(count(*) / 200)::BIGINT AS pages FROM uns", "assets", "members"),
    "index_stats": with_views(f", {_UNSORTED} SELECT (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM albums) AS albums, (SELECT count(*) FROM uns) AS unsorted", "assets", "albums", "members"),
    "search_index_stats": with_views("SELECT count(*) AS total, count(vector) AS embedded, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending' AND retry_at > TIMESTAMP '2024-01-01') AS waiting, count(latitude) AS with_location, count(text) AS with_text FROM searchable", "searchable"),
    "album_count_refresh": with_views("SELECT asset_id, count(album_id) AS album_count FROM assets LEFT JOIN members USING (asset_id) WHERE asset_id IN (SELECT asset_id FROM changes) GROUP BY asset_id", "assets", "members", "changes"),
    "album_counts": with_views("SELECT asset_id, count(album_id) AS album_count FROM assets LEFT JOIN members USING (asset_id) GROUP BY asset_id", "assets", "members"),
    "album_membership_lookup": with_views("SELECT album_id, title FROM albums WHERE kind = 'user' AND album_id IN (SELECT album_id FROM members WHERE asset_id = 2)", "albums", "members"),
    "membership_guard": with_views("SELECT album_id, asset_id FROM members WHERE asset_id IN (SELECT asset_id FROM assets WHERE asset_id % 3 = 0)", "assets", "members"),
    "reconcile_absent": with_views("SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE asset_id % 5 <> 0)", *_A),
    "album_catalogue": with_views(f", {_CATALOGUE} SELECT album_id, kind, folder_id, asset_count, preview FROM catalogue", "assets", "albums", "members"),
    "album_order": with_views("SELECT album_id, kind, lower(regexp_replace(title, '0+([0-9]{10})$', '\\1')) AS title_key FROM (SELECT album_id, kind, regexp_replace(title, '([0-9]+)', '0000000000\\1') AS title FROM albums)", "albums"),
    "empty_albums": with_views("SELECT album_id FROM albums WHERE kind = 'user' AND album_id NOT IN (SELECT album_id FROM members JOIN assets USING (asset_id))", "albums", "members", "assets"),
    "pinned_albums": with_views("SELECT album_id, (CASE album_id WHEN 4 THEN 0 WHEN 2 THEN 1 ELSE 3 END)::BIGINT AS position FROM albums WHERE album_id IN (4, 2, 9)", "albums"),
    "album_dock": with_views('SELECT album_id, max(ts) AS "at" FROM albums JOIN events ON user_id % 10 = album_id GROUP BY album_id ORDER BY max(ts) DESC, album_id LIMIT 5', "albums"),
    "album_dock_fallback": with_views("SELECT album_id FROM albums ORDER BY lower(title), album_id LIMIT 5", "albums"),
    "library_signature": with_views(f"SELECT 'full|' || count(*) || '|' || (SELECT asset_id FROM assets {NEW} LIMIT 1) || '|' || (SELECT asset_id FROM assets ORDER BY created, asset_id LIMIT 1) AS signature FROM assets", *_A),
    "readiness_gate": with_views("SELECT asset_id FROM assets", *_A),
    "folder_rollup": with_views(f", {_CATALOGUE}, {_FOLDERS} SELECT * FROM rolled", "assets", "albums", "members", recursive=True),
    "empty_folders": with_views(f", {_CATALOGUE}, {_FOLDERS}, e AS (SELECT folder_id FROM rolled WHERE albums = 0) SELECT folder_id FROM folders WHERE folder_id IN (SELECT folder_id FROM e) AND (parent_id IS NULL OR parent_id NOT IN (SELECT folder_id FROM e))", "assets", "albums", "members", recursive=True),
    "folder_previews": with_views(f""", {_CATALOGUE}, {_FOLDERS}, own AS (SELECT folder_id + 100 AS folder_id, arg_min(preview, row({_KEY}, album_id)) AS preview FROM catalogue WHERE folder_id IS NOT NULL AND preview IS NOT NULL GROUP BY 1),
  inside AS (SELECT w.path, unnest(w.path) AS above, o.preview FROM walk w LEFT JOIN own o USING (folder_id)) SELECT above AS folder_id, arg_min(preview, array_to_string(list_transform(path, lambda x: lpad(x::VARCHAR, 6, '0')), '/')) FILTER (WHERE preview IS NOT NULL) AS preview FROM inside GROUP BY 1""", "assets", "albums", "members", recursive=True),
    "unsorted_filtered_page": with_views(f", {_UNSORTED} SELECT asset_id FROM uns WHERE {_REFINED_SQL} {NEW} LIMIT 200 OFFSET 20", "assets", "members"),
    "album_dock_joined": with_views(f"SELECT album_id, row_number() OVER (ORDER BY {_KEY}, album_id) - 1 AS position FROM albums WHERE kind = 'user' AND album_id IN (SELECT album_id FROM members WHERE asset_id = 2)", "albums", "members"),
    "album_dock_starred": with_views("SELECT album_id, row_number() OVER (ORDER BY list_position([7, 1, 2], album_id)) - 1 AS position FROM albums WHERE kind = 'user' AND album_id IN (7, 1, 2) AND contains(lower(title), 'supplier')", "albums"),
    "album_dock_all": with_views(f"SELECT album_id, row_number() OVER (ORDER BY {_KEY} DESC, album_id DESC) - 1 AS position FROM albums WHERE kind = 'user' AND contains(lower(title), '00001')", "albums"),
    "note_search": "SELECT doc_id AS asset_id FROM documents WHERE contains(lower(strip_accents(text)), 'en') ORDER BY 1",
    "folder_outline": with_views(f", {_CATALOGUE}, {_FOLDERS} SELECT folder_id, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM walk", "assets", "albums", "members", recursive=True),
    "thread_rollup": """WITH t AS (SELECT conv_id, turn, count(*) AS n, sum(coalesce(length(text), 0)) AS chars FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL), r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
  SELECT conv_id || ':' || turn AS folder_id, sum(n) OVER w AS albums, sum(chars) OVER w AS assets FROM r WINDOW w AS (PARTITION BY conv_id, run ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "folder_tree": "SELECT r_regionkey AS folder_id, 0 AS depth FROM region UNION ALL SELECT n_nationkey + 100, 1 FROM nation WHERE n_regionkey IN (1, 3)",
    "timeline_year": _timeline_sql("year"),
    "timeline_month": _timeline_sql("month"),
    "timeline_day_journal": _timeline_sql("day", True),
    "anniversary_days": with_views(""", x AS (SELECT asset_id, month(created) AS m, day(created) AS d FROM assets), y AS (SELECT asset_id, make_date(2001, m, least(d, day(last_day(make_date(2001, m, 1))))) AS t, make_date(2002, m, least(d, day(last_day(make_date(2002, m, 1))))) AS n FROM x)
  SELECT asset_id, (CASE WHEN t >= DATE '2001-06-15' THEN t ELSE n END - DATE '2001-06-15')::INT AS days FROM y""", *_A),
    "month_grid": with_views("SELECT DISTINCT dayofweek(date_trunc('month', created))::INT AS blank, day(last_day(created))::INT AS days, date_trunc('month', created)::DATE AS month FROM assets", *_A),
    "random_sample": with_views("SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM members) ORDER BY md5(asset_id || ':7'), asset_id LIMIT 50", "assets", "members"),
    "random_day": with_views("SELECT asset_id, created::DATE AS day FROM assets WHERE created::DATE = (SELECT created::DATE FROM assets WHERE created IS NOT NULL ORDER BY md5(created::DATE::VARCHAR || ':3'), 1 LIMIT 1)", *_A),
    "season_filter": with_views("SELECT asset_id FROM assets WHERE media_type = 1 AND created >= DATE '1997-12-01' AND created < DATE '1998-03-01'", *_A),
    "rolling_window_filter": with_views("SELECT asset_id FROM assets WHERE created >= DATE '2001-06-15' - 90 AND created < DATE '2001-06-15'", *_A),
    "week_filter": with_views("SELECT asset_id FROM assets WHERE created >= DATE '2001-06-04' AND created < DATE '2001-06-11'", *_A),
    "recent_list_lru": 'SELECT user_id % 10 AS album_id, max(ts) AS "at" FROM events GROUP BY 1 ORDER BY max(ts) DESC, album_id LIMIT 8',
    "lru_eviction": with_views(f"SELECT asset_id FROM (SELECT asset_id, sum(coalesce(bytes, 0)) OVER ({NEW} ROWS UNBOUNDED PRECEDING) AS t FROM assets) WHERE t <= 20000000000", *_A),
    "review_queue": with_views("SELECT asset_id, min(sequence) AS position FROM changes WHERE asset_id % 4 <> 0 AND asset_id IN (SELECT asset_id FROM assets) GROUP BY asset_id", "assets", "changes"),
    "decision_tallies": with_views("SELECT op AS decision, count(*) AS n FROM changes GROUP BY op", "changes"),
    "adjacent_pairs": with_views("SELECT sequence, lag(bytes) OVER (PARTITION BY asset_id ORDER BY sequence) AS previous FROM changes", "changes"),
}
