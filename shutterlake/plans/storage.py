"""Registered queries of storage reports, duplicates, and changes to tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import cleanup as C
from ..operators import mutations as M
from ..operators import predicates as P
from ..operators import workspace as W
from ..sources import files as I
from ..sources import tables as S
from ..sources.tables import with_views

NOW = datetime(2024, 1, 1)


def _texts(spark, sf):
    return S.read(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), "text")


def _hashes(spark, sf):
    return C.difference_hash(_texts(spark, sf))


_WORDS = "w AS (SELECT doc_id AS asset_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)"
_HASH = f"""{_WORDS}, c AS (SELECT asset_id, ('0x' || substr(md5(w), 1, 4))::INT % 65 AS b, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT asset_id, map_from_entries(list((b, n))) AS m FROM c GROUP BY asset_id), r AS (SELECT asset_id, round(avg(length(w)), 6) AS ratio FROM w GROUP BY asset_id),
u AS (SELECT asset_id, list_sum(list_transform(range(64), lambda i: CASE WHEN coalesce(m[i::INT], 0) > coalesce(m[(i + 1)::INT], 0) THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)) AS h FROM m),
hashes AS (SELECT asset_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash, ratio FROM u JOIN r USING (asset_id)),
classes AS (SELECT hash, ratio, min(asset_id) AS rep FROM hashes GROUP BY hash, ratio),
pairs AS (SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM classes a JOIN classes b ON a.rep < b.rep AND bit_count(xor(a.hash, b.hash)) <= 5 AND abs(a.ratio - b.ratio) < 0.05)"""
_GROUPS = """reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT r.node, CASE WHEN p.a = r.seen THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON p.a = r.seen OR p.b = r.seen),
placed AS (SELECT h.asset_id, min(seen) AS component FROM hashes h JOIN classes c ON c.hash = h.hash AND c.ratio = h.ratio JOIN reach ON node = c.rep GROUP BY h.asset_id)"""

_CATEGORY = {"screenshots": "subtype & 4 <> 0 AND coalesce(bytes, 0) > 1000000", "large_images": "media_type = 1 AND NOT live AND coalesce(bytes, 0) >= 5000000", "large_videos": "media_type = 2 AND coalesce(bytes, 0) >= 50000000", "large_live": "live AND coalesce(bytes, 0) >= 3000000"}
_HIST = (("<1", "bytes < 1000000"), ("1-5", "bytes >= 1000000 AND bytes < 5000000"), ("5-20", "bytes >= 5000000 AND bytes < 20000000"), ("20-100", "bytes >= 20000000 AND bytes < 100000000"), (">=100", "bytes >= 100000000"))


def _upserts(spark, sf):
    """Every third asset anew, and some that are not there yet."""
    old = S.assets(spark, sf).select("asset_id", "created", "bytes", F.lit(1).alias("album_count"))
    new = old.where("asset_id % 3 = 0").select("asset_id", "created", (F.col("bytes") + 1).alias("bytes"), F.lit(0).alias("album_count"))
    more = old.where("asset_id % 100 = 1").select((-F.col("asset_id")).alias("asset_id"), "created", "bytes", F.lit(0).alias("album_count"))
    return M.upsert(old, new.unionByName(more), "asset_id", keep=("album_count",))


def _table(spark, sf):
    return S.changes(spark, sf).where("sequence % 10 = 0").groupBy("asset_id").agg(F.min("at").alias("at"), F.lit(0).cast("long").alias("bytes"))


_FOLD = '''folded AS (SELECT asset_id, CASE WHEN bool_or(op = 'delete') THEN 'delete' ELSE 'upsert' END AS op, arg_max("at", sequence) AS "at", arg_max(bytes, sequence) AS bytes FROM feed GROUP BY asset_id)'''


_FEED = "feed AS (SELECT * FROM changes)"


def _cascade(part):
    def run(spark, sf):
        gone = S.assets(spark, sf).where("asset_id % 7 = 0")
        return M.delete_cascade(S.assets(spark, sf), S.members(spark, sf), gone)[part].select(*(["asset_id"], ["album_id", "asset_id"])[part])

    return run


def _replacement(spark, sf):
    return S.members(spark, sf).where("album_id < 5").select("album_id", (F.col("asset_id") + 1).alias("asset_id"))


def _replaced(part):
    def run(spark, sf):
        return M.replace_memberships(S.members(spark, sf), S.albums(spark, sf).where("album_id < 5"), _replacement(spark, sf), S.assets(spark, sf))[part]

    return run


_REPLACED = """old AS (SELECT * FROM members WHERE album_id < 5), new AS (SELECT DISTINCT album_id, asset_id + 1 AS asset_id FROM members WHERE album_id < 5 AND asset_id + 1 IN (SELECT asset_id FROM assets)),
whole AS (SELECT album_id, asset_id FROM members WHERE album_id >= 5 UNION ALL SELECT * FROM new)"""


def _removed(part):
    """Assets, vectors and texts without every seventh asset."""

    def run(spark, sf):
        rows = S.searchable(spark, sf)
        gone = rows.where("asset_id % 7 = 0").select("asset_id")
        tables = rows.select("asset_id", "created"), rows.select("asset_id", F.size("vector").alias("dimension")), rows.where("text IS NOT NULL").select("asset_id", F.length("text").alias("n"))
        return M.remove_everywhere(tables, gone)[part]

    return run


def _joined(part):
    """Every third asset, and some unknown ones, put into album 3 under a new title."""

    def run(spark, sf):
        ids = S.assets(spark, sf).where("asset_id % 3 = 0").select("asset_id").union(S.assets(spark, sf).select(-F.col("asset_id")))
        albums = S.albums(spark, sf).select("album_id", "title", "kind")
        return M.join_album(albums, S.members(spark, sf), S.assets(spark, sf), 3, "New title", ids)[part]

    return run


_JOINED = "ids AS (SELECT asset_id FROM assets WHERE asset_id % 3 = 0), whole AS (SELECT album_id, asset_id FROM members UNION SELECT 3, asset_id FROM ids)"


def _history(spark, sf):
    c = S.changes(spark, sf).select("asset_id", "sequence", (F.col("op") == "update").alias("replaced"))
    return W.history(c.where("sequence % 2 = 0"), c.where("sequence % 2 = 1"), at="sequence")


def _slots(spark, sf):
    """Half of the vectors appended to nothing, then all of them to those."""
    rows = S.searchable(spark, sf).select("asset_id", F.col("vector").cast("array<double>").alias("vector"))
    dimension = 64
    first = M.slotted(rows.select("asset_id", F.lit(0).cast("long").alias("slot")).where("false"), rows.where("asset_id % 2 = 0"), dimension)
    return first.unionByName(M.slotted(first, rows, dimension)).select("asset_id", "slot")


def _repicked(spark, sf):
    """Every visited path once; every third asset picked again, and some that were never there."""
    rows = S.changes(spark, sf).select(F.col("asset_id").alias("path"), F.col("sequence").alias("ordinal"), F.col("op").alias("name"))
    picked = S.assets(spark, sf).where("asset_id % 3 = 0").select(F.col("asset_id").alias("path"), F.lit("picked").alias("name"))
    return M.repicked(rows, picked)


def _remote(spark, sf):
    """Albums on servers: every third is renamed twice, and every one gets a neighbour of the same name on server 99."""
    s = S.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("server"), F.col("s_name").alias("path"), F.col("s_suppkey").cast("string").alias("album_id"), F.col("s_name").alias("title"))
    renamed = [s.where("cast(album_id AS int) % 3 = 0").select("server", "path", F.lit(f"name {k}").alias("title"), F.lit(k).alias("seen")) for k in (1, 2)]
    new = s.select(F.lit(99).alias("server"), "path", F.lit("new").alias("title"), F.lit(3).alias("seen"))
    return M.natural_upsert(s, renamed[0].union(renamed[1]).union(new), ["server", "path"], "album_id", "seen")


def _unserved(part):
    """Regions, and the nations of those that stay, without every second region."""

    def run(spark, sf):
        regions = S.read(spark, sf, "region").select(F.col("r_regionkey").alias("server"), F.col("r_name").alias("title"))
        nations = S.read(spark, sf, "nation").select(F.col("n_regionkey").alias("server"), F.col("n_name").alias("title"))
        return M.without_owners(regions, nations, regions.where("server % 2 = 1"), "server")[part]

    return run


def _optimistic(spark, sf):
    """Members added ahead of the sync, and once more by it."""
    more = S.assets(spark, sf).where("asset_id % 3 = 0").select(F.lit(3).cast("long").alias("album_id"), "asset_id")
    state = spark.sql("SELECT true AS indexed, false AS running")
    before = S.members(spark, sf)
    early = M.if_idle(before, M.add_members(before, more, S.assets(spark, sf)), state)
    return M.add_members(early, more, S.assets(spark, sf))


def _listing(spark, sf):
    s = S.read(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit("$"))).otherwise(F.col("s_name"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, F.lit(3)).when(F.col("s_suppkey") % 3 == 1, F.lit(2147483648)).otherwise(F.lit(0))
    return I.shares(s.select(name.alias("name"), kind.alias("type"), F.col("s_nationkey").alias("comment")))


QUERIES = {
    "size_histogram": lambda s, d: C.size_histogram(S.assets(s, d)),
    "daily_storage": lambda s, d: C.daily_storage(S.assets(s, d)),
    "storage_totals": lambda s, d: C.totals(S.assets(s, d)),
    "size_sorted_page": lambda s, d: C.by_size(S.assets(s, d), 200).select("asset_id", "bytes"),
    "size_sorted_smallest": lambda s, d: C.by_size(S.assets(s, d), 200, True).select("asset_id", "bytes"),
    "cleanup_categories": lambda s, d: P.cleanup_categories(S.assets(s, d)),
    "duplicate_groups": lambda s, d: C.exact_duplicates(S.read(s, d, "documents").withColumnRenamed("doc_id", "asset_id")),
    "difference_hash": _hashes,
    "near_duplicate_pairs": lambda s, d: C.near_pairs(C.hash_classes(_hashes(s, d))),
    "near_duplicate_groups": lambda s, d: C.near_groups(_hashes(s, d)),
    "apply_upserts": _upserts,
    "latest_per_key": lambda s, d: M.latest(S.changes(s, d).select("asset_id", "sequence", "op", "bytes"), "asset_id", "sequence"),
    "apply_deletes_assets": _cascade(0),
    "apply_deletes_members": _cascade(1),
    "album_replace_members": _replaced(0),
    "album_replace_counts": _replaced(1),
    "add_members": lambda s, d: M.add_members(S.members(s, d).where("album_id = 3"), S.assets(s, d).where("asset_id % 50 = 0").select(F.lit(3).cast("long").alias("album_id"), (F.col("asset_id") * 3).alias("asset_id")), S.assets(s, d)),
    "remove_assets": _removed(0),
    "remove_vectors": _removed(1),
    "remove_texts": _removed(2),
    "join_album_titles": _joined(0),
    "join_album_members": _joined(1),
    "join_album_counts": _joined(2),
    "retry_backoff": lambda s, d: M.mark_failed(S.searchable(s, d), S.searchable(s, d).where("asset_id % 3 = 0"), NOW).select("asset_id", "status", "failures", "retry_at"),
    "defer_work": lambda s, d: M.defer(S.searchable(s, d), S.searchable(s, d).where("asset_id % 4 = 0"), NOW).select("asset_id", "status", "retry_at"),
    "requeue_all": lambda s, d: M.requeue(S.searchable(s, d)).select("asset_id", "status", "failures", "retry_at"),
    "change_fold": lambda s, d: M.fold(S.changes(s, d)),
    "latest_changes": lambda s, d: M.merge_latest(s.createDataFrame([], M.LATEST), S.changes(s, d)).withColumn("at", F.col("at").cast("timestamp_ntz")),
    "apply_changes": lambda s, d: M.apply_changes(_table(s, d), M.fold(S.changes(s, d))),
    "first_per_path": lambda s, d: M.first_per_path(S.changes(s, d).select("sequence", F.when(F.col("asset_id") % 2 == 0, F.col("asset_id")).alias("path"), F.col("sequence").alias("ordinal")).select("sequence", "path", "ordinal")),
    "compression_history": _history,
    "vector_slots": _slots,
    "repicked_paths": _repicked,
    "remote_albums": _remote,
    "servers_kept": _unserved(0),
    "server_albums_kept": _unserved(1),
    "optimistic_members": _optimistic,
    "share_listing": _listing,
}

ORACLE = {
    "size_histogram": with_views(" UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) FILTER (WHERE {c}) AS n FROM assets" for k, c in _HIST), "assets"),
    "daily_storage": with_views("SELECT created::DATE AS day, sum(coalesce(bytes, 0))::BIGINT AS bytes, count(*) FILTER (WHERE bytes IS NULL) AS unmeasured FROM assets GROUP BY 1", "assets"),
    "storage_totals": with_views("SELECT sum(bytes)::BIGINT AS bytes, count(bytes) AS measured, count(*) AS assets FROM assets", "assets"),
    "size_sorted_page": with_views("SELECT asset_id, bytes FROM assets ORDER BY coalesce(bytes, -1) DESC, asset_id LIMIT 200", "assets"),
    "size_sorted_smallest": with_views("SELECT asset_id, bytes FROM assets ORDER BY coalesce(bytes, -1), asset_id LIMIT 200", "assets"),
    "cleanup_categories": with_views(" UNION ALL ".join(f"SELECT asset_id, bytes, '{k}' AS category FROM assets WHERE {c}" for k, c in _CATEGORY.items()), "assets"),
    "duplicate_groups": "SELECT doc_id AS asset_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL QUALIFY copies > 1",
    "difference_hash": f"WITH {_HASH} SELECT * FROM hashes",
    "near_duplicate_pairs": f"WITH {_HASH} SELECT * FROM pairs",
    "near_duplicate_groups": f"WITH RECURSIVE {_HASH}, {_GROUPS} SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY component) > 1",
    "apply_upserts": with_views("SELECT asset_id, created, CASE WHEN asset_id % 3 = 0 THEN bytes + 1 ELSE bytes END AS bytes, 1 AS album_count FROM assets UNION ALL SELECT -asset_id, created, bytes, NULL FROM assets WHERE asset_id % 100 = 1", "assets"),
    "latest_per_key": with_views("SELECT asset_id, sequence, op, bytes FROM changes QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY sequence DESC) = 1", "changes"),
    "apply_deletes_assets": with_views("SELECT asset_id FROM assets WHERE asset_id % 7 <> 0", "assets"),
    "apply_deletes_members": with_views("SELECT album_id, asset_id FROM members WHERE asset_id % 7 <> 0", "members"),
    "album_replace_members": with_views(f", {_REPLACED} SELECT * FROM whole", "assets", "members"),
    "album_replace_counts": with_views(f", {_REPLACED} SELECT a.asset_id, count(w.album_id) AS album_count FROM (SELECT asset_id FROM old UNION SELECT asset_id FROM new) a LEFT JOIN whole w USING (asset_id) GROUP BY a.asset_id", "assets", "members"),
    "add_members": with_views("SELECT album_id, asset_id FROM members WHERE album_id = 3 UNION SELECT 3, asset_id * 3 FROM assets WHERE asset_id % 50 = 0 AND asset_id * 3 IN (SELECT asset_id FROM assets)", "assets", "members"),
    "remove_assets": with_views("SELECT asset_id, created FROM searchable WHERE asset_id % 7 <> 0", "searchable"),
    "remove_vectors": with_views("SELECT asset_id, len(vector)::INT AS dimension FROM searchable WHERE asset_id % 7 <> 0", "searchable"),
    "remove_texts": with_views("SELECT asset_id, length(text)::INT AS n FROM searchable WHERE asset_id % 7 <> 0 AND text IS NOT NULL", "searchable"),
    "join_album_titles": with_views("SELECT album_id, CASE WHEN album_id = 3 THEN 'New title' ELSE title END AS title, kind FROM albums UNION ALL SELECT 3, 'New title', 'user' WHERE 3 NOT IN (SELECT album_id FROM albums)", "albums"),
    "join_album_members": with_views(f", {_JOINED} SELECT * FROM whole", "assets", "members"),
    "join_album_counts": with_views(f", {_JOINED} SELECT asset_id, count(w.album_id) AS album_count FROM ids LEFT JOIN whole w USING (asset_id) GROUP BY asset_id", "assets", "members"),
    "retry_backoff": with_views("SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 'failed' ELSE status END AS status, (failures + (asset_id % 3 = 0)::INT)::INT AS failures, CASE WHEN asset_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_seconds(least(3600, 30 * pow(2, failures))::INT) ELSE retry_at END AS retry_at FROM searchable", "searchable"),
    "defer_work": with_views("SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN asset_id % 4 = 0 THEN TIMESTAMP '2024-01-01' ELSE retry_at END AS retry_at FROM searchable", "searchable"),
    "requeue_all": with_views("SELECT asset_id, 'pending' AS status, 0 AS failures, NULL::TIMESTAMP AS retry_at FROM searchable", "searchable"),
    "change_fold": with_views(f", {_FEED}, {_FOLD} SELECT * FROM folded", "changes"),
    "latest_changes": with_views("""SELECT asset_id, sequence, op = 'delete' AS gone, "at", bytes FROM changes QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY sequence DESC) = 1""", "changes"),
    "apply_changes": with_views(f''', {_FEED}, {_FOLD}, t AS (SELECT asset_id, min("at") AS "at", 0::BIGINT AS bytes FROM changes WHERE sequence % 10 = 0 GROUP BY asset_id) SELECT asset_id, "at", bytes FROM t WHERE asset_id NOT IN (SELECT asset_id FROM folded) UNION ALL SELECT asset_id, "at", bytes FROM folded WHERE op = 'upsert' ''', "changes"),
    "first_per_path": with_views(", p AS (SELECT sequence, CASE WHEN asset_id % 2 = 0 THEN asset_id END AS path, sequence AS ordinal FROM changes) SELECT * FROM p QUALIFY path IS NULL OR row_number() OVER (PARTITION BY path ORDER BY ordinal) = 1", "changes"),
    "compression_history": with_views(", h AS (SELECT asset_id, sequence, op = 'update' AS replaced FROM changes) SELECT * FROM h QUALIFY NOT replaced OR row_number() OVER (PARTITION BY asset_id, replaced ORDER BY sequence DESC) = 1", "changes"),
    "vector_slots": with_views("SELECT asset_id, row_number() OVER (ORDER BY asset_id % 2, asset_id) - 1 AS slot FROM searchable", "searchable"),
    "repicked_paths": with_views(""", f AS (SELECT asset_id AS path, min(sequence) AS ordinal, arg_min(op, sequence) AS name FROM changes GROUP BY 1), p AS (SELECT asset_id AS path FROM assets WHERE asset_id % 3 = 0)
SELECT path, ordinal, CASE WHEN path IN (SELECT path FROM p) THEN 'picked' ELSE name END AS name FROM f UNION ALL SELECT path, NULL, 'picked' FROM p WHERE path NOT IN (SELECT path FROM f)""", "changes", "assets"),
    "remote_albums": """SELECT s_nationkey AS server, s_name AS path, s_suppkey::VARCHAR AS album_id, CASE WHEN s_suppkey % 3 = 0 THEN 'name 2' ELSE s_name END AS title FROM supplier
UNION ALL SELECT 99, s_name, md5('["99","' || s_name || '"]'), 'new' FROM supplier""",
    "servers_kept": "SELECT r_regionkey AS server, r_name AS title FROM region WHERE r_regionkey % 2 = 0",
    "server_albums_kept": "SELECT n_regionkey AS server, n_name AS title FROM nation WHERE n_regionkey % 2 = 0",
    "optimistic_members": with_views("SELECT album_id, asset_id FROM members UNION SELECT 3, asset_id FROM assets WHERE asset_id % 3 = 0", "members", "assets"),
    "share_listing": "SELECT s_name AS name, s_nationkey AS comment FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0",
}
