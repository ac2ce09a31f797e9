"""Edge cases of operators and functions on small tables."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shutterlake import catalog
from shutterlake.functions import dates, geo, text, vectors
from shutterlake.operators import cleanup, library, metrics, mutations, places, predicates, search, timeline, workspace
from shutterlake.operators.components import connected_components
from shutterlake.sources import files
from shutterlake.streaming import changes

from .conftest import SF


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ASSETS = "asset_id long, created timestamp, media_type int, favorite boolean, bytes long, width int, height int, subtype int, live boolean"


@pytest.fixture
def assets(spark):
    d = datetime
    return spark.createDataFrame(
        [(1, d(2020, 1, 1), 1, True, 10, 4, 3, 0, False), (2, d(2020, 1, 1), 1, False, None, 3, 4, 4, False), (3, d(2020, 2, 2), 2, True, 30, 20, 20, 1, True), (4, None, 1, False, 40, 0, 0, 0, False)], ASSETS
    )


def test_normalise(spark):
    said = spark.createDataFrame([("  Invoice   #12345  ",), ("ＩＮＶＯＩＣＥ",), ("   ",), (None,), ("你好",)], "t string")
    assert [r[0] for r in said.select(text.normalise(F.col("t"))).collect()] == ["invoice #12345", "invoice", None, None, "你好"]


def test_trigrams_and_natural_key(spark):
    df = spark.createDataFrame([("abcab\n",), ("ab",), ("",)], "t string")
    assert [r[0] for r in df.select(text.trigrams(F.col("t"))).collect()] == [["abc", "bca", "cab", "ab\n"], [], []]
    names = spark.createDataFrame([("Trip 10",), ("trip 9",), ("Trip 9b",)], "t string")
    assert [r[0] for r in names.orderBy(text.natural_key(F.col("t"))).collect()] == ["trip 9", "Trip 9b", "Trip 10"]


def test_box_and_poles(spark):
    def box(*at):
        return spark.range(1).select(*(v.alias(k) for k, v in geo.box(*at).items())).first().asDict()

    near = box(39.9042, 0.0, 250.0)
    assert round(near["north"] - 39.9042, 3) == 2.246 and round(near["east"], 3) == 2.927 or round(near["east"], 2) == 2.93
    assert box(89.9, 10.0, 500.0)["north"] == 90.0
    assert box(0.0, 179.9, 100.0)["crosses"] and box(0.0, 179.9, 100.0)["west"] == -180.0


def test_anniversary_of_leap_day(spark):
    df = spark.createDataFrame([(date(2020, 2, 29),), (date(2020, 3, 1),)], "d date")
    assert [r[0] for r in df.select(dates.days_until_next(F.col("d"), F.lit(date(2023, 2, 28)))).collect()] == [0, 1]
    assert dates.season_range(2023, "winter") == (datetime(2023, 12, 1), datetime(2024, 3, 1))
    assert dates.month_range(datetime(2024, 1, 31), -1) == (datetime(2023, 12, 1), datetime(2024, 1, 1))
    assert dates.week_range(datetime(2024, 1, 3), 0, 6)[0] == datetime(2023, 12, 31)


def test_slideshow_filters(assets):
    ids = lambda f: [r[0] for r in values(assets.where(f.column()).select("asset_id"))]
    assert ids(predicates.SlideshowFilter("square")) == [3]
    assert ids(predicates.SlideshowFilter("high_quality")) == [1, 2, 3, 4]
    assert ids(predicates.SlideshowFilter("all", no_screenshots=True, photos_only=True)) == [1, 4]
    assert assets.where(predicates.keyword("1800")).count() == 0 and assets.where(predicates.keyword("nonsense")).count() == 0


def test_rank_of_counts_rows_ahead_whether_or_not_the_row_passes(assets):
    assert library.rank_of(assets.where("media_type = 1"), assets, 1).first()[0] == 1
    assert library.rank_of(assets, assets, 99).first()[0] == 0
    assert [r.asset_id for r in library.ranked(assets).orderBy("rank").collect()] == [3, 2, 1, 4]


def test_folders_with_a_cycle(spark):
    folders = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 77)], "folder_id int, parent_id int")
    paths = {r.folder_id: (r.depth, list(r.path)) for r in library.folder_paths(folders).collect()}
    assert paths == {1: (0, [1]), 2: (1, [1, 2]), 3: (0, [3]), 4: (0, [4]), 5: (0, [5])}


def test_timeline_leaves_out_missing_dates(assets):
    got = {r.start.month: (r.n, list(r.preview)) for r in timeline.timeline(assets, "month").collect()}
    assert got == {1: (2, [2, 1]), 2: (1, [3])}


def test_search_fixture(spark):
    encoder = search.ConceptEncoder(["cat", "beach", "invoice", "dog"])
    rows = [(1, "cat"), (2, "cat beach"), (3, "cat dog"), (4, "dog beach"), (5, "beach"), (6, "invoice")]
    df = spark.createDataFrame([(i, t, encoder.encode(t), datetime(2020 + i, 6, 15), 1) for i, t in rows], "asset_id long, text string, vector array<double>, created timestamp_ntz, media_type int")
    found = lambda **r: [x.asset_id for x in search.search(df, search.Search(**r)).collect()]
    cat, beach, dog = (encoder.encode(w) for w in ("cat", "beach", "dog"))
    assert found(positive=[cat, beach]) == [2]
    assert found(positive=[cat], negative=[dog]) == [1, 2]
    assert found(negative=[dog]) == []
    assert found() == []
    assert found(constrained=True, filter=predicates.CandidateFilter(after=datetime(2024, 1, 1))) == [6, 5, 4]
    assert [(r.asset_id, round(r.score, 4)) for r in search.similar(df, 2).collect()] == [(1, 0.7071), (5, 0.7071), (3, 0.5), (4, 0.5)]
    assert search.similar(df, 99).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        search.top_k(df, [1.0, 0.0], 3).collect()


def test_similar_compares_the_newest_candidates(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 10], datetime(2020, 1, 10 - i // 2)) for i in range(8)], "asset_id long, vector array<double>, created timestamp_ntz")
    monkeypatch.setattr(search, "MOST_CANDIDATES", 2)
    assert [r.asset_id for r in search.similar(df, 1).collect()] == [3, 0]  # 0 is the newest; of 2 and 3, of one day, the larger id counts


def test_similar_compares_all_assets(spark):
    n = search.MOST_CANDIDATES + 3
    older = F.timestamp_add("SECOND", -F.col("asset_id").cast("int"), F.lit("2020-01-01").cast("timestamp"))
    df = spark.range(n).select(F.col("id").alias("asset_id")).select("asset_id", F.array(F.lit(1.0), F.col("asset_id") / n).alias("vector"), older.alias("created"))
    assert [r.asset_id for r in search.similar(df, n - 1, 3, whole=True).collect()] == [n - 2, n - 3, n - 4]  # the most alike are the oldest


def test_similar_items_has_no_most_candidates(spark, oracle, rows, monkeypatch):
    monkeypatch.setattr(search, "MOST_CANDIDATES", 2)  # the SQL has 50,000, more than these tables
    assert rows(catalog.queries()["similar_items"](spark, SF).toPandas()) == rows(oracle.sql(catalog.oracle_sql()["similar_items"]).df())


def test_keys_of_near_pairs_are_not_broadcast(spark):
    """The table of classes is small enough for a broadcast; that of its keys, many times as large, has no size that Spark knows."""
    df = spark.createDataFrame([(i, i * 7919, 4.0) for i in range(50)], "rep long, hash long, ratio double")
    plan = cleanup.near_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_groups_do_not_broadcast_classes(spark):
    """As its keys, the classes and components of near groups are merged; the plan that Spark ended with counts, of the pairs too."""
    df = spark.createDataFrame([(i, i // 2 * 7919, 4.0) for i in range(50)], "asset_id long, hash long, ratio double")
    groups, pairs = cleanup.near_groups(df), cleanup.near_pairs(cleanup.hash_classes(df))
    assert "BroadcastHashJoin" not in groups._jdf.queryExecution().executedPlan().toString()
    assert len(values(groups)) == 50
    assert values(pairs)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_scores_keep_null_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "k long, v array<double>")
    assert values(df.select("k", vectors.scores(F.col("v"), [[1.0, 1.0], [0.0, 1.0]]))) == [(1, [3.0, 2.0]), (2, None), (3, [1.0, 1.0])]


def test_near_pairs_equal_brute_force(spark):
    hashes = [(i, h, 1.0) for i, h in enumerate([0, 1, 0b11111, 0b111111, -1, -2, 1 << 63, 0x0101010101010101 - (1 << 63)])]
    hashes = [(i, h if h < 1 << 63 else h - (1 << 64), r) for i, h, r in hashes]
    df = spark.createDataFrame(hashes, "rep long, hash long, ratio double")
    far = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    want = sorted((a[0], b[0], far(a[1], b[1])) for a in hashes for b in hashes if a[0] < b[0] and far(a[1], b[1]) <= 5)
    assert values(cleanup.near_pairs(df)) == want


def test_empty_histogram_keeps_buckets(assets):
    assert values(cleanup.size_histogram(assets.where("false"))) == sorted((b, 0) for b, _, _ in cleanup.BUCKETS)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "a long, b long")
    assert values(connected_components(edges)) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def test_components_of_a_long_chain(spark):
    ids = random.Random(1).sample(range(10_000), 3000)
    rows = connected_components(spark.createDataFrame([*zip(ids, ids[1:]), (20_000, 20_001), (20_001, None), (7_000_000, 7_000_000)], "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows}) == 3002
    assert {r.component for r in rows if r.node < 20_000} == {min(ids)} and {r.component for r in rows if r.node >= 20_000} == {20_000}


def test_near_pairs_of_neighbouring_bands(spark):
    rng = random.Random(2)
    hashes = [(i, rng.getrandbits(64) - (1 << 63) if i % 4 else 1 << rng.randrange(20), round(rng.choice([4.0, 4.04, 4.05, 4.07, 4.1]) + rng.random() / 100, 6)) for i in range(300)]
    hashes += [(1000 + i, h ^ (1 << rng.randrange(60)), r + 0.01) for i, h, r in hashes]
    df = spark.createDataFrame(hashes, "rep long, hash long, ratio double")
    far = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    want = sorted((a[0], b[0], far(a[1], b[1])) for a in hashes for b in hashes if a[0] < b[0] and far(a[1], b[1]) <= 5 and abs(a[2] - b[2]) < 0.05)
    for parts in (None, 6, 8):
        assert sorted(values(cleanup.near_pairs(df, parts=parts))) == want and len(want) > 300


def test_empty_albums_and_folders(spark):
    folders = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (5, None)], "folder_id int, parent_id int")
    counts = spark.createDataFrame([(2, 1, 7)], "folder_id int, albums long, assets long")
    assert values(library.empty_folders(folders, counts)) == [(3,), (5,)]
    previews = spark.createDataFrame([(4, 1, "b 10", 70), (4, 2, "b 9", 71), (2, 3, "z", None), (1, 4, "x", None)], "folder_id int, album_id long, title string, preview long")
    assert values(library.folder_previews(folders, previews)) == [(1, 71), (2, None), (3, 71), (4, 71), (5, None)]
    albums = spark.createDataFrame([(1, "user", 0), (2, "user", 3), (3, "shared", 0)], "album_id long, kind string, asset_count long")
    assert values(library.empty_albums(albums).select("album_id")) == [(1,)]


def test_dock_lists(spark):
    albums = spark.createDataFrame([(1, "b 10", "user"), (2, "b 9", "user"), (3, "a", "smart"), (4, "C", "user")], "album_id long, title string, kind string")
    ids = lambda df: [r.album_id for r in df.orderBy("position").collect()]
    visits = spark.createDataFrame([(4, datetime(2024, 1, 2)), (1, datetime(2024, 1, 1)), (3, datetime(2024, 1, 3))], "album_id long, at timestamp")
    assert ids(library.dock_list(albums, "all")) == [2, 1, 4] and ids(library.dock_list(albums, "all", reverse=True)) == [4, 1, 2]
    assert ids(library.dock_list(albums, "starred", starred=[4, 3, 9, 2])) == [4, 2]
    assert ids(library.dock_list(albums, "recent", visits=visits)) == [4, 1] and ids(library.dock_list(albums, "recent", visits=visits.where("false"))) == [2, 1, 4]
    assert ids(library.dock_list(albums, "joined", joined=visits, query=" B ")) == [1]
    with pytest.raises(ValueError):
        library.dock_list(albums, "other")


def test_join_album_makes_it(spark):
    albums = spark.createDataFrame([(1, "a", "user")], "album_id long, title string, kind string")
    members = spark.createDataFrame([(1, 10)], "album_id long, asset_id long")
    known, ids = spark.createDataFrame([(10,), (11,)], "asset_id long"), spark.createDataFrame([(10,), (11,), (11,), (99,)], "asset_id long")
    got = [values(t) for t in mutations.join_album(albums, members, known, 2, "b", ids)]
    assert got == [[(1, "a", "user"), (2, "b", "user")], [(1, 10), (2, 10), (2, 11)], [(10, 2), (11, 1)]]
    assert values(mutations.join_album(albums, members, known, 1, "c", ids)[0]) == [(1, "c", "user")]


def test_fold_of_a_deleted_asset_that_comes_again(spark):
    feed = spark.createDataFrame([(1, datetime(2024, 1, 1), 10, "delete", 1), (2, datetime(2024, 1, 2), 10, "insert", 2), (3, datetime(2024, 1, 3), 11, "update", 3)], "sequence long, at timestamp, asset_id long, op string, bytes long")
    assert {r.asset_id: r.op for r in mutations.fold(feed).collect()} == {10: "delete", 11: "upsert"}


def test_notes_and_model_versions(spark):
    rows = spark.createDataFrame([(2, "Le CAFÉ", "a"), (1, "cafe\u0301 noir", "b"), (3, None, None), (4, "tea", "a")], "asset_id long, note string, model_version string")
    assert [r.asset_id for r in predicates.note_search(rows, " Cafè ").collect()] == [1, 2] and predicates.note_search(rows, " ").count() == 0
    assert values(predicates.same_model(rows, "a").select("asset_id")) == [(2,), (4,)]


def test_longest_exact_place(spark):
    said = [("a", "sunset Tokyo tower"), ("b", "在北京市的猫"), ("c", "x"), ("d", None), ("e", "no such one"), ("f", "rome and paris"), ("g", "PARIS")]
    got = {r.request_id: (r.place, r.at, r.length, r.remainder) for r in places.longest_exact(spark.createDataFrame(said, "request_id string, clause string"), places.gazetteer(spark)).collect()}
    assert got["a"] == ("Tokyo", 7, 7, "sunsettower")  # the spaces around the name go with it
    assert got["b"] == ("Beijing", 2, 3, "在的猫") and got["f"][0] == "Paris" and got["g"] == ("Paris", 1, 5, "") and set(got) == {"a", "b", "f", "g"}


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k long, v string, n int")
    new = spark.createDataFrame([(2, None, 0), (3, "c", 0)], "k long, v string, n int")
    assert values(mutations.upsert(old, new, "k", keep=("n",))) == [(1, "a", 7), (2, None, 8), (3, "c", None)]


def test_places(spark):
    said = spark.createDataFrame([("tokyo city",), ("Paris in spring",), ("zz",), (None,)], "mention string")
    got = {r.mention: (r.place, r.tier) for r in places.resolve(said, places.gazetteer(spark)).collect()}
    assert got == {"tokyo city": ("Tokyo", 2), "Paris in spring": ("Paris", 3), "zz": (None, None), None: (None, None)}
    bad = spark.createDataFrame([("a", "A", 95.0, 0.0, 1.0), ("a", "B", 0.0, 0.0, 0.0)], "key string, place string, latitude double, longitude double, radius double")
    assert values(places.validate(bad)) == [("A", "coordinates"), ("A", "name: a"), ("B", "name: a"), ("B", "radius")]


def test_budget_takes_no_file_that_crosses(assets):
    assert values(workspace.within_budget(assets, 35).select("asset_id")) == [(2,), (3,)]


def test_metrics(spark):
    scored = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.8), ("q", 3, 0.8)], "query string, item long, score double")
    relevant = spark.createDataFrame([("q", 2), ("p", 1)], "query string, item long")
    got = {r.query: r for r in metrics.retrieval(metrics.ranks(scored), relevant, 2).collect()}
    assert (got["q"].hit_at_1, got["q"].recall, got["q"].reciprocal_rank, got["q"].ndcg) == (0, 1.0, 0.5, 0.63093)
    assert got["p"].ndcg == 0.0


def test_ranks_of_a_large_query_are_spread(spark):
    from pyspark.sql import functions as F

    scored = spark.range(4000).select(F.when(F.col("id") < 3900, "q").alias("query"), F.col("id").alias("item"), (F.col("id") % 3).cast("double").alias("score"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = metrics.ranks(scored)
        got, plan = {(r.query, r.item): r.rank for r in ranked.collect()}, ranked._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    for query, items in (("q", range(3900)), (None, range(3900, 4000))):
        best = sorted(items, key=lambda x: (-(x % 3), x))
        assert [got[query, x] for x in best] == list(range(1, len(best) + 1))
    assert "row_number() windowspecdefinition(query" not in plan or "_range" in plan.split("row_number() windowspecdefinition(query")[1][:40]


def test_folder_source(spark, tmp_path):
    for name in ("a.JPG", "sub/b.png", "sub/.hidden.png", ".dir/c.png", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert values(files.folder(spark, str(tmp_path)).select("name", "folder", "size")) == [("a.JPG", "", 1), ("b.png", "sub", 1)]


def test_snapshot_and_log(spark, tmp_path):
    albums = spark.createDataFrame([(1, "x"), (2, "y")], "album_id long, title string")
    files.save_albums(albums, str(tmp_path / "s"))
    known = spark.createDataFrame([(2,)], "album_id long")
    assert values(files.restore_albums(spark, str(tmp_path / "s"), "album_id long, title string", known)) == [(2, "y")]
    with pytest.raises(ValueError):
        files.restore_albums(spark, str(tmp_path / "s"), "album_id long, title string", known, version=2)


LOG = """eval|cats|old.png:0.9
  eval|cats|a.png:0.5 C:b.png:-0.25 nothing x:y c.png:1e-1
similar|a.png|b.png:0.75
eval|none|
12:00 eval|skipped|a:1
evalplan|cats|candidates=3|combine=and=or|bare|candidates=4
evalmeta|cats|a.png|1.5,-2.0,2024-01-01,late
evalmeta|cats|b.png|
"""


def test_log(spark):
    lines = spark.createDataFrame([*enumerate(LOG.splitlines()), (99, None), (100, "")], "n int, value string")
    hits = [("eval", "cats", 1, "a.png", 0.5), ("eval", "cats", 2, "C:b.png", -0.25), ("eval", "cats", 3, "c.png", 0.1)]
    assert values(files.evaluation_log(lines, order="n")) == [*hits, ("similar", "a.png", 1, "b.png", 0.75)]
    assert ("eval", "cats", 1, "old.png", 0.9) in values(files.evaluation_log(lines))
    plan = [("cats", "bare", ""), ("cats", "candidates", "4"), ("cats", "combine", "and=or")]
    assert values(files.evaluation_plans(lines, order="n")) == plan
    assert values(files.evaluation_meta(lines)) == [("cats", "a.png", "1.5", "-2.0", "2024-01-01,late"), ("cats", "b.png", "", "", "")]


def test_vectors_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    schema = "asset_id long, vector array<double>"
    files.append_vectors(spark, path, spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 1.0]), (9, [1.0]), (8, None)], schema), 2)
    for _ in range(2):
        files.append_vectors(spark, path, spark.createDataFrame([(7, [5.0, 5.0]), (1, [0.5, 0.5])], schema), 2)
    assert values(files.stored_vectors(spark, path)) == [(1, [0.5, 0.5], 2), (3, [1.0, 1.0], 0), (7, [1.0, 0.0], 1)]


def test_early_change_waits_for_a_run(spark):
    before, after = spark.range(1), spark.range(2)
    for indexed, running, n in ((True, False, 2), (True, True, 1), (False, False, 1), (None, None, 1)):
        state = spark.createDataFrame([(indexed, running)], "indexed boolean, running boolean")
        assert mutations.if_idle(before, after, state).count() == n
    assert mutations.if_idle(before, after, spark.createDataFrame([], "indexed boolean, running boolean")).count() == 1


def test_natural_keys(spark):
    schema = "server string, path string, album_id string, title string"
    old = spark.createDataFrame([("s", "/a", "1", "A"), ("s", "/b", "2", "B")], schema)
    new = spark.createDataFrame([("s", "/a", "A2", 2), ("s", "/a", "A1", 1), ("t", "/a", "T", 1)], "server string, path string, title string, seen int")
    got = {(r.server, r.path): (r.album_id, r.title) for r in mutations.natural_upsert(old, new, ["server", "path"], "album_id", "seen").collect()}
    assert got["s", "/a"] == ("1", "A2") and got["s", "/b"] == ("2", "B") and len(got["t", "/a"][0]) == 32
    owners, owned = mutations.without_owners(old.select("server").distinct(), old, spark.createDataFrame([("s",)], "server string"), "server")
    assert owners.count() == owned.count() == 0


def test_shares(spark):
    rows = [("Photo 10", 0, "x"), ("photo 9", 0x80000000, None), ("IPC$", 3, ""), ("C$", 0, ""), ("printer", 1, ""), (None, 0, ""), ("n", None, "")]
    assert [r.name for r in files.shares(spark.createDataFrame(rows, "name string, type long, comment string")).collect()] == ["photo 9", "Photo 10"]


def test_progress_is_told_at_a_bounded_rate():
    from types import SimpleNamespace as N

    from shutterlake.streaming.progress import Progress

    now, told = [0.0], []
    p = Progress(lambda *x: told.append(x), clock=lambda: now[0])
    p.onQueryStarted(N(id="q"))
    for batch, at in enumerate((0.0, 0.1, 0.24, 0.25, 0.3, 0.6)):
        now[0] = at
        p.onQueryProgress(N(progress=N(id="q", batchId=batch, numInputRows=5)))
    p.onQueryTerminated(N(id="q"))
    assert [(e, b) for e, _, b, _ in told] == [("started", -1), ("progress", 0), ("progress", 3), ("progress", 5), ("ended", -1)]


def test_stream_of_changes(spark, tmp_path):
    feed = [(1, datetime(2024, 1, 1), 10, "insert", 5), (2, datetime(2024, 1, 1, 1), 11, "insert", 6), (3, datetime(2024, 1, 1, 2), 10, "delete", None), (4, datetime(2024, 1, 1, 3), 10, "update", 9)]
    schema = "sequence long, at timestamp_ntz, asset_id long, op string, bytes long"
    source, table = str(tmp_path / "in"), changes.SnapshotTable(spark, str(tmp_path / "table"))
    assert table.read().count() == 0
    spark.createDataFrame(feed, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    changes.apply_stream(stream, table, str(tmp_path / "cp")).awaitTermination(120)
    assert values(table.read().select("asset_id", "bytes")) == [(11, 6)]
    spark.createDataFrame([(5, datetime(2024, 1, 2), 12, "insert", 1)], schema).write.mode("append").parquet(source)
    changes.apply_stream(stream, table, str(tmp_path / "cp")).awaitTermination(120)
    assert values(table.read().select("asset_id", "bytes")) == [(11, 6), (12, 1)] and table.version == 1
    assert not table.publish(table.read(), 1)
    assert changes.rebuild(table, table.read(0)) == 2 and values(table.read().select("asset_id")) == [(11,)]


def test_index_step_contains_failures(spark):
    rows = [(1, "ok", "pending", None, 0, None), (2, "bad", "failed", datetime(2024, 1, 1), 3, None), (3, "ok", "failed", datetime(2025, 1, 1), 1, None), (4, "ok", "ready", None, 0, [1.0])]
    df = spark.createDataFrame(rows, "asset_id long, text string, status string, retry_at timestamp_ntz, failures int, vector array<float>")

    def encode(said):
        if said == "bad":
            raise ValueError(said)
        return [0.5]

    got = {r.asset_id: r for r in mutations.index_step(df, encode, datetime(2024, 6, 1)).collect()}
    assert {k: (r.status, r.failures, r.vector) for k, r in got.items()} == {1: ("ready", 0, [0.5]), 2: ("failed", 4, None), 3: ("failed", 1, None), 4: ("ready", 0, [1.0])}
    assert got[2].retry_at == datetime(2024, 6, 1, 0, 4)


def test_store_text_and_observed(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, "old", None)], "asset_id long, text string, vector array<double>")
    texts = spark.createDataFrame([(1, ["A  b", " c "]), (2, [])], "asset_id long, lines array<string>")
    assert values(mutations.store_text(df, texts, 2).select("asset_id", "text", "text_version")) == [(1, "a b c", 2), (2, None, 2)]
    rows, seen = search.observed(df)
    rows.collect()
    assert seen.get == {"candidates": 2, "scored": 1}


def test_progress(spark):
    df = spark.createDataFrame([(1, 2, False), (5, 2, False), (0, 0, True), (0, 0, False)], "done int, total int, finished boolean")
    assert [r[0] for r in df.select(workspace.progress(F.col("done"), F.col("total"), F.col("finished"))).collect()] == [0.5, 1.0, 1.0, 0.0]
