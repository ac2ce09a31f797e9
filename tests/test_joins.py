"""Places against all assets, tables of queries against all vectors, names in clauses, members of clusters, order statistics."""

from __future__ import annotations

import math
import random
import re
import time
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake import catalog
from shutterlake.functions import vectors
from shutterlake.operators import metrics, mutations, places, predicates, search
from shutterlake.sources import tables

from .conftest import SF


def boxed(lat, lon, km, wrap, x, y):
    d, e = km / 111.32, km / (111.32 * max(math.cos(math.radians(lat)), 0.01))
    if not max(lat - d, -90) <= x <= min(lat + d, 90):
        return False
    if e >= 180 or not wrap and (lon - e < -180 or lon + e > 180):
        return True
    return any(lon - e <= y + turn <= lon + e for turn in ((-360, 0, 360) if wrap else (0,)))


@pytest.mark.parametrize("wrap", [True, False])
def test_places_against_assets(spark, wrap):
    rng = random.Random(3)
    spots = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([0.0, 5.0, 60.0, 900.0, 4000.0])) for i in range(60)]
    spots += [("fiji", -17.7, 178.0, 250.0), ("west", 51.0, -179.9, 40.0), ("pole", 89.9, 10.0, 50.0), ("globe", 0.0, 0.0, 25_000.0), ("edge", 0.0, 180.0, 0.0)]
    points = [(i, rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), rng.uniform(176, 180), rng.uniform(-180, -176)])) for i in range(400)]
    points += [(1000 + i, lat, lon) for i, (_, lat, lon, _) in enumerate(spots)] + [(2000, -90.0, -180.0), (2001, 90.0, 180.0)]
    odd_places = [("none", None, 1.0, 5.0), ("far", 95.0, 0.0, 5.0), ("less", 1.0, 1.0, -3.0), ("unknown", 1.0, 1.0, None), spots[0]]
    odd_points = [(3000, None, 1.0), (3001, 1.0, None), (3002, 91.0, 0.0)]
    got = places.located(
        spark.createDataFrame([(*p, "x") for p in points + odd_points], "asset_id long, latitude double, longitude double, tall string"),
        spark.createDataFrame([(*s, 7) for s in spots + odd_places], "place string, latitude double, longitude double, radius double, row int"),
        wrap,
    )
    want = sorted((name, i) for name, lat, lon, km in spots for i, x, y in points if boxed(lat, lon, km, wrap, x, y))
    assert sorted((r.place, r.asset_id) for r in got.collect()) == want


@pytest.mark.parametrize(("k", "block", "group"), [(1, 1024, 64), (5, 16, 2), (70, 16, 1), (0, 16, 2)])
def test_table_of_queries(spark, monkeypatch, k, block, group):
    """Many equal vectors, so that ties decide; more groups than one on either side."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors.packed, "__defaults__", (block,))
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 6))
    rows = [(int(i), base[i % 20].tolist() if i % 3 else rng.normal(size=6).tolist()) for i in rng.permutation(200)]
    table = spark.createDataFrame([*rows, (500, None), (None, rows[0][1])], "asset_id long, vector array<double>").repartition(3)
    asked = table.where("asset_id % 4 = 0")
    want = []
    for q, v in rows:
        if q % 4 == 0:
            scored = sorted((-round(float(np.dot(v, w)), 6), i) for i, w in rows)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    got = sorted((r.query, r.rank, r.item, r.score) for r in search.top_k_each(asked, table, k).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)
    if k == 5:
        assert vectors.scored(asked, table, None, "asset_id").count() == 50 * 200
        assert search.top_k_each(asked, table.where("false"), 5).collect() == search.top_k_each(asked.where("false"), table, 5).collect() == []


def brute(ranking, relevant, k):
    """(hit_at_1, recall, reciprocal_rank, ndcg) of items, best first."""
    at = [n for n, i in enumerate(ranking, 1) if i in relevant]
    gain = lambda rs: sum(1 / np.log2(r + 1) for r in rs if r <= k)
    return int(at[:1] == [1]), len([n for n in at if n <= k]) / len(relevant), 1 / at[0] if at else 0.0, gain(at) / gain(range(1, len(relevant) + 1))


def blocks_of(monkeypatch, block, group):
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors.packed, "__defaults__", (block,))


@pytest.mark.parametrize(("k", "block", "group"), [(1, 1024, 64), (5, 16, 2), (300, 16, 1)])
def test_retrieval_by_label(spark, monkeypatch, k, block, group):
    """Ties between equal vectors, labels whose best item is far down, of one item only, and null."""
    blocks_of(monkeypatch, block, group)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4))
    rows = [(int(i), (base[i % 12] if i % 3 else rng.normal(size=4)).tolist(), None if i % 28 == 0 else 50 if i == 8 else int(i % 7 if i % 4 else 100 + i % 3)) for i in rng.permutation(200)]
    table = spark.createDataFrame(rows, "asset_id long, vector array<double>, label int").repartition(3)
    asked = table.where("asset_id % 4 = 0").withColumn("label", F.when(F.col("asset_id") == 12, 3).otherwise(F.col("label")))
    want = {}
    for q, v, label in rows:
        label = 3 if q == 12 else label
        if q % 4 == 0 and label is not None:
            want[q] = brute([i for _, i in sorted((-round(float(np.dot(v, w)), 6), i) for i, w, _ in rows)], {i for i, _, x in rows if x == label}, k)
    got = {r.query: tuple(r)[1:] for r in metrics.retrieval_by_label(asked, table, k).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], atol=2e-6) for q in want)
    assert k > 1 or any(0 < w[2] < 0.1 for w in want.values())


@pytest.mark.parametrize(("enough", "block", "group"), [(512, 1024, 64), (1, 16, 2)])
def test_agreement_of_two_rankings(spark, monkeypatch, enough, block, group):
    """Many items of one score, so that the top quarter ends between equal ones; the other ranking is turned around for some."""
    blocks_of(monkeypatch, block, group)
    monkeypatch.setattr(metrics, "ENOUGH", enough)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 4))
    rows = [(int(i) * 1000 - 3, (base[i % 3] if i % 4 else rng.normal(size=4)).tolist()) for i in rng.permutation(301)]
    table = spark.createDataFrame([*rows, (7, None), (None, rows[0][1])], "asset_id long, vector array<double>").repartition(3)
    other = lambda score, items: np.round(-score + items % 7 / 50, 6)
    want = {}
    for q, v in rows[:20]:
        scores = [(round(float(np.dot(v, w)), 6), i) for i, w in rows]
        top = {i for _, i in sorted((-s, i) for s, i in scores)[:75]}
        want[q] = brute([i for _, i in sorted((-round(-s + i % 7 / 50, 6), i) for s, i in scores)], top, 20)
    got = {r.query: tuple(r)[1:] for r in metrics.agreement_of(table.where(F.col("asset_id").isin(list(want))), table, other).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], atol=2e-6) for q in want)


@pytest.mark.parametrize("name", ["retrieval_metrics", "retrieval_summary", "ranking_agreement"])
def test_scores_of_all_pairs_are_not_written(spark, name):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    table = catalog.queries()[name](spark, SF)
    table.collect()
    items = tables.vectors(spark, SF)
    n = items.count() * items.where("asset_id % 100 = 0").count()
    rows = [spark.read.parquet(str(f)).count() for f in set(folder.iterdir()) - before]
    assert rows and max(rows) < n / 2


def test_vectors_of_two_lengths_raise(spark):
    long_, short = (spark.createDataFrame([(1, v)], "asset_id long, vector array<double>") for v in ([1.0, 2.0], [1.0]))
    with pytest.raises(Exception, match="dimensions"):
        search.top_k_each(short, long_, 3).collect()


def naive_place(said, keys):
    """All runs, as the definition has them."""
    best = None
    for n in range(min(places.INSIDE, len(said)), 1, -1):
        for at in range(len(said) - n + 1):
            core = said[at : at + n].lower().strip(" ")
            hits = [keys[c] for c in {core, re.sub(places.ENDS, "", core)} if c in keys]
            if hits and (best is None or (-n, at) < best[:2]):
                best = (-n, at, min(hits))
        if best:
            return best[2], best[1] + 1, n
    return None


def test_a_long_clause_takes_little_memory(spark):
    import tracemalloc

    import ahocorasick

    names = ahocorasick.Automaton()
    names.add_word("北京", "北京")
    names.make_automaton()
    said = "去 北京市 看猫" * 20_000
    tracemalloc.start()
    try:
        found, peak = places._longest(said, names), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == (2, 5, ["北京"])
    assert peak < 8 * len(said)  # the text itself has two bytes a character


def test_names_in_clauses(spark):
    rng = random.Random(5)
    gazetteer = places.gazetteer(spark, (("Aa", "aab ba", 1.0, 2.0, 3), ("Bb", "b市 xx", 1.0, 2.0, 3), ("Cc", "aa市", 1.0, 2.0, 3), ("Long Name Here", "", 0.0, 0.0, 1)))
    keys = {}
    for r in gazetteer.collect():
        keys[r.key] = min(keys.get(r.key, "~"), r.place)
    parts = ["aa", "b", "A", " ", "市", "区", " city", "xx", "ba", "é", "  ", " county", "İ", "long name here"]
    said = [(str(i), "".join(rng.choices(parts, k=rng.randrange(0, 7)))) for i in range(600)] + [("none", None), ("long", "z" * 50_000 + " aa市 ")]
    got = {r.request_id: (r.place, r.at, r.length) for r in places.longest_exact(spark.createDataFrame(said, "request_id string, clause string"), gazetteer).collect()}
    want = {i: w for i, c in said if c and i != "long" and (w := naive_place(c, keys))}
    assert got.pop("long") == ("Aa", 50_001, 5)  # Aa and Cc share a name; the first by name counts
    assert got == want and len(want) > 200


def naive_whole(said, keys):
    """All runs of any length; those of more than INSIDE characters have no spaces around."""
    best = None
    for n in range(len(said), 1, -1):
        for at in range(len(said) - n + 1):
            run = said[at : at + n].lower()
            if n > places.INSIDE and run != run.strip(" "):
                continue
            core = run.strip(" ")
            hits = [keys[c] for c in {core, re.sub(places.ENDS, "", core)} if c in keys]
            if hits and (best is None or (-n, at) < best[:2]):
                best = (-n, at, min(hits))
        if best:
            return best[2], best[1] + 1, n
    return None


def test_names_of_any_length_in_clauses(spark):
    rng = random.Random(6)
    gazetteer = places.gazetteer(spark, (("Aa", "aab ba", 1.0, 2.0, 3), ("Bb", "b市 xx 特别行 特别行政", 1.0, 2.0, 3), ("Cc", "aa市 city", 1.0, 2.0, 3), ("Long Name Here", "", 0.0, 0.0, 1), ("Name Here City", "", 0.0, 0.0, 1)))
    keys = {}
    for r in gazetteer.collect():
        keys[r.key] = min(keys.get(r.key, "~"), r.place)
    parts = ["aa", "b", " ", "市", "区", "政区", "特别行政区", "特别行", " city", " city city", "xx", "  ", " county", "İ", "long name here", "Name Here"]
    said = [(str(i), "".join(rng.choices(parts, k=rng.randrange(0, 8)))) for i in range(800)]
    got = {r.request_id: (r.place, r.at, r.length) for r in places.longest_exact(spark.createDataFrame(said, "request_id string, clause string"), gazetteer, whole=True).collect()}
    assert got == {i: w for i, c in said if (w := naive_whole(c, keys))}
    assert sum(n > places.INSIDE for _, _, n in got.values()) > 200


def test_a_chain_of_endings_is_walked_once():
    import ahocorasick

    names = ahocorasick.Automaton()
    names.add_word("city", "city")
    names.make_automaton()
    start = time.process_time()
    assert places._longest("a" + " city" * 100_000 + "." * 600_000, names, whole=True) == (3, 499_999, ["city"])
    assert time.process_time() - start < 20


def test_members_of_merged_clusters(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([rng.uniform(-90, 90), rng.gauss(10, 0.1)]), rng.choice([rng.uniform(-180, 180), rng.gauss(20, 0.1)])) for i in range(500)] + [(900, None, 1.0)]
    assets = spark.createDataFrame(rows, "asset_id long, latitude double, longitude double")
    for most in (1000, 30, 1):
        counts = {r.cluster: r.n for r in places.clusters(assets, most).collect()}
        members = places.cluster_members(assets, most).collect()
        assert len({r.asset_id for r in members}) == len(members) == 500
        assert counts == {c: sum(r.cluster == c for r in members) for c in {r.cluster for r in members}}
        assert all(r.cluster <= r.asset_id for r in members)


def test_percentiles_of_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(5)), rng.random() * 100])) for _ in range(900)] + [("empty", None), ("one", 3.5)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.low, r.p50, r.high) for r in metrics.percentiles(frame, "x", "g", {"low": 0.0, "p50": 0.5, "high": 0.97}).collect()}
    assert set(got) == {"a", "b", None, "empty", "one"} and got["empty"] == (None, None, None) and got["one"] == (3.5, 3.5, 3.5)
    for g in ("a", "b", None):
        values = [x for h, x in rows if h == g and x is not None]
        assert got[g] == pytest.approx([float(np.percentile(values, 100 * p)) for p in (0, 0.5, 0.97)], abs=1e-6)
    whole = metrics.percentiles(frame, "x").first()
    assert whole.p50 == pytest.approx(float(np.percentile([x for _, x in rows if x is not None], 50)), abs=1e-6)
    assert metrics.percentiles(frame.where("false"), "x").first().p50 is None


def test_queries_that_are_empty_on_the_tables_are_not_empty_by_nature(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], datetime(2024, 1, 1 + i), 1, False, None) for i in range(6)]
    df = spark.createDataFrame(rows, "asset_id long, vector array<double>, created timestamp_ntz, media_type int, favorite boolean, latitude double")
    only = search.Search(negative=[[1.0, 0.0]], floor=0.0)
    assert [r.asset_id for r in search.search(df, only).collect()] == [0, 2, 4]
    assert search.search(df, search.Search(negative=[[1.0, 0.0]])).collect() == []
    assert [r.asset_id for r in search.search(df, search.Search(constrained=True)).collect()] == [5, 4, 3, 2, 1, 0]
    table = spark.createDataFrame([(1, None, 5), (2, None, 6)], "asset_id long, at timestamp_ntz, bytes long")
    folded = spark.createDataFrame([(1, "delete", None, None), (3, "upsert", None, 9)], "asset_id long, op string, at timestamp_ntz, bytes long")
    assert sorted((r.asset_id, r.bytes) for r in mutations.apply_changes(table, folded).collect()) == [(2, 6), (3, 9)]


def test_an_answer_tells_what_it_took(spark):
    rows = [(i, None if i == 4 else [1.0, i / 10], datetime(2024, 1, 1 + i), i % 2, False, None) for i in range(6)]
    df = spark.createDataFrame(rows, "asset_id long, vector array<double>, created timestamp_ntz, media_type int, favorite boolean, latitude double")
    found, told, seconds = search.answered(df, search.Search([[1.0, 1.0]], filter=predicates.CandidateFilter(media_type=0)), 2)
    assert [r.asset_id for r in found] == [2, 0] and (told.candidate_count, told.scored_count, told.used_vectors) == (2, 2, True) and seconds > 0
    found, told, _ = search.answered(df, search.Search(constrained=True), 3)
    assert len(found) == told.candidate_count == 3 and told.scored_count == 0
