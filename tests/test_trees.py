"""Trees of any depth, positions in an order: against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import library, ordering, trees


def plain(parents):
    """(listing of (id, depth), nodes on or below a cycle) of a table of parents; ids are numbers."""
    children, roots = {}, []
    for v, p in parents.items():
        if p in parents:
            children.setdefault(p, []).append(v)
        else:
            roots.append(v)
    listed, open_ = [], [(v, 0) for v in sorted(roots, reverse=True)]
    while open_:
        v, d = open_.pop()
        listed.append((v, d))
        open_ += [(c, d + 1) for c in sorted(children.get(v, ()), reverse=True)]
    loops = sorted(set(parents) - {v for v, _ in listed})
    return listed + [(v, 0) for v in loops], set(loops)


def summed(parents, counts, listed, loops):
    totals = {v: list(counts.get(v, (0, 0))) for v in parents}
    for v, d in reversed(listed):
        if d and v not in loops:
            totals[parents[v]] = [a + b for a, b in zip(totals[parents[v]], totals[v], strict=True)]
    return {v: tuple(x) for v, x in totals.items()}


def bushy(seed):
    rng = random.Random(seed)
    parents = {v: rng.choice([None, 999, *range(max(0, v - 7), v)]) if v else None for v in range(300)}
    for a, b, c in ((300, 301, 302), (310, 311, 312)):
        parents |= {a: b, b: c, c: a, a + 3: a, a + 4: a + 3}
    return parents | {320: 320}


def chain():
    """5,000 levels, a root with 3,000 children, and a cycle of 700 with a tail of 900."""
    parents = {v: v - 1 for v in range(1, 5000)} | {0: None} | {10_000 + v: 10_000 for v in range(1, 3000)} | {10_000: None}
    return parents | {20_000 + v: 20_000 + (v + 1) % 700 for v in range(700)} | {30_000 + v: 30_000 + v - 1 for v in range(1, 900)} | {30_000: 20_005}


@pytest.mark.parametrize("parents", [bushy(1), bushy(2), chain()], ids=["bushy", "bushier", "chain"])
def test_forests(spark, parents):
    rng = random.Random(4)
    rows = list(parents.items())
    rng.shuffle(rows)
    folders = spark.createDataFrame(rows, "folder_id int, parent_id int")
    counts = {v: (rng.randrange(3), rng.randrange(100)) for v in parents if v % 3}
    listed, loops = plain(parents)
    got = library.folder_outline(folders).collect()
    assert [(r.folder_id, r.depth) for r in sorted(got, key=lambda r: r.place)] == listed and sorted(r.place for r in got) == list(range(len(parents)))
    table = spark.createDataFrame([(v, *c) for v, c in counts.items()], "folder_id int, albums long, assets long")
    want = summed(parents, counts, listed, loops)
    assert {r.folder_id: (r.albums, r.assets) for r in library.folder_rollup(folders, table).collect()} == want
    top = {r.folder_id for r in library.empty_folders(folders, table).collect()}
    assert top == {v for v in parents if want[v][0] == 0 and (parents[v] not in parents or want[parents[v]][0] > 0)}


def test_previews_go_depth_first(spark):
    parents = bushy(3)
    listed, loops = plain(parents)
    rng = random.Random(1)
    albums = [(v, i, f"t {rng.randrange(30)}", rng.choice([None, 1000 + i])) for i, v in enumerate(rng.choices(sorted(parents), k=90))]
    own = {}
    for v, i, title, preview in albums:
        if preview is not None:
            own[v] = min(own.get(v, (10**9, 0, 0)), (int(title[2:]), i, preview))
    place = {v: k for k, (v, _) in enumerate(listed)}
    want = {}
    for v, _ in listed:
        at = v
        if v in own:
            while True:
                want[at] = min(want.get(at, (10**9, 0)), (place[v], own[v][2]))
                if at in loops or parents[at] not in parents:
                    break
                at = parents[at]
    got = library.folder_previews(spark.createDataFrame(list(parents.items()), "folder_id int, parent_id int"), spark.createDataFrame(albums, "folder_id int, album_id long, title string, preview long"))
    assert {r.folder_id: r.preview for r in got.collect()} == {v: want.get(v, (0, None))[1] for v in parents}


def test_tree_rows_and_repeated_folders(spark):
    folders = spark.createDataFrame([(1, None), (2, 1), (3, 2), (3, 9), (4, 3), (5, 6), (6, 5), (None, 1), (2, 1)], "folder_id int, parent_id int")
    shown = library.tree_rows(folders, [1, 3], ordered=True)
    assert sorted((r.folder_id, r.depth, r.place) for r in shown.collect()) == [(1, 0, 0), (2, 1, 1), (5, 0, 4), (6, 0, 5)]
    assert {r.folder_id for r in library.tree_rows(folders, []).collect()} == {1, 5, 6}
    assert library.folder_outline(folders.where("false")).collect() == [] and trees.closed(trees.forest(folders.where("false"))).collect() == []


def test_positions_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), i, rng.randrange(50)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "a int, b int, w int").repartition(7)
    order = [F.col("a").desc_nulls_last(), F.col("b")]
    want, total = {}, 0
    for k, (a, b, w) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))):
        want[b], total = (k, total), total + w
    assert {r.b: r.position for r in ordering.positions(frame, order).collect()} == {b: k for b, (k, _) in want.items()}
    assert {r.b: r.sum for r in ordering.running(frame, order, F.col("w"), "sum").collect()} == {b: s for b, (_, s) in want.items()}
