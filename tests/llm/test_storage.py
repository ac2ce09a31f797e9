"""Archives, manifests and clusters against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from shutterlake.llm import clustering, merkle, warc


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11 ------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, first_id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    rng = random.Random(5)
    bodies = ["", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "word " * 40_000, *(f"<p>{rng.random()}</p>" for _ in range(60))]
    rows = [(i, f"http://h{i % 7}.org/a b\r\n{i}" if i % 5 else None, rng.choice(bodies) if i % 11 else None) for i in rng.sample(range(1000), 300)]
    folder = str(tmp_path_factory.mktemp("warc"))
    index = warc.archive(pages(spark, rows).repartition(5), folder, frame_bytes=4000, bundle_bytes=6000)
    return rows, folder, index


def test_archive_reads_back(spark, archived):
    rows, _, index = archived
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    got = {r.id: r for r in warc.scan(index, payloads=True).collect()}
    names = {r.record_id: r.id for r in got.values()}
    assert len(got) == len(names) == len(rows) == index.count()
    for i, url, html in rows:
        r = got[i]
        assert r.payload_digest == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        assert r.url == (url and url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"))
        if first[html or ""] == i:
            assert (r.type, bytes(r.payload).decode(), r.payload_bytes, r.refers_to) == ("response", html or "", len((html or "").encode()), None)
        else:
            assert r.type == "revisit" and names[r.refers_to] == first[html or ""]


def test_any_reader_of_zstandard_reads_a_bundle(archived):
    _, folder, index = archived
    bundles = {r.bundle for r in index.select("bundle").distinct().collect()}
    assert len(bundles) > 5  # more than tasks: bundles were closed when they were full
    seen = 0
    for b in bundles:
        store, name = fs.FileSystem.from_uri(b)
        with store.open_input_file(name) as f:
            data, table = f.read(), warc.seek_table(f)
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == sum(e[2] for e in table) and len(table) > 1
        seen += sum(1 for _ in warc.parsed(plain))
    assert seen == index.count()


def test_index_leads_to_single_records(spark, archived):
    rows, _, index = archived
    html = {i: h or "" for i, _, h in rows}
    wanted = index.where("id % 3 = 0")
    got = warc.follow(index, wanted).collect()
    assert len(got) == wanted.count()
    assert all(bytes(r.payload).decode() == html[r.id] for r in got)
    assert {r.type for r in index.where("id % 3 = 0").collect()} == {"response", "revisit"}


def test_small_payloads_and_odd_ids(spark, tmp_path):
    rows = [(5, "u", "abc"), (3, "u", "abc"), (None, "u", "abc"), (3, "u", "abc"), (3, "a", "abc"), (9, None, "xx"), (8, None, "xx"), (None, None, "zz")]
    index = warc.archive(pages(spark, rows), str(tmp_path), min_bytes=3)
    got = sorted(((r.id, r.url, r.type) for r in warc.scan(index).collect()), key=repr)
    assert got == sorted([(5, "u", "revisit"), (3, "u", "revisit"), (None, "u", "revisit"), (3, "u", "revisit"), (3, "a", "response"), (9, None, "response"), (8, None, "response"), (None, None, "response")], key=repr)


def test_damage_is_seen(spark, tmp_path):
    index = warc.archive(pages(spark, [(1, "u", "some words " * 50)]).coalesce(1), str(tmp_path / "a"))
    path = index.first().bundle
    data = bytearray(open(path, "rb").read())
    data[60] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match=r"(?i)checksum|decompress|digest|corrupt"):
        warc.scan(index).collect()


# 12 ------------------------------------------------------------------------------------------------------------------


def plain_tree(hashes, fanout):
    """(root, proof of each): a proof has (left, right) per level."""
    proofs, at, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, p = runs[i // fanout], i % fanout
            proofs[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
        at, nodes = [i // fanout for i in at], [H(*run) for run in runs]
    return nodes[0], proofs


def leaf(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, grp int, idx int, steps int"


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 6), (3, 2), (5, 1)])
def test_manifest(spark, fanout, levels):
    rng = random.Random(fanout + levels)
    sizes = {None: 1, "": 2, "a": 9, "ä": 27, "b": 70, "z": 1, "zz": 64}
    rows = [(rng.randrange(10**6) if rng.random() > 0.02 else None, rng.choice(["é x", None, "", "w"]) or str(rng.random()), g, rng.choice(["s", None]), rng.choice([1, None, 77]), "k", 1, 2, 3) for g, n in sizes.items() for _ in range(n)]
    rows.append(rows[40])
    rng.shuffle(rows)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs, want = [], []
    for g in order:
        root, proofs = plain_tree([h for *_, h in sorted(by[g])], fanout)
        subs.append(root)
        want.append([(k if there else None, g, h, root, p) for (there, k, h), p in zip(sorted(by[g]), proofs, strict=True)])
    top, last = plain_tree(subs, fanout)
    want = sorted(((k, g, h, root, top, p + last[i]) for i, group in enumerate(want) for k, g, h, root, p in group), key=repr)
    frame = merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=fanout, levels=levels, twice=F.col("n_chars") * 2)
    got = frame.withColumn("fold", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    assert sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.steps]) for r in got), key=repr) == want
    assert all(r.fold == top for r in got) and frame.columns == ["doc_id", "lang", "leaf", "subroot", "root", "steps", "twice"]


def test_single_row_and_single_group(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "t", "en", "s", 1, "k", 1, 2, 3)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == leaf(1, "s", "en", 1, "t") and one.steps == []


def test_tampering_shows(spark, tmp_path):
    rows = [(i, "t", "en" if i % 3 else "de", "s", None if i == 14 else i, "k", 1, 2, 3) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op12(spark, str(tmp_path)).collect()}
    hit = {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert hit and {i for i, r in got.items() if not r.verified} == {i for i in hit if rows[i][4] is not None}


# 13 ------------------------------------------------------------------------------------------------------------------


def plain_clusters(ids, rows, k, rounds, seed):
    first = sorted(range(len(rows)), key=lambda i: (H(f"{seed}:{ids[i]}"), ids[i], rows[i]))[:k]
    centroids = [list(rows[i]) for i in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        near = [nearest(v)[1] for v in rows]
        for j in range(len(centroids)):
            if own := [v for v, a in zip(rows, near, strict=True) if a == j]:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [nearest(v) for v in rows], centroids


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 3, 12), (2, 1, 40), (3, 50, 7), (4, 1 << 16, 9)])
def test_clusters_equal_the_plain_method(spark, seed, spread, k):
    """spread 1 and 3: hardly any place for the points, so ties and empty clusters abound."""
    rng = random.Random(seed)
    rows = [[rng.randint(-spread, spread) + rng.choice([0, 4 * spread]) for _ in range(3)] for _ in range(300)]
    ids = [rng.randrange(250) for _ in rows]
    table = spark.createDataFrame([(i, [x / 4 + 0.1 for x in v], "x", 1) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, id string, cluster int")
    got, centroids = clustering.clusters(table.repartition(3), k=k, rounds=4, dimension=3, scale=4.0, seed=seed)
    want, plain = plain_clusters(ids, rows, k, 4, seed)
    assert centroids.tolist() == plain
    assert sorted((r.id, r.cluster, r.distance) for r in got.collect()) == sorted((i, j, d) for i, (d, j) in zip(ids, want, strict=True))


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 16))
    rows = centres[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 16))
    centroids = rows[rng.choice(4000, 20, replace=False)].copy()
    cluster, upper, lower, moved, work = np.full(4000, -1, np.int32), np.zeros(4000), np.zeros((4000, 20)), np.zeros(20), []
    for _ in range(6):
        work.append(int(clustering.elkan(rows, centroids, cluster, upper, lower, moved).sum()))
        true = ((rows[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (cluster == true.argmin(1)).all() and (upper >= np.sqrt(true.min(1))).all() and (lower <= np.sqrt(true)).all()
        after = np.array([rows[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else centroids[j] for j in range(20)])
        moved, centroids = np.sqrt(((after - centroids) ** 2).sum(1)) * (1 + clustering.FINE), after
    assert work[0] < 4000 * 20 and sum(work[1:]) < 0.5 * 5 * 4000 * 20
