"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

Documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more; the groups are
the connected components of these links.

1. One pass over the texts (mapInArrow) keeps, per document, the size and a 128-bit digest of its shingle set,
   48 band keys of 4 MinHash values each (a pair at exactly 0.75 shares none of them with probability 1e-8) and an
   odd sketch: the 192 MinHash samples folded into 1024 parity bits.
2. Equal sets are one class, represented by its smallest id; only representatives go on.
3. Star round: each member of a band bucket is paired with the bucket's smallest id, so a bucket of any size gives
   as many pairs as it has rows.
4. Links that do not pass through that id: in the buckets that still hold more than one component, every member
   outside the bucket's main component is compared with all members, sketch against sketch, in blocks of bounded
   size inside a task. Components with such candidate pairs between them form a family; a bucket reports only a
   spanning forest of them, never all pairs.
5. Within each family of several components, every text outside the largest component is compared with all its
   texts, in blocks of bounded size: size and sketch first, then the full sets. Only links between components come
   out. Nothing is capped: a family of any size is worked through, block by block, and its texts are copied once per
   block of the texts outside its largest component.
6. A pair is looked at if the sizes allow 0.75 (exact) and the sketches estimate at least 0.60 (4.5 standard
   deviations below 0.75), and is confirmed on the full sets computed from the texts; a shingle is its 64-bit hash
   there, of numbers that are independent of one another (textkernel), so no texts are built to collide.

Defined results: null or word-free texts have no shingles, are linked with nothing and form their own component;
texts of one to four words have their whole sequence as the only shingle; rows that repeat an id are one node with
the links of all of them, each with its own row in the result; a null id takes the component of its equal texts and
else null, and is kept if that is null; an empty table gives an empty result; other columns are not looked at, whatever
their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import connected_components, numbered, small_batches, table, written

SHINGLE, BANDS, ROWS, BITS = 5, 48, 4, 1024
#: Members of a bucket, and characters of a family, that a task holds at a time (twice: queries and members).
BLOCK, BLOCK_CHARS = 1024, 1_000_000
#: Similarity 3/4 as a fraction, and the sketch estimate below which a pair is not looked at.
NUM, DEN, SIFT = 3, 4, 0.60
_N = BANDS * ROWS
_FACTORS = (K.mix(np.arange(1, _N + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALTS = K.mix(np.arange(1, _N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Most bits in which two sketches may differ.
SIFT_BITS = int(BITS / 2 * (1 - np.exp(-2 * (2 * _N * (1 - SIFT)) / BITS)) + 0.5)


def minhash(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    step = 2048
    return np.min([(_FACTORS[:, None] * low[None, i : i + step]).min(axis=1) for i in range(0, len(low), step)], axis=0)


def band_keys(m: np.ndarray) -> np.ndarray:
    wide = m.astype(np.uint64).reshape(BANDS, ROWS)
    key = _SALTS[:BANDS]
    for r in range(ROWS):
        key = K.mix(key ^ wide[:, r])
        key = key * np.uint64(0x9E3779B97F4A7C15)
    return key


def odd_sketch(m: np.ndarray) -> np.ndarray:
    at = (K.mix(m.astype(np.uint64) ^ _SALTS) >> np.uint64(40)).astype(np.int64) % BITS
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def _text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in K.slices(texts):
        w = K.words(data, offsets)
        h = w.hashes(True)
        first, keys = K.windows(h, w.of, SHINGLE)
        at = np.searchsorted(first, w.of)
        for d, n in enumerate(w.counts.tolist()):
            yield np.unique(keys[at[d] : at[d + 1]]) if n >= SHINGLE else K.window_at(h, w.of[d : d + 1], n) if n else h[:0]


_SIGNED = "id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, bands, sketches = [], [], [], []
        for s in _text_sets(batch.column("text")):
            n.append(len(s))
            digests.append((K.mix(s).sum(dtype=np.uint64), K.mix(s ^ _SALTS[0]).sum(dtype=np.uint64)))
            if len(s):
                m = minhash(s)
                bands.append(band_keys(m))
                sketches.append(odd_sketch(m))
        full = np.array(n, np.int64) > 0
        d = np.array(digests, np.uint64).reshape(-1, 2)

        def lists(rows: list[np.ndarray], width: int, full: np.ndarray = full) -> pa.Array:
            flat = pa.array((np.concatenate(rows) if rows else np.zeros(0, np.uint64)).view(np.int64))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)), flat)

        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), K.signed(np.ascontiguousarray(d[:, 0])), K.signed(np.ascontiguousarray(d[:, 1])), lists(bands, BANDS), lists(sketches, BITS // 64)], ["id", "n", "d1", "d2", "bands", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """linked of each pair of texts."""
    for batch in batches:
        linked = []
        for x, y in zip(_text_sets(batch.column("text_a")), _text_sets(batch.column("text_b")), strict=True):
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            linked.append(bool(common) and DEN * common >= NUM * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _passing(q: dict, m: dict) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, the members of other components that sizes and sketches allow to be linked with it."""
    step = max(1, (1 << 19) // max(1, len(m["n"])))
    for lo in range(0, len(q["n"]), step):
        part = slice(lo, lo + step)
        gap = np.zeros((len(q["n"][part]), len(m["n"])), np.int32)
        for k in range(BITS // 64):
            gap += np.bitwise_count(q["sketch"][part, k][:, None] ^ m["sketch"][None, :, k])
        nq, nm = q["n"][part][:, None], m["n"][None, :]
        ok = (gap <= SIFT_BITS) & (DEN * np.minimum(nq, nm) >= NUM * np.maximum(nq, nm)) & (q["component"][part][:, None] != m["component"][None, :])
        for i in np.flatnonzero(ok.any(axis=1)):
            yield lo + i, np.flatnonzero(ok[i])


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _families(q: dict, m: dict) -> pa.RecordBatch:
    """A spanning forest, over components, of the pairs that pass."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    a, b = [], []
    for i, js in _passing(q, m):
        x = int(q["component"][i])
        for y in np.unique(m["component"][js]).tolist():
            if root(x) != root(y):
                up[root(x)] = root(y)
                a.append(x)
                b.append(y)
    return _edges(a, b)


def _links(q: dict, m: dict) -> pa.RecordBatch:
    """Confirmed links: for each query, one to each other component that it is linked with."""
    sets, whose = list(_text_sets(m["text"])), list(_text_sets(q["text"]))
    a, b = [], []
    for i, js in _passing(q, m):
        mine, n = whose[i], np.array([len(sets[j]) for j in js])
        both = np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(mine, both), len(mine) - 1)
        common = np.add.reduceat((mine[at] == both).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        linked = js[DEN * common >= NUM * (len(mine) + n - common)]
        for j in linked[np.unique(m["component"][linked], return_index=True)[1]]:
            a.append(int(q["id"][i]))
            b.append(int(m["id"][j]))
    return _edges(a, b)


def _in_blocks(compare):
    """compare(queries, members) on each run of equal (key, qb, mb)."""

    def columns(rows: pa.Table) -> dict:
        out = {c: rows.column(c).to_numpy() for c in ("id", "component", "n")}
        out["sketch"] = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        if "text" in rows.column_names:
            out["text"] = rows.column("text")
        return out

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        asks = rows.column("query")
        q, m = rows.filter(asks), rows.filter(pa.compute.invert(asks))
        return compare(columns(q), columns(m)) if q.num_rows and m.num_rows else _edges([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "qb", "mb")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if held and tuple(keys[lo]) != last:
                    yield done(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = tuple(keys[lo])
        if held:
            yield done(held)

    return run


def _blocked(rows: DataFrame, compare, extra: list[str]) -> DataFrame:
    """Edges (a, b) that compare finds between the rows of each key with asks, and all rows of that key.

    rows: key, qblocks, mblocks, id, component, n, sketch, asks. A key's rows are dealt by id to its blocks of queries and of
    members; each block of queries meets each block of members in a task, so members are copied once per block of queries."""

    def own(blocks: str):
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def each(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))

    cols = ["key", "id", "component", "n", "sketch", *extra]
    members = rows.select(*cols, F.lit(False).alias("query"), own("mblocks").alias("mb"), each("qblocks").alias("qb"))
    queries = rows.where("asks").select(*cols, F.lit(True).alias("query"), own("qblocks").alias("qb"), each("mblocks").alias("mb"))
    dealt = members.unionByName(queries).repartition("key", "qb", "mb").sortWithinPartitions("key", "qb", "mb")
    return dealt.select(*cols, "query", "qb", "mb").mapInArrow(_in_blocks(compare), "a long, b long").distinct()


def _gap():
    return F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signatures, _SIGNED), "near-signatures")
    same = ["n", "d1", "d2"]
    classes = signed.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"))
    classes = written(classes, "near-digests")  # read again, so that Spark may split the join on a large class
    classes = written(signed.select("id", *same).join(classes, same, "left").select("id", "n", "rep"), "near-classes")
    reps = signed.where("n > 0").join(classes.where("id = rep").select("id").distinct(), "id", "left_semi")

    keyed = reps.select(F.explode("bands").alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other"), F.count("*").alias("size")).where("pivot < other").drop("other")
    members = written(keyed.join(shared, "key").distinct(), "near-members")
    suspects = members.select("id").distinct()
    suspects = docs.join(signed.select("id", "n", "sketch").join(suspects, "id", "left_semi").dropDuplicates(["id", "sketch"]), "id")
    suspects = written(suspects, "near-suspects")
    light = suspects.select("id", "n", "sketch").distinct()

    def sifted(pairs: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(light.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)
        return pairs.where((DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")) & (_gap() <= SIFT_BITS)).select("a", "b").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(suspects.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")), s)
        return written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, linked boolean"), "near-confirmed")

    links = confirmed(sifted(members.where("pivot < id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())).where("linked").select("a", "b")
    labels = connected_components(links)

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        found = labels.select(F.col("node").alias(key), F.col("component").alias(name))
        return rows.join(found, key, "left").withColumn(name, F.coalesce(name, key))

    held = labelled(labelled(members, "id", "component"), "pivot", "main")
    asks = F.col("component") != F.col("main")
    mixed = held.groupBy("key").agg(F.ceil(F.count_if(asks) / BLOCK).alias("qblocks"), F.ceil(F.count("*") / BLOCK).alias("mblocks")).where("qblocks > 0")
    held = held.join(mixed, "key").join(light, "id").withColumn("asks", asks)
    families = connected_components(_blocked(held, _families, []))

    kin = labelled(suspects, "id", "component").join(families.select(F.col("node").alias("component"), F.col("component").alias("key")), "component")
    kin = written(kin, "near-families")
    sizes = kin.groupBy("key", "component").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))
    largest = F.max_by(F.struct("component", "chars"), F.struct("texts", "component"))
    sizes = sizes.groupBy("key").agg(largest.alias("main"), F.sum("chars").alias("chars"))
    sizes = sizes.select("key", F.col("main.component").alias("main"), F.ceil((F.col("chars") - F.col("main.chars") + 1) / BLOCK_CHARS).alias("qblocks"), F.ceil((F.col("chars") + 1) / BLOCK_CHARS).alias("mblocks"))
    kin = kin.join(sizes, "key").withColumn("asks", asks)
    links = links.unionByName(_blocked(kin, _links, ["text"]))
    labels = connected_components(links)
    of = labels.select(F.col("node").alias("rep"), "component")
    found = classes.join(of, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id (of rows with that id, one); null ids stay.

    Rows move once, by id: the join with the ids to keep and the choice among rows of one id share the shuffle."""
    rows, names = numbered(docs)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = written(near_duplicates(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "near-kept")
    one = rows.withColumn("doc_id", F.col(key).cast("long")).join(kept, "doc_id", "left_semi")
    one = one.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text)))).where("turn = 1")
    return one.select(names).unionByName(rows.where(F.col(key).isNull())).toDF(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
