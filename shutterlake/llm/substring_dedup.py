"""Substring dedup: words inside a 50-word window that also starts in a document with a smaller id are removed.

Anchors: 20-word windows are hashed only at word positions whose index modulo 31 is in a perfect difference cover.
For any two positions there is a shift of at most 30 words that puts both on the cover, and 30 + 20 <= 50, so every
shared 50-word window holds an anchor at the same place in both documents. Anchors that occur under two ids point at
the places to extend: from every such anchor the match is extended to all 50-word windows over it, and a window is
covered if the same 50 words also start under a smaller id. Words are compared by two independent hashes, 128 bits in
all: two different windows among 10^13 agree with probability 10^-13. (An anchor's 64 bits only propose places.)
Documents without a shared anchor, most of them, are finished at once.

Both searches are grouping by hash, done as a map-side combine, a shuffle by hash range and a merge. The combine
settles within the task what can be settled there (an occurrence with a smaller id beside it needs nobody else) and
sends on only the occurrences under the task's smallest id, so a passage that a third of all documents share arrives
once per task, not once per document. Hash lists travel as arrays, one row per task and hash range.

Defined results: null or empty texts have no words and keep none; ids that repeat are not smaller than one another;
rows with a null id neither remove nor lose words; texts of under 50 words are kept whole; an empty table gives an
empty result; other columns are not looked at. Text and windows are whole; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import positions
from . import textkernel as K
from .common import small_batches, table, written

WINDOW, PERIOD, ANCHOR = 50, 31, 20
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
_ON = np.isin(np.arange(PERIOD), COVER)
#: Occurrences that a task holds before it combines and sends them.
HELD = 2_000_000
#: An occurrence is its id and (tag << 31 | word index); the tag tells apart texts under one id, a number for each of them.
_AT = 31
#: What the words' hashes are mixed with for the second hash of a window.
_SECOND = np.uint64(0xA5A3_5C1D_9E6B_70F7)

_SENT = "bucket int, h array<long>, g array<long>, ids array<long>, at array<long>, id long, tag long, pos array<int>"
_FOUND = "id long, tag long, pos array<int>"


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


def _by_doc(ids: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(id, tag, positions) of occurrences in any order, one entry per text."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    tag = at >> _AT
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tag[1:] != tag[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return pa.array(ids[new]), pa.array(tag[new]), _lists((at & ((1 << _AT) - 1)).astype(np.int32), np.append(new, len(ids)), pa.int32())


def _order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """By h, and by g among equal h."""
    order = np.argsort(h, kind="stable")
    x, y = h[order], g[order]
    return np.lexsort((g, h)) if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any() else order


def _groups(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences in order of h and g: group starts, and the least and greatest id of each occurrence's group."""
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    size = np.diff(np.append(start, len(h)))
    return start, np.repeat(np.minimum.reduceat(ids, start), size), np.repeat(np.maximum.reduceat(ids, start), size)


_NAMES = ["bucket", "h", "g", "ids", "at", "id", "tag", "pos"]


def _combine(h: np.ndarray, g: np.ndarray, ids: np.ndarray, at: np.ndarray, bits: int, anchors: bool) -> Iterator[pa.RecordBatch]:
    """What a task can settle (bucket of the id), and what it sends on (bucket: the leading bits of h)."""
    order = _order(h, g)
    h, g, ids, at = h[order], g[order], ids[order], at[order]
    start, lo, hi = _groups(h, g, ids)
    settled = lo < hi if anchors else ids > lo
    send = ~settled
    if anchors:  # one occurrence under the least and one under the greatest id speak for a settled group
        both = start[settled[start]]
        h, g = np.concatenate([h, h[both], h[both]]), np.concatenate([g, g[both], g[both]])
        ids, at = np.concatenate([ids, lo[both], hi[both]]), np.concatenate([at, np.full(2 * len(both), -1)])
        send, settled = np.concatenate([send, np.ones(2 * len(both), bool)]), np.concatenate([settled, np.zeros(2 * len(both), bool)])
    if settled.any():
        i, t, p = _by_doc(ids[settled], at[settled])
        n = len(i)
        none = pa.nulls(n, pa.list_(pa.int64()))
        buckets = (K.mix(i.to_numpy().astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), none, none, none, none, i, t, p], names=_NAMES)
    if send.any():
        h, g, ids, at = h[send], g[send], ids[send], at[send]
        order = np.argsort(h, kind="stable")
        h, g, ids, at = h[order], g[order], ids[order], at[order]
        bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cut, len(h))
        n = len(cut)
        lists = [_lists(x, ends, pa.int64()) for x in (h.view(np.int64), ids, at)]
        second = pa.nulls(n, pa.list_(pa.int64())) if anchors else _lists(g.view(np.int64), ends, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), lists[0], second, *lists[1:], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names=_NAMES)


def _occurrences(bits: int, anchors: bool):
    """Stage of both searches: hash what is to be compared, combine, send."""

    def of_slice(w: K.Words, marked: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        owner = w.owner()
        index = np.arange(len(w.start)) - w.of[owner]
        if anchors:
            return np.flatnonzero(_ON[index % PERIOD] & (index + ANCHOR <= w.counts[owner])), index
        edge = np.zeros(len(w.start) + 1, np.int32)
        for d, p in enumerate(marked):
            np.add.at(edge, w.of[d] + np.maximum(p - (PERIOD - 1), 0), 1)
            np.add.at(edge, w.of[d] + p + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (index + WINDOW <= w.counts[owner])), index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            marks = None if anchors else [np.asarray(p.as_py(), np.int64) for p in batch.column("pos")]
            for f, last, data, offsets in K.slices(batch.column("text")):
                w = K.words(data, offsets)
                if not len(w.start):
                    continue
                first, index = of_slice(w, marks and marks[f:last])
                row = f + w.owner()[first]
                words = w.hashes(False)
                h = K.window_at(words, first, ANCHOR if anchors else WINDOW)
                g = np.zeros(len(h), np.uint64) if anchors else K.window_at(K.mix(words ^ _SECOND), first, WINDOW)
                held.append((h, g, ids[row], (tags[row] << _AT) | index[first]))
                n += len(first)
                if n >= HELD:
                    yield from _combine(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, anchors)
                    held, n = [], 0
        if n:
            yield from _combine(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, anchors)

    return run


def _merge(anchors: bool):
    """Settle what the tasks sent, one hash range after the other; rows must come in order of bucket."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, g, ids, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _order(h, g)
        h, g, ids, at = h[order], g[order], ids[order], at[order]
        _, lo, hi = _groups(h, g, ids)
        found = ((lo < hi) & (at >= 0)) if anchors else ids > lo
        if found.any():
            yield pa.RecordBatch.from_arrays(list(_by_doc(ids[found], at[found])), names=["id", "tag", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            done = batch.column("h").is_null()
            ready = batch.filter(done)
            if ready.num_rows:
                yield ready.select(["id", "tag", "pos"])
            rest = batch.filter(pa.compute.invert(done))
            if not rest.num_rows:
                continue
            buckets = rest.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(buckets)), strict=True):
                if held and buckets[a] != current:
                    yield from settle(held)
                    held = []
                current = buckets[a]
                part = rest.slice(a, b - a)
                h, ids, at = (part.column(c).flatten().to_numpy() for c in ("h", "ids", "at"))
                held.append((h, np.zeros(len(h), np.int64) if anchors else part.column("g").flatten().to_numpy(), ids, at))
        if held:
            yield from settle(held)

    return run


def _kept(w: K.Words, keep: np.ndarray) -> list[str]:
    """Per text, the digest of the kept words joined by one space."""
    n = len(w.data)
    edge = np.zeros(n + 1, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    at = np.flatnonzero(keep)
    owner = np.searchsorted(w.of, at, "right") - 1
    inner = at[:-1][owner[1:] == owner[:-1]]  # kept words with another after them in their text
    mask[w.end[inner]] = True
    data = w.data.copy()
    data[w.end[inner]] = 32
    out = data[mask].tobytes()
    ends = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    return [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


_DONE = "kind int, id long, tag long, n_words long, n_removed long, kept_sha256 string, text string, pos array<int>"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish texts without marks (kind 0); pass the others on (kind 1)."""
    for batch in batches:
        marked = batch.column("pos").is_valid()
        yield from _finish(batch.filter(pa.compute.invert(marked)), [])
        on = batch.filter(marked)
        n = on.num_rows
        if n:
            blank = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), on.column("id"), on.column("tag"), blank, blank, pa.nulls(n, pa.string()), on.column("text"), on.column("pos")], names=[x.split()[0] for x in _DONE.split(", ")])


def _finish(batch: pa.RecordBatch, covered: list) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    counts, removed, digests = [], [], []
    for f, last, data, offsets in K.slices(batch.column("text")):
        w = K.words(data, offsets)
        keep = np.ones(len(w.start), bool)
        if covered:
            edge = np.zeros(len(w.start) + 1, np.int32)
            for d, p in enumerate(covered[f:last]):
                np.add.at(edge, w.of[d] + p, 1)
                np.add.at(edge, w.of[d] + p + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
        counts.append(w.counts)
        removed.append(K.per_text(~keep, w.of))
        digests += _kept(w, keep)
    columns = [pa.array(np.zeros(n, np.int32)), batch.column("id"), batch.column("tag"), pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(digests), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DONE.split(", ")])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _finish(batch, [np.asarray(p.as_py() or [], np.int64) for p in batch.column("pos")])


def _search(rows: DataFrame, bits: int, anchors: bool) -> DataFrame:
    """(id, tag, pos) of the occurrences that share a hash with another id, or with a smaller one."""
    sent = rows.mapInArrow(_occurrences(bits, anchors), _SENT).repartition("bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(_merge(anchors), _FOUND)
    return found.groupBy("id", "tag").agg(F.flatten(F.collect_list("pos")).alias("pos"))  # at most a text's own words


def _tagged(docs: DataFrame) -> DataFrame:
    """docs (id, text) with tag: different texts under one id are numbered, a text under an id of its own has 0.

    Of the repeated ids, the digests (128 bits) are put in order by ranges; no task sees all texts of an id."""
    twice = written(docs.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "substring-ids")
    if twice.isEmpty():
        return docs.withColumn("tag", F.lit(0).cast("long"))
    texts = docs.join(twice, "id", "left_semi").select("id", F.md5(F.col("text").cast("binary")).alias("digest")).distinct()
    placed = written(positions(texts, [F.col("id"), F.col("digest")], "place"), "substring-places")
    first = placed.groupBy("id").agg(F.min("place").alias("first"))
    tags = written(placed.join(first, "id").select(F.col("id").alias("_id"), "digest", (F.col("place") - F.col("first")).alias("tag")), "substring-tags")
    joined = docs.join(tags, (F.col("id") == F.col("_id")) & (F.md5(F.col("text").cast("binary")) == F.col("digest")), "left")
    return joined.select("id", "text", F.coalesce("tag", F.lit(0).cast("long")).alias("tag"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = min(20, max(6, (docs.count() // 64).bit_length()))  # hash ranges: a few thousand occurrences each, tens of MB at 10^10 documents
    docs = _tagged(docs)
    marks = _search(docs.where("id IS NOT NULL"), bits, anchors=True)
    settled = docs.join(marks, ["id", "tag"], "left").select("id", "tag", "text", "pos").mapInArrow(_settle, _DONE)
    settled = written(settled, "substring-settled", by="kind")
    open_ = settled.where("kind = 1")
    covered = _search(open_.select("id", "tag", "text", "pos"), bits, anchors=False)
    rest = open_.select("id", "tag", "text").join(covered, ["id", "tag"], "left").select("id", "tag", "text", "pos").mapInArrow(_remove, _DONE)
    out = ["id", "n_words", "n_removed", "kept_sha256"]
    return settled.where("kind = 0").select(out).unionByName(rest.select(out)).withColumnRenamed("id", "doc_id")


def op4(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
