"""Language-model scores by context-tree weighting over bytes, and the add-one word score beside them.

The model reads the text with A-Z lower-cased, byte by byte, and one end symbol. A byte is eight binary decisions
(its bits, from the highest); each decision has a context tree over the preceding DEPTH bytes, nearest first. Each
node has a Krichevsky-Trofimov estimate from the training texts, and the weighting mixes stopping at the node with
going on to its children, at every depth: P = (KT + product of the children's P) / 2. A decision's probability is then
w k + (1 - w) (the same one byte deeper), w being the node's posterior weight and k its estimate; this is exactly the
conditional probability of context-tree weighting given the training texts. Scores are log10 probabilities.

Everything needed is in the counts of (context, byte) grams, so the work is counting and looking up:

1. One pass cuts the rows into chunks of about CHUNK bytes and keeps, per chunk, the texts and the distinct grams and
   words with their counts in training texts. Grams that only scored texts hold come along with count 0.
2. Counts are summed by hash range; (context, byte) grams are then dealt by their three nearest bytes, and each
   task works its trees up to that depth. What remains above, per pair of bytes and decision, is a groupBy; the
   nodes of at most one byte of context (65,280 at most) go through the driver and are broadcast.
3. Tasks work their trees down again to a probability per gram, and the answers go back to the chunks that asked:
   by hash range first, then by chunk, where they meet the texts. A key that is in every chunk is one entry of an
   array per chunk, so frequent words or grams make no large group.

Nothing is broadcast or collected that grows with the input, and no model has to fit into one task.

Defined results: null or empty texts have the end symbol only; a null id counts as an empty string in the split
(training); repeated rows are trained on and scored like any others; without training texts every decision has 1/2;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import small_batches, table, written

#: Bytes of context (3 to 7), and bytes of text in a chunk.
DEPTH, CHUNK = 5, 32 << 20
#: Bytes of text per task of the shuffles: their number of tasks follows the input, not the session's setting.
TASK_BYTES = 16 << 20
#: Trees are worked in tasks down from this depth.
TOP = 3
GRAM, WORD = 1, 2
#: Padding before a text, and the symbol after it: no byte of UTF-8 text.
END = 255
#: Entries that a task holds before it merges or sends them.
HELD = 1 << 22
_U = np.uint64
_END_WORD = np.uint64(0x51A3_70C4_9E2B_86D1)

#: Texts travel in compressed blocks: their ids and flags, where each ends, and the bytes of all.
_GATHERED = "chunk long, ids array<long>, train array<boolean>, ends array<long>, block binary, kind int, bucket int, keys array<long>, counts array<long>"
_ANSWERS = "kind int, bucket int, keys array<long>, values array<double>, known long, total long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[start], np.add.reduceat(n, start) if len(k) else n


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every position, end included; start of each text in them). Nearest context byte first."""
    n = len(offsets) - 1
    pad = depth + 1
    first = offsets[:-1] + np.arange(n) * pad + depth
    last = offsets[1:] + np.arange(n) * pad + depth
    text = np.ones(len(data) + n * pad, bool)
    for k in range(1, depth + 1):
        text[first - k] = False
    text[last] = False
    line = np.full(len(text), END, np.uint8)
    line[text] = K.LOWER[data]
    text[last] = True
    key = line[depth:].astype(_U)
    for k in range(1, depth + 1):
        key |= line[depth - k : len(line) - k].astype(_U) << _U(8 * (depth + 1 - k))
    return key[text[depth:]], np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(keys) >> _U(64 - bits)).astype(np.int32)


def _by_bucket(kind: int, keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, array ends, keys, values) in order of bucket."""
    bucket = _buckets(keys, bits)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[order], keys[order], values[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[cut], np.append(cut, len(bucket)), keys, values


class _Counter:
    """Distinct keys of a chunk and their counts in training texts."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for part, counted in ((keys[train], True), (keys[~train], False)):
            if len(part):
                k, n = np.unique(part, return_counts=True)
                self.keys.append(k)
                self.counts.append(n.astype(np.int64) if counted else np.zeros(len(k), np.int64))
                self.n += len(k)
        if self.n > HELD:
            k, n = _merged(self.keys, self.counts)
            self.keys, self.counts, self.n = [k], [n], min(len(k), HELD // 2)

    def rows(self, chunk: int, kind: int, bits: int) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        bucket, ends, keys, counts = _by_bucket(kind, *_merged(self.keys, self.counts), bits)
        n = len(bucket)
        columns = [pa.array(np.full(n, chunk)), *(pa.nulls(n, t) for t in _BLOCK), pa.array(np.full(n, kind, np.int32)), pa.array(bucket)]
        yield pa.RecordBatch.from_arrays([*columns, _lists(keys.view(np.int64), ends, pa.int64()), _lists(counts, ends, pa.int64())], names=[x.split()[0] for x in _GATHERED.split(", ")])


_BLOCK = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())


def _block(chunk: int, ids: list, train: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    squeezed = pa.compress(data.tobytes(), "zstd", asbytes=True)
    columns = [pa.array([x], t) for x, t in zip((ids, train.tolist(), offsets[1:].tolist(), squeezed), _BLOCK, strict=True)]
    blank = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([chunk]), *columns, *blank], names=[x.split()[0] for x in _GATHERED.split(", ")])


def _gather(depth: int, bits: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        found = {GRAM: _Counter(), WORD: _Counter()}
        for batch in batches:
            ids, train = batch.column("id").to_pylist(), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for f, last, data, offsets in K.slices(batch.column("text")):
                own = train[f:last]
                yield _block(chunk, ids[f:last], own, data, offsets)
                key, start = grams(data, offsets, depth)
                found[GRAM].add(key, np.repeat(own, np.diff(start)))
                w = K.words(data, offsets)
                found[WORD].add(np.append(w.hashes(True), np.full(last - f, _END_WORD)), np.append(own[w.owner()], own))
                held += len(data)
            if held >= chunk_bytes:
                for kind, c in found.items():
                    yield from c.rows(chunk, kind, bits)
                chunk, held, found = chunk + 1, 0, {GRAM: _Counter(), WORD: _Counter()}
        for kind, c in found.items():
            yield from c.rows(chunk, kind, bits)

    return run


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal values in the integer columns, one run after the other; rows must come in that order."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            if held and tuple(keys[a]) != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _flat(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each (kind, bucket): one row of arrays."""
    for (kind, bucket), rows in _runs(batches, "kind", "bucket"):
        k, n = _merged([_flat(rows, "keys").view(_U)], [_flat(rows, "counts")])
        ends = np.array([0, len(k)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), _lists(k.view(np.int64), ends, pa.int64()), _lists(n.astype(np.float64), ends, pa.float64()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
            names=[x.split()[0] for x in _ANSWERS.split(", ")],
        )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up; exact to about 1e-14 of the value for x of 1/2 or more."""
    up = np.ones_like(x)
    for k in range(8):
        up *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(up)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log P, posterior weight, estimate of a one) of nodes with a zeros and b ones; below: sum of the children's log P."""
    half = np.log(np.pi)  # 2 log gamma(1/2)
    kt = log_gamma(a + 0.5) + log_gamma(b + 0.5) - half - log_gamma(a + b + 1)
    k = (b + 0.5) / (a + b + 1)
    if below is None:
        return kt, np.ones_like(kt), k
    return np.logaddexp(kt, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - kt, -700, 700))), k


class Trees:
    """Nodes of the context trees of some grams, from the longest contexts down to depth least."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> None:
        """keys: distinct grams whose contexts of depth least belong to this task alone."""
        self.depth, self.least = depth, least
        self.nodes: dict[int, np.ndarray] = {}
        self.weight: dict[int, np.ndarray] = {}
        self.one: dict[int, np.ndarray] = {}
        below = None
        for d in range(depth, least - 1, -1):
            node, bit = self.decisions(keys, d)
            n = np.repeat(counts[None, :], 8, axis=0).ravel()
            own, at = np.unique(node.ravel(), return_inverse=True)
            a, b = np.bincount(at, n * (1 - bit.ravel()), len(own)), np.bincount(at, n * bit.ravel(), len(own))
            if below is not None:
                below = np.bincount(np.searchsorted(own, up_one(below[0])), below[1], len(own))
            p, w, k = weigh(a, b, below)
            self.nodes[d], self.weight[d], self.one[d] = own, w, k
            below = own, p
            self.a, self.b, self.p = a, b, p

    def decisions(self, keys: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, bit), eight rows of them: at depth d, the context's nearest d bytes and the bits decided so far."""
        byte = keys & _U(255)
        context = keys >> _U(8 * (self.depth - d + 1)) << _U(8)
        node = np.stack([context | _U(1 << j) | (byte >> _U(8 - j)) for j in range(8)])
        return node, np.stack([(byte >> _U(7 - j)) & _U(1) for j in range(8)]).astype(np.float64)

    def one_of(self, keys: np.ndarray) -> np.ndarray:
        """Eight rows: the probability that the decision is a one, mixed from the longest context up to depth least."""
        p = None
        for d in range(self.depth, self.least - 1, -1):
            at = np.searchsorted(self.nodes[d], self.decisions(keys, d)[0])
            w, k = self.weight[d][at], self.one[d][at]
            p = k if p is None else w * k + (1 - w) * p
        return p


def up_one(node: np.ndarray) -> np.ndarray:
    """The node of the same decision with one byte less of context."""
    return (node >> _U(16) << _U(8)) | (node & _U(255))


def _trees(rows: pa.Table, depth: int) -> tuple[np.ndarray, Trees]:
    keys = rows.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    keys = keys[order]
    return keys, Trees(keys, rows.column("n").to_numpy()[order].astype(np.float64), depth, TOP)


def _work_up(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _runs(batches, "part"):
            _, trees = _trees(rows, depth)
            own, at = np.unique(up_one(trees.nodes[TOP]), return_inverse=True)
            sums = [np.bincount(at, x, len(own)) for x in (trees.a, trees.b, trees.p)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(own.view(np.int64)), *map(pa.array, sums)], names=["part", "node", "a", "b", "below"])

    return run


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, below = (batch.column(c).to_numpy() for c in ("a", "b", "below"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("a"), batch.column("b"), *map(pa.array, weigh(a, b, below))], names=["node", "a", "b", "p", "w", "k"])


def _crown(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """From the sums of nodes with one byte of context: x, y such that a decision has x + y times what is deeper."""
    a, b, below = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
    for r in rows:
        a[r.node], b[r.node], below[r.node] = r.a, r.b, r.below
    p1, w1, k1 = weigh(a, b, below)
    by = lambda v: v.reshape(256, 256).sum(axis=0)
    _, w0, k0 = weigh(by(a), by(b), by(p1))
    w0, k0 = np.tile(w0, 256), np.tile(k0, 256)
    return w0 * k0 + (1 - w0) * w1 * k1, (1 - w0) * (1 - w1)


def _work_down(depth: int, bits: int, crown):
    """Rows of a part: its grams (n) and the nodes above its trees (w, k). Out: log10 of each gram's probability."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, ends, keys, values = _by_bucket(GRAM, *(np.concatenate(x) for x in zip(*held, strict=True)), bits)
        n = len(bucket)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, GRAM, np.int32)), pa.array(bucket), _lists(keys.view(np.int64), ends, pa.int64()), _lists(values, ends, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = crown.value
        held, n = [], 0
        for _, rows in _runs(batches, "part"):
            is_gram = rows.column("n").is_valid()
            keys, trees = _trees(rows.filter(is_gram), depth)
            above = rows.filter(rows.column("n").is_null())
            node = above.column("key").to_numpy().view(_U)
            order = np.argsort(node)
            w, k = above.column("w").to_numpy()[order], above.column("k").to_numpy()[order]
            own, bit = trees.decisions(keys, TOP - 1)
            at = np.searchsorted(node[order], own)
            one = w[at] * k[at] + (1 - w[at]) * trees.one_of(keys)
            at = up_one(own).astype(np.int64)
            one = x[at] + y[at] * one
            held.append((keys, np.log10(np.where(bit > 0, one, 1 - one)).sum(axis=0)))
            n += len(keys)
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: first the answers (no chunk), then what each chunk asked for."""
    current, keys, values = None, [], []
    table_: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        n = batch.num_rows
        kinds, buckets, chunks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "chunk"))
        asks = batch.column("chunk").is_valid().to_numpy(zero_copy_only=False)
        out, got = [], []
        for r in range(n):
            if current != (kinds[r], buckets[r]):
                current, keys, values, table_ = (kinds[r], buckets[r]), [], [], None
            if not asks[r]:
                keys.append(_numbers(batch, "keys", r).view(_U))
                values.append(_numbers(batch, "values", r))
                continue
            if table_ is None:
                k, v = np.concatenate(keys), np.concatenate(values)
                order = np.argsort(k)
                table_ = k[order], v[order]
            out.append(r)
            got.append(table_[1][np.searchsorted(table_[0], _numbers(batch, "keys", r).view(_U))])
        if out:
            asked = batch.take(pa.array(out))
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])])
            yield pa.RecordBatch.from_arrays([pa.array(chunks[out].astype(np.int64)), asked.column("kind"), asked.column("keys"), _lists(np.concatenate(got), ends, pa.float64())], names=["chunk", "kind", "keys", "values"])


class Lookup:
    """Values by key, in tables of slots; keys that lose their slot to another go to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.tables = keys, values, []
        rest = np.arange(len(keys), dtype=np.int32)
        while len(rest):
            bits = max(8, (4 * len(rest)).bit_length())
            slots = np.zeros(1 << bits, np.int32)
            own = self._slot(keys[rest], len(self.tables), bits)
            slots[own] = rest
            self.tables.append((bits, slots))
            rest = rest[slots[own] != rest]

    @staticmethod
    def _slot(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
        h = keys * _U((0x9E3779B97F4A7C15 * (2 * turn + 1)) & ((1 << 64) - 1))
        return ((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - bits)).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(asked)), None
        for turn, (bits, slots) in enumerate(self.tables):
            part = asked if open_ is None else asked[open_]
            at = slots[self._slot(part, turn, bits)]
            hit = self.keys[at] == part
            if open_ is None:
                out = self.values[at]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = self.values[at[hit]]
                open_ = open_[~hit]
            if not len(open_):
                return out
        if len(asked):
            raise RuntimeError("a chunk holds keys that were not counted")
        return out


def _score(depth: int, n_tokens: int, vocabulary: int):
    """Rows of a chunk: first its answers, then its texts."""
    names = [x.split()[0] for x in _SCORES.split(", ")]
    least = float(n_tokens + vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, got, find = None, {GRAM: [], WORD: []}, {}
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            is_text = batch.column("kind").is_null().to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").fill_null(0).to_numpy()
            edges = np.flatnonzero(np.append(True, (chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1]))) if len(chunks) else []
            for a, b in zip(edges, np.append(edges[1:], len(chunks)), strict=True):
                if current != chunks[a]:
                    current, got, find = chunks[a], {GRAM: [], WORD: []}, {}
                if not is_text[a]:
                    for r in range(a, b):
                        got[kinds[r]].append((_numbers(batch, "keys", r).view(_U), _numbers(batch, "values", r)))
                    continue
                if not find:
                    find = {kind: Lookup(*(np.concatenate(x) for x in zip(*rows, strict=True))) for kind, rows in got.items()}
                    got = {GRAM: [], WORD: []}
                for r in range(a, b):
                    yield scored(batch, r, find)

    def scored(batch: pa.RecordBatch, row: int, find: dict[int, Lookup]) -> pa.RecordBatch:
        offsets = np.append(0, _numbers(batch, "ends", row))
        data = np.frombuffer(pa.decompress(batch.column("block")[row].as_py(), int(offsets[-1]), "zstd", asbytes=True), np.uint8)
        key, start = grams(data, offsets, depth)
        score = np.add.reduceat(find[GRAM].find(key), start[:-1])
        w = K.words(data, offsets)
        count, end = find[WORD].find(w.hashes(True)), find[WORD].find(np.array([_END_WORD]))[0]
        logs = np.log10((count + 1) / least)
        base = np.array([logs[a:b].sum() for a, b in zip(w.of[:-1], w.of[1:], strict=True)]) + np.log10((end + 1) / least)
        test = ~_numbers(batch, "train", row).astype(bool)
        columns = [batch.column("ids")[row].values, pa.array(test), pa.array(w.counts + 1, pa.int64()), pa.array(K.per_text(count > 0, w.of) + (end > 0), pa.int64()), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test: Column | None = None, depth: int = DEPTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    The model is trained on the rows for which test (held_out() of the id by default) does not hold."""
    if not TOP <= depth <= 7:
        raise ValueError(f"depth must be {TOP} to 7")
    spark = docs.sparkSession
    small_batches(spark)
    test = held_out(id_col) if test is None else test
    docs = docs.select(F.col(id_col).cast("long").alias("id"), (~F.coalesce(test, F.lit(False))).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(18, max(5, (size >> 22).bit_length()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))

    gathered = written(docs.mapInArrow(_gather(depth, bits, chunk_bytes), _GATHERED), "lm-gathered")
    asked = gathered.where("kind IS NOT NULL").select("chunk", "kind", "bucket", "keys", "counts")
    sums = asked.select("kind", "bucket", "keys", "counts").repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    totals = written(sums.mapInArrow(_sum_up, _ANSWERS), "lm-totals")
    vocabulary, n_tokens = totals.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    # Grams dealt by their nearest TOP bytes.
    flat = totals.where(F.col("kind") == GRAM).select(F.explode(F.arrays_zip("keys", "values")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.values").cast("long").alias("n"))
    part = F.pmod(F.xxhash64(F.shiftright("key", 8 * (depth - TOP + 1))), F.lit(1 << bits)).cast("int")
    flat = flat.withColumn("part", part)
    ups = written(flat.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_work_up(depth), "part int, node long, a double, b double, below double"), "lm-ups")
    pairs = ups.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("a", "b", "below"))).mapInArrow(_weighed, "node long, a double, b double, p double, w double, k double")
    pairs = written(pairs, "lm-pairs")
    one = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
    crown = _crown(pairs.groupBy(one.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("p").alias("below")).collect())  # 65,280 rows at most
    above = ups.select("part", "node").join(pairs.select("node", "w", "k"), "node").select("part", F.col("node").alias("key"), F.lit(None).cast("long").alias("n"), "w", "k")
    rows = flat.select("part", "key", "n", F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("k")).unionByName(above)
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part")
    answers = rows.mapInArrow(_work_down(depth, bits, spark.sparkContext.broadcast(crown)), _ANSWERS).unionByName(totals.where(F.col("kind") == WORD))

    answers = answers.select(F.lit(None).cast("long").alias("chunk"), "kind", "bucket", "keys", "values")
    both = answers.unionByName(asked.select("chunk", "kind", "bucket", "keys", F.lit(None).cast("array<double>").alias("values")))
    both = both.repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("chunk").asc_nulls_first())
    answered = both.mapInArrow(_answer, "chunk long, kind int, keys array<long>, values array<double>")

    texts = gathered.where("kind IS NULL").select("chunk", "kind", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<double>").alias("values"), "ids", "train", "ends", "block")
    blank = {"ids": "array<long>", "train": "array<boolean>", "ends": "array<long>", "block": "binary"}
    answered = answered.select("*", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    last = answered.unionByName(texts).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("kind").asc_nulls_last())
    return last.mapInArrow(_score(depth, n_tokens, vocabulary), _SCORES).withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def op10(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
