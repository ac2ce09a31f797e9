"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every document is a query (words in Unicode lower case without the punctuation and symbols at their
ends, each distinct word once); all items whose score reaches THETA of what the item's own text would score are
retrieved, and a hit counts if enough of the item's question and of its answer is in the passage, run by run of words.
A run has GRAM words, in a short side fewer, so that one changed word breaks half of a side's runs at most; an answer of
one word may be missing if NEARLY all of a question of 2 GRAM words or more is there. Items under 2 GRAM words in all are
too common for that: a side of theirs has runs of up to GRAM words.

Items go by length: those of up to S words, S being 32 times a power of two, are looked for in passages of 2 S words at
every S words, so an item always lies whole in some passage, and what is found of an item depends on that item, the
document and the word counts of the whole benchmark alone.

The index is small and goes to the executors; the texts stay where they are: no shuffle. Test items are indexed in
blocks of about BLOCK_CHARS characters, one pass over the documents each and one broadcast at a time, so what is held is
bounded whatever the size of the benchmark. A first bound saves most passages the WAND loop: words that together give no
item more than SLACK of its score are set aside, and a passage goes on if some item reaches THETA with the impacts of its
other words plus all that was set aside for that item. That is never less than the item's score, so no hit is lost.

An item's answer is its last sentence, its question the rest; of a single sentence, the answer is the last quarter.

Defined results: null or word-free texts contain nothing and are never contaminated; null or word-free items are
never found; several items with equal text are each found; a document has one row per item, with the best passage
(the first of equals); repeated document rows each give their own; empty tables give an empty result; other columns
are not looked at, whatever their names are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import numbered, small_batches, table, written

K1, B, THETA, SLACK, POSTING_BLOCK = 1.2, 0.75, 0.5, 0.2, 32
QUESTION, ANSWER, NEARLY, GRAM, SHORTEST = 0.5, 0.5, 0.9, 4, 32
BLOCK_CHARS = 4_000_000
HITS = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
_EPS = 1e-9
_UNSIGNED = (1 << 64) - 1


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    ends = [m.end() for m in re.finditer(r"[.?!][\x20\x09-\x0D]+", text.rstrip("\x20\x09\x0a\x0b\x0c\x0d"))]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    cut = len(words) - max(1, len(words) // 4)
    return (" ".join(words[:cut]), " ".join(words[cut:])) if cut else (text, text)


def _hashes(text: str) -> np.ndarray:
    for _, _, data, offsets in K.slices(K.lowered(pa.array([text], pa.large_string()))):
        return K.bare(data, offsets).hashes(False)
    return np.zeros(0, np.uint64)


def run_lengths(*sides: int) -> list[int]:
    """Words per run of each side of an item: as many as leave half of the runs whole when one word changes, GRAM at most."""
    short = sum(sides) < 2 * GRAM
    return [max(1, min(GRAM, n if short else (n + 1) // 3)) for n in sides]


def stride_of(n: int) -> int:
    """The passage stride for items of n words."""
    return SHORTEST << max(0, (max(n, 1) - 1).bit_length() - (SHORTEST - 1).bit_length())


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    return np.unique(K.window_at(h, np.arange(len(h) - size + 1), size)) if len(h) >= size else np.zeros(0, np.uint64)


class ItemIndex:
    """Postings by word hash: items of one stride in order, with their share of the item's own score."""

    def __init__(self, stride: int, kept: list[tuple[int, np.ndarray, str]], df: dict[int, int], n_items: int, mean_words: float) -> None:
        """kept: (item, its word hashes, its text), by item; df: items of the whole benchmark per word."""
        self.ids = np.array([i for i, _, _ in kept], np.int64)
        self.stride = stride
        self.parts = []
        for _, _, t in kept:
            sides = [_hashes(side) for side in split_item(t)]
            self.parts.append([(size, _grams(side, size), len(side)) for side, size in zip(sides, run_lengths(*map(len, sides)), strict=True)])
        rows: dict[int, list[tuple[int, float]]] = {}
        for k, (_, h, _) in enumerate(kept):
            impact = {}
            for term, tf in Counter(h.tolist()).items():
                idf = log(1 + (n_items - df[term] + 0.5) / (df[term] + 0.5))
                impact[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_words))
            own = sum(impact.values())
            for term, x in impact.items():
                rows.setdefault(term, []).append((k, x / own))
        self.terms = np.array(sorted(rows), np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum([len(rows[t]) for t in self.terms.tolist()])]).astype(np.int64)
        flat = [x for t in self.terms.tolist() for x in rows[t]]
        self.items = np.array([x[0] for x in flat], np.int64)
        self.impact = np.array([x[1] for x in flat])
        self.top = np.array([max(x[1] for x in rows[t]) for t in self.terms.tolist()])
        # Block maxima: the greatest impact and the last item of every POSTING_BLOCK postings of a term.
        self.block_max = [[float(self.impact[i : min(i + POSTING_BLOCK, e)].max()) for i in range(s, e, POSTING_BLOCK)] for s, e in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        self.block_last = [[int(self.items[min(i + POSTING_BLOCK, e) - 1]) for i in range(s, e, POSTING_BLOCK)] for s, e in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        # The same postings as lists, for the loop of search().
        self.lists = [(self.items[s:e].tolist(), self.impact[s:e].tolist()) for s, e in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        # Set aside the words in most items first, as long as no item has more than SLACK of its score from them.
        self.slack = np.zeros(len(self.ids))
        self.essential = np.ones(len(self.terms), bool)
        for t in np.argsort(-np.diff(self.offsets), kind="stable"):
            s, e = self.offsets[t], self.offsets[t + 1]
            if (self.slack[self.items[s:e]] + self.impact[s:e] <= SLACK).all():
                self.slack[self.items[s:e]] += self.impact[s:e]
                self.essential[t] = False
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.terms >> np.uint64(46)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, term) of the hashes that are terms."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(46)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[t] == h[at]
        return at[ok], t[ok]

    def reachable(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages for which some item may reach THETA, from distinct (passage, term) pairs."""
        ess = self.essential[term]
        passage, term = passage[ess], term[ess]
        n = self.offsets[term + 1] - self.offsets[term]
        post = np.repeat(self.offsets[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = np.repeat(passage, n) * len(self.ids) + self.items[post]
        order = np.argsort(key, kind="stable")
        key, gain = key[order], self.impact[post][order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(start):
            return start
        total = np.add.reduceat(gain, start) + self.slack[key[start] % len(self.ids)]
        return np.unique(key[start][total >= THETA - _EPS] // len(self.ids))

    def search(self, terms: list[int], theta: float = THETA) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items whose score for these distinct terms is theta or more."""
        cursors = [[self.lists[t][0][0], t, 0] for t in terms]
        top, last, found = self.top.tolist(), 1 << 60, []

        def seek(c: list, item: int) -> None:
            posting = self.lists[c[1]][0]
            c[2] = bisect_left(posting, item, c[2])
            c[0] = posting[c[2]] if c[2] < len(posting) else last

        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == last:
                    break
                bound += top[c[1]]
                if bound >= theta - _EPS:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks = [(c, bisect_left(self.block_last[c[1]], item)) for c in cursors[: pivot + 1]]
            near = sum(self.block_max[c[1]][k] for c, k in blocks if k < len(self.block_max[c[1]]))
            if near >= theta - _EPS:
                if cursors[0][0] == item:
                    score = sum(self.lists[c[1]][1][c[2]] for c in cursors[: pivot + 1])
                    if score >= theta - _EPS:
                        found.append((item, score))
                    for c in cursors[: pivot + 1]:
                        seek(c, item + 1)
                else:
                    for c in cursors[: pivot + 1]:
                        if c[0] < item:
                            seek(c, item)
            else:  # no item of these blocks can reach theta
                skip = min([self.block_last[c[1]][k] + 1 for c, k in blocks if k < len(self.block_last[c[1]])] + ([cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else []))
                for c in cursors[: pivot + 1]:
                    seek(c, max(skip, item + 1) if skip <= item else skip)

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """The shares of the item's question and answer windows that the passage holds."""
        return tuple(float(np.isin(grams, _grams(passage, size)).mean()) if len(grams) else 1.0 for size, grams, _ in self.parts[item])

    def holds(self, item: int, q: float, a: float) -> bool:
        """Whether these shares are a hit: both sides, or nearly all of a long question of which the answer is one word."""
        (_, _, n_question), (_, _, n_answer) = self.parts[item]
        return q >= QUESTION and (a >= ANSWER or (n_answer == 1 and n_question >= 2 * GRAM and q >= NEARLY))


def passages_of(index: ItemIndex, h: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(text, item, first word, score, question share, answer share) of the hits in a slice of texts."""
    at, term = index.lookup(h)
    if not len(at):
        return
    s = index.stride
    owner = np.searchsorted(of, at, "right") - 1
    counts = np.diff(of)
    runs = np.maximum(1, -(-counts // s))  # strides per text; passage k of a text has strides k and k + 1
    base = np.concatenate([[0], np.cumsum(runs)])
    stride = (at - of[owner]) // s
    own = base[owner] + stride
    key = np.concatenate([own, own[stride > 0] - 1]) * len(index.terms) + np.concatenate([term, term[stride > 0]])
    key = np.unique(key)
    passage, term = key // len(index.terms), key % len(index.terms)
    for p in index.reachable(passage, term).tolist():
        lo, hi = np.searchsorted(passage, [p, p + 1])
        text = int(np.searchsorted(base, p, "right") - 1)
        first = (p - int(base[text])) * s
        words = h[of[text] + first : min(of[text] + first + 2 * s, of[text + 1])]
        for item, score in index.search(term[lo:hi].tolist()):
            q, a = index.verify(item, words)
            if index.holds(item, q, a):
                yield text, item, first, score, q, a


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), []
            for f, _, data, offsets in K.slices(K.lowered(batch.column("text"))):
                w = K.bare(data, offsets)
                h = w.hashes(False)
                for index in shared.value:
                    best: dict[tuple[int, int], tuple] = {}
                    for text, item, first, score, q, a in passages_of(index, h, w.of):
                        hit = (-q - a, -score, first)
                        if (text, item) not in best or hit < best[text, item][0]:
                            best[text, item] = hit, (ids[f + text], int(index.ids[item]), first, score, q, a)
                    rows += [x[1] for x in best.values()]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    return run


def _holder(shared):
    def holds(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for f, _, data, offsets in K.slices(K.lowered(texts)):
            w = K.bare(data, offsets)
            h = w.hashes(False)
            for index in shared.value:
                for hit in passages_of(index, h, w.of):
                    out[f + hit[0]] = True
        return pa.array(out)

    return holds


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item."""
    for batch in batches:
        n, terms = [], []
        for _, _, data, offsets in K.slices(K.lowered(batch.column("text"))):
            w = K.bare(data, offsets)
            h = w.hashes(False).view(np.int64)
            n.append(w.counts)
            terms += [np.unique(h[a:b]) for a, b in zip(w.of[:-1], w.of[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("text"), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "text", "n", "terms"])


def indexes(items: DataFrame, item_col: str = "item_id", item_text: str = "text") -> Iterator[list[ItemIndex]]:
    """Per block of items, one index for each stride. The driver holds one block's texts and the counts of its words at a time."""
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).dropna()
    items = written(items.mapInArrow(_terms, "item long, text string, n long, terms array<long>").where("n > 0"), "benchmark-items")
    n_items, mean, chars = items.agg(F.count("*"), F.avg("n"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    frequency = written(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "benchmark-words")
    blocks = ceil(chars / BLOCK_CHARS)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        words = frequency.join(block.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi") if blocks > 1 else frequency
        df = {r.term & _UNSIGNED: r.df for r in words.collect()}
        by_stride: dict[int, list] = {}
        for r in sorted(block.select("item", "text", "n").collect()):
            by_stride.setdefault(stride_of(r.n), []).append((r.item, _hashes(r.text), r.text))
        if by_stride:
            yield [ItemIndex(s, kept, df, n_items, mean) for s, kept in sorted(by_stride.items())]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """HITS: the (document, item) pairs in which the document holds the item's question and answer."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], HITS)
    for index in indexes(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)
        out = out.unionByName(written(docs.mapInArrow(_finder(shared), HITS), "benchmark-hits"))
        shared.destroy()
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, whole; nothing moves. A benchmark of several blocks is one pass, and one written table, per block."""
    spark, columns = docs.sparkSession, docs.columns
    small_batches(spark)
    rows, names = numbered(docs)
    text, before = F.col(names[columns.index(text_col)]).cast("string"), None
    for index in indexes(items, item_col, item_text):
        if before is not None:
            rows = written(rows, "benchmark-clean")
            before.destroy()
        before = spark.sparkContext.broadcast(index)
        rows = rows.where(~F.arrow_udf(_holder(before), "boolean")(text))
    return rows.toDF(*columns)


def op2(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
