"""Vector functions. Scores of many rows against a few query vectors are one matrix product per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def dot(a: Column, b: Column) -> Column:
    """In double; null if the lengths differ."""
    sum_ = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), sum_)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def scores(vector: Column, queries: list[list[float]]) -> Column:
    """array<double>: the dot product with each query. Rows of another length than the queries' raise an error; null gives null.

    queries are the clauses of one request, so they travel with the function."""
    matrix = np.asarray(queries, np.float64).T

    def product(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(np.asarray(column.offsets))
        there = ~np.asarray(column.is_null())
        if (sizes[there] != matrix.shape[0]).any():
            raise ValueError(f"a vector has not {matrix.shape[0]} dimensions")
        rows = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[0])
        out = rows @ matrix
        ends = np.concatenate([[0], np.cumsum(there * matrix.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~there))

    return F.arrow_udf(product, "array<double>")(vector)


#: Vectors in a packed row, and packed rows that meet in a task at most, about: 64 of a thousand vectors.
BLOCK, GROUP = 1024, 64


def packed(rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(block, ids, size, data): rows packed, `block` vectors to a row, where they are; null keys and vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, serial, ids, parts = TaskContext.get().partitionId() << 32, 0, [], []

        def row() -> pa.RecordBatch:
            keys, data = np.concatenate(ids), np.concatenate(parts)
            return pa.RecordBatch.from_pydict({"block": pa.array([at + serial]), "ids": pa.array([keys]), "size": pa.array([data.shape[1]], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

        held = 0
        for b in batches:
            vectors = b.column(1)
            sizes = np.diff(np.asarray(vectors.offsets))
            if len(sizes) and (sizes != sizes[0]).any() or parts and len(sizes) and sizes[0] != parts[0].shape[1]:
                raise ValueError("vectors are not of one length")
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
            keys, at_row = b.column(0).to_numpy(), 0
            while at_row < len(keys):
                take = min(block - held, len(keys) - at_row)
                ids.append(keys[at_row : at_row + take])
                parts.append(matrix[at_row : at_row + take])
                held, at_row = held + take, at_row + take
                if held == block:
                    yield row()
                    serial, ids, parts, held = serial + 1, [], [], 0
        if held:
            yield row()

    there = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return there.mapInArrow(run, "block long, ids array<long>, size int, data binary")


def _matrix(ids: pa.ListScalar, data: pa.BinaryScalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    return ids.values.to_numpy(), np.frombuffer(data.as_buffer(), np.float64).reshape(-1, size)


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query row, item, score, ...): the k best of every query row, ties by item."""
    query, item, score = rows[:3]
    order = np.lexsort((item, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, "left")
    kept = order[np.arange(len(order)) - first < k]
    return [x[kept] for x in rows]


class Top:
    """The k best items of each of n queries, over blocks of scores (queries, items); `more` of the same shape is kept along."""

    def __init__(self, n: int, k: int, kinds: tuple[type, ...] = ()) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.rows = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64, *kinds)]

    def add(self, items: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        k, n = self.k, len(self.least)
        floor = np.maximum(self.least, -np.partition(-score, k - 1, axis=1)[:, k - 1]) if 0 < k <= score.shape[1] else self.least
        at, col = np.nonzero(score >= floor[:, None])
        self.rows = _best([np.concatenate(x) for x in zip(self.rows, (at, items[col], score[at, col], *(m[at, col] for m in more)), strict=True)], k)
        counts = np.bincount(self.rows[0], minlength=n)
        full = np.flatnonzero(counts >= k) if k else np.zeros(0, np.int64)
        self.least[full] = self.rows[2][np.cumsum(counts)[full] - 1]


class Fold(Protocol):
    """What a task makes of the scores of one block of queries: add() is called with each block of items, out() gives the columns of the result."""

    def add(self, items: np.ndarray, given: np.ndarray, score: np.ndarray) -> None: ...

    def out(self) -> list[np.ndarray]: ...


def blocks(rows: DataFrame, key: str, vector: str, name: str, given: Sequence[str] = ()) -> DataFrame:
    """packed() rows as a table, the numbers of the columns `given` (as doubles; null as NaN) before each vector."""
    numbers = F.array(*(F.col(c).cast("double") for c in given)).cast("array<double>")
    return written(packed(rows.select(F.col(key).alias("id"), F.concat(numbers, F.col(vector).cast("array<double>")).alias("v")), "id", "v"), name)


def _met(asked: DataFrame, all_: DataFrame) -> DataFrame:
    """Every packed row of queries beside every packed row of vectors: both are dealt by two small numbers."""
    n_asked, n_all = asked.count(), all_.count()  # packed rows
    groups_asked = max(1, -(-n_asked // GROUP))
    groups_all = max(1, -(-n_all // GROUP), min(n_all, 2 * all_.sparkSession.sparkContext.defaultParallelism))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = all_.withColumn("b", place(groups_all)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(groups_asked - 1))))
    right = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns), place(groups_asked).alias("q_a"), F.explode(F.sequence(F.lit(0), F.lit(groups_all - 1))).alias("q_b"))
    return left.join(right, (F.col("a") == F.col("q_a")) & (F.col("b") == F.col("q_b"))).select("q_block", "q_ids", "q_size", "q_data", "ids", "size", "data")


def _products(batches: Iterator[pa.RecordBatch], given: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block of queries, their ids and given numbers, items, their given numbers, scores to six decimals) of every pair of blocks."""
    for b in batches:
        for i in range(b.num_rows):
            of, q_size, size = (b.column(c)[i].as_py() for c in ("q_block", "q_size", "size"))
            if q_size - given[0] != size - given[1]:
                raise ValueError(f"a vector has not {q_size - given[0]} dimensions")
            (ids, matrix), (items, vectors) = (_matrix(b.column(x)[i], b.column(y)[i], n) for x, y, n in (("q_ids", "q_data", q_size), ("ids", "data", size)))
            product = np.round(matrix[:, given[0] :] @ vectors[:, given[1] :].T, 6) + 0.0  # no negative zero
            yield of, ids, matrix[:, : given[0]], items, vectors[:, : given[1]], product


def folded(asked: DataFrame, all_: DataFrame, given: tuple[int, int], make: Callable[[np.ndarray, np.ndarray], Fold], schema: str) -> DataFrame:
    """What make(ids, given numbers) makes of the scores of every block of queries against every group of rows; both are blocks(),
    with so many given numbers. Scores stay in the task: what it hands on is as much as the folds of at most GROUP blocks keep."""
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Fold] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for fold in held.values():
                yield pa.RecordBatch.from_pydict(dict(zip(names, fold.out(), strict=True)))
            held.clear()

        for of, ids, numbers, items, more, score in _products(batches, given):
            if of not in held and len(held) >= GROUP:
                yield from out()
            if of not in held:
                held[of] = make(ids, numbers)
            held[of].add(items, more, score)
        yield from out()

    return _met(asked, all_).mapInArrow(meet, schema)


def scored(queries: DataFrame, rows: DataFrame, k: int | None, key: str, vector: str = "vector") -> DataFrame:
    """(query, item, score) of every query (key, vector) against every row (key, vector), scores to six decimals; with k, of each group of rows the k best only.

    Blocks of queries meet blocks of rows: both are packed, a thousand vectors to a row, and dealt by two small numbers; a task
    multiplies the two matrices of each pair that meets and holds k results for each query of at most GROUP blocks. Queries travel
    once for every group of rows, rows once for every group of queries, unless Spark finds one side small; no task's memory grows
    with the tables."""
    asked, all_ = (blocks(t, key, vector, n) for t, n in ((queries, "query-blocks"), (rows, "vector-blocks")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, items, _, score in _products(batches, (0, 0)):
            yield pa.RecordBatch.from_pydict({"query": np.repeat(ids, len(items)), "item": np.tile(items, len(ids)), "score": score.ravel()})

    class Best:
        def __init__(self, ids: np.ndarray, _: np.ndarray) -> None:
            self.ids, self.top = ids, Top(len(ids), k)

        def add(self, items: np.ndarray, _: np.ndarray, score: np.ndarray) -> None:
            self.top.add(items, score)

        def out(self) -> list[np.ndarray]:
            return [self.ids[self.top.rows[0]], *self.top.rows[1:]]

    schema = "query long, item long, score double"
    return _met(asked, all_).mapInArrow(whole, schema) if k is None else folded(asked, all_, (0, 0), Best, schema)
