"""Exact k-means on integer vectors with Elkan's bounds.

Every vector keeps its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to each
centroid. A distance is worked out only where no bound rules the centroid out: half the distance between two centroids, or a
lower bound, above the upper bound. Bounds are rounded away from the truth with each step and prune only when strictly apart, so
ties are seen; what decides is always the exact squared distance, in integers. Assignments so equal those of the plain method.

Spark deals the vectors; a task walks Arrow batches with numpy. Rounds are written to the shared folder and the one before goes.
To the driver come the sums of the k clusters only (k x dimension integers); back go the centroids with the function. Nothing is
shuffled but partial sums.

Defined results: vectors that are null, of another length, with null or non-finite components, or with a component whose integer
is beyond 2 ** 27 (its squared distances would not fit a long) are left out; with fewer vectors than k there are as many
centroids as vectors; of repeated ids each row is a vector of its own; a null id may be no start while others are left; an empty
table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_path, write
from .common import small_batches, table

#: Largest magnitude of a component.
MOST = 1 << 27
#: Relative slack of a step in double, and of one stored as float.
FINE, COARSE = 2.0**-50, 2.0**-21


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    apart = rows - centroids
    return np.einsum("ij,ij->i", apart, apart)


def elkan(rows: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """One assignment, in place: cluster, upper and lower are brought up to date. Returns the number of distances worked out per row.

    moved: how far each centroid has moved since the bounds were right. Rows without a cluster (-1) start at the first centroid."""
    k, done = len(centroids), np.zeros(len(rows), np.int32)
    between = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(np.float64)) * (1 - FINE) / 2
    nearest = np.where(np.eye(k, dtype=bool), np.inf, between).min(1)
    lower -= moved * (1 + FINE)
    lower *= 1 - COARSE
    np.maximum(lower, 0, out=lower)
    fresh = cluster < 0
    cluster[fresh] = 0
    upper[~fresh] = (upper[~fresh] + moved[cluster[~fresh]]) * (1 + 4 * FINE)
    upper[fresh] = np.inf
    at = np.flatnonzero(~(upper < nearest[cluster]))
    square = np.zeros(len(rows), np.int64)
    square[at] = _squares(rows[at], centroids[cluster[at]])
    upper[at] = np.sqrt(square[at].astype(np.float64)) * (1 + FINE)
    lower[at, cluster[at]] = np.sqrt(square[at].astype(np.float64)) * (1 - FINE)
    done[at] += 1
    for j in range(k):
        own = cluster[at]
        left = at[(own != j) & ~(upper[at] < lower[at, j]) & ~(upper[at] < between[own, j])]
        if not len(left):
            continue
        far = _squares(rows[left], centroids[j])
        done[left] += 1
        lower[left, j] = np.sqrt(far.astype(np.float64)) * (1 - FINE)
        near = (far < square[left]) | (far == square[left]) & (j < cluster[left])
        won = left[near]
        cluster[won], square[won], upper[won] = j, far[near], np.sqrt(far[near].astype(np.float64)) * (1 + FINE)
    return done


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """state (id, v, cluster, upper, lower, work) after one assignment."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = _matrix(b.column("v"), np.int64)
            cluster, upper, work = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "work"))
            lower = _matrix(b.column("lower"), np.float64) if (cluster >= 0).any() else np.zeros((len(rows), k))
            done = elkan(rows, centroids, cluster, upper, lower, moved)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower * (1 - COARSE), pa.float32()), pa.array(work + done, pa.int32())], ["id", "v", "cluster", "upper", "lower", "work"])

    return state.mapInArrow(run, state.schema)


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, work): the exact squared distance to the vector's centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                distance = _squares(_matrix(b.column("v"), np.int64), centroids[b.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(distance), b.column("work")], ["id", "cluster", "distance", "work"])

    return state.select("id", "v", "cluster", "work").mapInArrow(run, "id long, cluster int, distance long, work int")


def whole(vectors: DataFrame, key: str, vector: str, dimension: int, scale: float) -> DataFrame:
    """(id, v): the kept vectors as integers."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    fits = (F.size(vector) == dimension) & F.forall(scaled, lambda x: F.coalesce(F.abs(x) <= MOST, F.lit(False)))
    return vectors.where(fits).select(F.col(key).cast("long").alias("id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def _starts(state: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes: k rows at the driver."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("v", "id", draw.alias("draw")).orderBy(F.asc_nulls_last("draw"), F.asc_nulls_last("id"), "v").limit(k)
    return np.array([r.v for r in first.collect()], np.int64)


def _moved_on(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster's centroid stays. One row per cluster comes to the driver."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])))
    after = centroids.copy()
    for r in sums.collect():
        after[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
    return after


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dimension: int = 64, scale: float = 256.0, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, work) per kept vector, the centroids). work: the distances worked out for the vector in all rounds,
    of k in each. The table is written."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = shared_path(spark, "clusters")
    kept = whole(vectors, key, vector, dimension, scale).withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0).cast("double"), "lower": F.array().cast("array<float>"), "work": F.lit(0)})
    state = write(kept, f"{folder}/0")
    centroids = _starts(state, k, seed)
    moved = np.zeros(len(centroids))
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, work int"), np.zeros((0, dimension), np.int64)
    for turn in range(1, rounds + 2):
        state = write(_assigned(state, centroids, moved), f"{folder}/{turn}")
        remove(spark, f"{folder}/{turn - 1}")
        if turn <= rounds:
            after = _moved_on(state, centroids)
            moved = np.sqrt(_squares(after, centroids).astype(np.float64)) * (1 + FINE)
            centroids = after
    out = write(_measured(state, centroids), f"{folder}/out")
    remove(spark, f"{folder}/{rounds + 1}")
    return out, centroids


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings, with the inertia of each and of all, and a digest of the centroid."""
    rows, centroids = clusters(table(spark, sf_dir, "embeddings"))
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    facts = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), h) for j, h in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
