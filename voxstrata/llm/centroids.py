"""Centroid clustering of integer vectors with partial-distance search.

Components become integers, so distances, sums and centroids are exact and
don't depend on the partitioning.  A batch of vectors is assigned by partial
distances: squared differences are added up over the dimensions in the order
of falling variance, some at a time; a centroid is abandoned for a vector once
its partial sum is strictly above the vector's best whole distance, and
survivors finish all dimensions.  The first centroid finished is the one that
leads on the first dimensions, so the best is small from the start; ties go to
the smaller number.

A round is one pass over the vectors.  Each task adds up its vectors by
centroid and sends at most ``k`` rows of sums; these are summed by (centroid,
dimension), so no group grows with the data and the driver gets k x dims
numbers.  Vectors are read again in every round from their table; the integers
are made on the way.

Defined cases: vectors that are null, have another length, hold null or
non-finite components, or components beyond +-``LARGEST`` (whose squared
distances don't fit 64 bits) are left out; rows that repeat an id or a vector
are rows of their own; a null id is kept and is hashed as an empty string; with
fewer vectors than k there are as many centroids as vectors; equal centroids
keep their numbers, and the smaller takes all; an inertia of over 63 bits is
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, K, ROUNDS = 64, 8, 10
#: Components are floor(SCALE * x).
SCALE = 1024
#: Bound of an integer component: 64 squares of twice that fit 63 bits.
LARGEST = 1 << 27
SEED = 3
#: Dimensions added before centroids are abandoned.
STEP = 8


def integer_vectors(batch: pa.RecordBatch, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers kept and their integer components (rows x dims) of column 1, a list of numbers."""
    lists = batch.column(1)
    if pa.types.is_null(lists.type):
        return np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    right = (np.diff(offsets) == dims) & np.asarray(lists.is_valid())
    rows = np.flatnonzero(right)
    values = lists.values.cast(pa.float64())
    # nulls become NaN and are left out as such
    flat = values.to_numpy(zero_copy_only=False)
    taken = flat[offsets[rows][:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(taken * float(SCALE))
        fits = (np.abs(whole) <= LARGEST).all(axis=1)
    return rows[fits], whole[fits].astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid and the squared distance to it."""
    n, k = len(vectors), len(centroids)
    v, c = np.ascontiguousarray(vectors[:, order]), centroids[:, order]
    head = np.stack([((v[:, :step] - c[j, :step]) ** 2).sum(axis=1) for j in range(k)], axis=1) if n else np.zeros((0, k), np.int64)
    lead = head.argmin(axis=1) if n else np.zeros(0, np.int64)
    best = head[np.arange(n), lead] + ((v[:, step:] - c[lead, step:]) ** 2).sum(axis=1)
    number = lead.copy()
    for j in range(k):
        alive = np.flatnonzero((lead != j) & (head[:, j] <= best))
        partial = head[alive, j]
        for at in range(step, v.shape[1], step):
            if not len(alive):
                break
            partial = partial + ((v[alive, at : at + step] - c[j, at : at + step]) ** 2).sum(axis=1)
            stay = partial <= best[alive]
            alive, partial = alive[stay], partial[stay]
        wins = (partial < best[alive]) | (j < number[alive])
        alive, partial = alive[wins], partial[wins]
        best[alive], number[alive] = partial, j
    return number, best


def _variance_order(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            _, found = integer_vectors(batch, dims)
            n, one, two = n + len(found), one + found.sum(axis=0), two + (found.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": list(range(dims)), "n": [n] * dims, "one": one, "two": two}, pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("one", pa.float64()), ("two", pa.float64())]))

    summed = vectors.mapInArrow(add, "dim int, n long, one double, two double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).collect()
    spread = {r.dim: r.two / r.n - (r.one / r.n) ** 2 if r.n else 0.0 for r in summed}
    # the order changes how soon centroids are abandoned, never a result
    return np.array(sorted(range(dims), key=lambda d: (-spread.get(d, 0.0), d)))


def _first_centroids(vectors: DataFrame, dims: int, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the least hashes of their ids, in that order."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = integer_vectors(batch, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(list(found), pa.list_(pa.int64()))], names=["vec_id", "whole"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    hashed = vectors.mapInArrow(keep, f"vec_id {kind}, whole array<long>").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    # k rows; equal ids in the order of their components
    return np.array([r.whole for r in hashed.orderBy("h", "whole").limit(k).collect()], np.int64).reshape(-1, dims)


def _round(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> list:
    """(cluster, dim, sum, number, distance) summed over all vectors; k x dims rows."""
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, far = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            _, found = integer_vectors(batch, dims)
            number, distance = nearest(found, centroids, order)
            for j in range(k):
                own = number == j
                n[j] += np.count_nonzero(own)
                sums[j] += found[own].sum(axis=0)
                # in halves, as distances may have 62 bits
                far[j] += (int((distance[own] >> 32).sum()) << 32) + int((distance[own] & 0xFFFFFFFF).sum())
        there = np.flatnonzero(n)
        total = pa.array([str(far[j]) for j in there], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(list(sums[there]), pa.list_(pa.int64())), total], names=["cluster", "n", "sums", "far"])

    parts = vectors.mapInArrow(assign, "cluster int, n long, sums array<long>, far string")
    by_dim = parts.select("cluster", "n", F.col("far").cast("decimal(38,0)").alias("far"), F.posexplode("sums").alias("dim", "s"))
    wide = F.col("s").cast("decimal(38,0)")
    return by_dim.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(wide).alias("s"), F.sum("far").alias("far")).collect()


def _moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    out = centroids.copy()
    for r in sums:
        out[r.cluster, r.dim] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of each kept vector, and (cluster, n, cluster_inertia, inertia, centroid) of each centroid."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = narrow.schema["vec_id"].dataType.simpleString()
    centroids, order = _first_centroids(narrow, dims, k, seed), _variance_order(narrow, dims)
    table = "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), spark.createDataFrame([], table)
    for _ in range(rounds):
        centroids = _moved(centroids, _round(narrow, centroids, order))
    last = {r.cluster: (r.n, int(r.far)) for r in _round(narrow, centroids, order)}
    inertia = sum(far for _, far in last.values())
    rows = [(j, *(x if x < 1 << 63 else None for x in (*last.get(j, (0, 0)), inertia)), c.tolist()) for j, c in enumerate(centroids)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = integer_vectors(batch, dims)
            number, distance = nearest(found, centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return narrow.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), spark.createDataFrame(rows, table)


def centroid_digest(centroid: Column) -> Column:
    return F.sha2(F.concat_ws(",", centroid.cast("array<string>")), 256)


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    facts = centroids.select("cluster", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")).alias("centroid_sha256"))
    # a row for each of the eight centroids
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
