import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxstrata.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10):
    """Whole distances, with Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), w) for i, w in kept)
    c = [w for _, w in hashed[:k]]

    def assign():
        w, m = np.array([v for _, v in kept], object), np.array(c, object)
        d = ((w[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
        return [min((x, j) for j, x in enumerate(r)) for r in d.tolist()]

    for _ in range(rounds if kept else 0):
        found = [j for _, j in assign()]
        for j in range(len(c)):
            own = [w for (_, w), f in zip(kept, found, strict=True) if f == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)] if kept else [], c


def table(seed, n=500):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64)) * np.linspace(0.01, 2, 64)
    rows = [(i, (middles[i % 5] + rng.normal(size=64) * 0.3).astype(np.float32).tolist(), i % 3) for i in range(n)]
    v = rows[0][1]
    rows += [(5000 + i, v, None) for i in range(40)] + [rows[1]] * 3 + [(None, rows[2][1], 1), (1, rows[3][1], 1)]
    return rows + [(6000, None, 1), (6001, v[:63], 1), (6002, [*v, 1.0], 1), (6003, [None, *v[1:]], 1), (6004, [float("nan"), *v[1:]], 1), (6005, [float("-inf"), *v[1:]], 1), (6006, [3e38, *v[1:]], 1), (6007, [], 1), (6008, [0.0] * 64, 1)]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit(1), "distance": F.lit("d")}).repartition(3)
    assigned, found = centroids.cluster(df)
    expected, middles = brute(rows)
    assert sorted(map(tuple, assigned.collect()), key=str) == sorted(expected, key=str)
    facts = found.orderBy("cluster").collect()
    assert [list(r.centroid) for r in facts] == middles
    sizes, far = Counter(j for _, j, _ in expected), Counter()
    for _, j, d in expected:
        far[j] += d
    assert [(r.n, r.cluster_inertia, r.inertia) for r in facts] == [(sizes[r.cluster], far[r.cluster], sum(far.values())) for r in facts]


def test_against_whole_distances(spark):
    check(spark, table(1))


def test_few_vectors_and_copies(spark):
    rows = table(2)
    check(spark, rows[:5])
    check(spark, [(i, rows[0][1], 1) for i in range(30)])
    check(spark, [])
    assert centroids.op13_centroid_clustering.__name__ == "op13_centroid_clustering"


def test_partial_distances_keep_ties():
    rng = np.random.default_rng(4)
    for step in (1, 8, 64):
        v, c = rng.integers(-3, 4, size=(400, 64)), rng.integers(-3, 4, size=(8, 64))
        c[5], c[7] = c[2], c[0]
        v[:50] = c[rng.integers(0, 8, 50)]
        number, distance = centroids.nearest(v, c, np.argsort(-v.var(axis=0)), step)
        whole = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_digest(spark):
    row = spark.createDataFrame([([1, -2, 30],)], "c array<long>").select(centroids.centroid_digest(F.col("c")).alias("h")).first()
    assert row.h == hashlib.sha256(b"1,-2,30").hexdigest()
