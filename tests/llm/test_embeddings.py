import numpy as np

from voxstrata.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


def sample(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    base = rng.normal(size=dim)
    rows += [(1000 + i, (base + rng.normal(size=dim) * 0.1).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [rows[1]] * 3
    v = rows[2][1]
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [float("nan"), *v[1:]], 1), (3003, [float("inf"), *v[1:]], 1), (3004, [None, *v[1:]], 1), (3005, v, None), (3006, v[:8], 1), (3007, [], 1), (3008, [x * 3e30 for x in v], rows[2][2]), (None, v, rows[2][2])]
    return rows


def got(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, **options).collect()), key=str)


def test_against_brute_force(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS cls", "3 AS pivots", "4 AS members", "5 AS block")
    out = embeddings.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert got(df) == brute(rows)


def test_blocks_give_the_same(spark):
    rows = sample(2, 150)
    assert got(spark.createDataFrame(rows, SCHEMA), block=16) == brute(rows)


def test_long_lists_are_cut_by_more_pivots(spark):
    rows = sample(4, 150)
    expected = brute(rows)
    for split in (2, 40):
        assert got(spark.createDataFrame(rows, SCHEMA), split=split) == expected
    assert got(spark.createDataFrame(rows, SCHEMA), split=20, block=8) == expected


def test_recall_on_random_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    near = base + rng.normal(size=base.shape) * 0.12
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))]
    expected, found = sum(r[1] for r in brute(rows)), sum(r[1] for r in got(spark.createDataFrame(rows, SCHEMA)))
    assert expected > 300 and 0.97 * expected <= found <= expected


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
