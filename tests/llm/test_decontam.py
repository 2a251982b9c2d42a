import random

from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import decontam

BENCH = "item_id long, text string"


def found(docs, bench, **options):
    return {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs, bench, **options).collect()}


def plant(rng, item, every):
    words = item.split()
    return " ".join(w if every == 0 or (i + 2) % every else f"sub{i}" for i, w in enumerate(words))


def test_planted_passages(spark):
    rng = random.Random(12)
    items = [(i, data.text(rng, n)) for i, n in enumerate([15, 15, 20, 38, 60, 60, 16, 30])]
    docs, expected = [], set()
    for k in range(60):
        i, item = rng.choice(items)
        every = rng.choice([0, 7, 10])
        body = plant(rng, item, every) if k % 3 else None
        text = data.text(rng, 40) + (f" {body.upper()}!! " if body else " ") + data.text(rng, 40)
        docs.append((k, text, "en", "a", 0))
        if body:
            expected.add((k, i))
    df = data.clashing(data.frame(spark, docs))
    bench = spark.createDataFrame(items, BENCH)
    assert found(df, bench) == expected
    assert found(df, bench, block_words=20) == expected
    clean = decontam.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {d for d, _ in expected}


def test_part_of_a_long_item_counts_from_thirteen_words(spark):
    rng = random.Random(13)
    item = [f"q{i}" for i in range(60)]
    docs = [(n, data.text(rng, 20) + " " + " ".join(item[10 : 10 + n]) + " " + data.text(rng, 20), "en", "a", 0) for n in (8, 12, 13, 30)]
    assert found(data.frame(spark, docs), spark.createDataFrame([(1, " ".join(item))], BENCH)) == {(13, 1), (30, 1)}


def test_masks_hit_every_pattern_within_the_tolerance():
    from itertools import combinations

    for n in range(13, 21):
        spots = [sum(1 << (at + m) for m in mask) for mask in decontam.MASKS for at in range(n - mask[-1])]
        for k in range(n // 5 + 1):
            for places in combinations(range(1, n - 1), k):
                gone = sum(1 << p for p in places)
                assert any(not spot & gone for spot in spots), (n, places)


def test_each_fourth_word_replaced(spark):
    item = [f"q{i}" for i in range(15)]
    copy = ["sub" if i % 4 == 3 else w for i, w in enumerate(item)]
    docs = data.frame(spark, [(1, "x y " + " ".join(copy) + " z", "en", "a", 0)])
    assert found(docs, spark.createDataFrame([(9, " ".join(item))], BENCH)) == {(1, 9)}


def test_awkward_rows(spark):
    rows = data.awkward(random.Random(14))
    items = [(1, rows[3][1]), (1, rows[3][1]), (2, None), (3, ""), (4, "one two three four"), (None, rows[5][1])]
    got = decontam.find_overlaps(data.frame(spark, rows), spark.createDataFrame(items, BENCH)).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    same = [r[0] for r in rows if r[1] == rows[3][1]]
    assert sorted((d for d, i in pairs if i == 1), key=str) == sorted(same * 2, key=str)
    assert {d for d, i in pairs if i == 4} == {r[0] for r in rows if r[1] == "one two three four"}
    assert {d for d, i in pairs if i is None} >= {5}


def test_stretches_are_counted(spark):
    text = " ".join(f"a{i}" for i in range(20))
    docs = data.frame(spark, [(1, "x y " + text.replace("a10", "zz"), "en", "a", 0)])
    r = decontam.find_overlaps(docs, spark.createDataFrame([(9, text)], BENCH)).first()
    assert (r.doc_word, r.item_word, r.n_words, r.n_matches) == (2, 0, 20, 19)


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCH)
    docs = data.frame(spark, data.awkward(random.Random(15)))
    assert found(docs, none) == set() and found(data.empty(spark), none) == set()
    assert decontam.drop_contaminated(docs, none).count() == docs.count()
    assert found(docs.select(F.col("doc_id"), F.lit(None).cast("string").alias("text")), spark.createDataFrame([(1, "a b c d e f g")], BENCH)) == set()


def test_repetitive_texts_stay_bounded():
    import time
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    for item, doc in ((["a"] * 1000, ["a"] * 20_000), (["a", "b", "c"] * 400, ["b", "c", "a"] * 6600), ([str(x) for x in rng.integers(0, 2, 800)], [str(x) for x in rng.integers(0, 2, 20_000)])):
        table = decontam.SeedTable([7], [" ".join(item)])
        raw = np.frombuffer(" ".join(doc).encode(), np.uint8)
        tracemalloc.start()
        began = time.time()
        found = list(table.overlaps(*decontam.word_hashes(raw, np.array([0, len(raw)]), letters_only=True)))
        took, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert len(found) == 1 and took < 30 and peak < 500e6, (took, peak)


def test_distances():
    import numpy as np

    rng = random.Random(31)
    for n, m in ((3, 4), (300, 500), (2000, 40)):
        p, q = (np.array(sorted(rng.sample(range(4000), k))) for k in (n, m))
        assert decontam.distances(p, q).tolist() == sorted({a - b for a in p.tolist() for b in q.tolist()})


def test_the_join_finds_what_the_broadcast_finds(spark):
    rng = random.Random(32)
    rows = data.awkward(rng)
    items = [(1, rows[3][1]), (1, rows[3][1]), (2, None), (3, ""), (4, "one two three four"), (None, rows[5][1]), (6, "one"), (7, "w1 w2 " * 40)]
    items += [(10 + k, plant(rng, rows[10 + k][1], 6)) for k in range(6)]
    rows += [(900, "w1 w2 " * 300, "en", "a", 0), (901, "w2 w1 " * 30 + rows[12][1], "en", "a", 0)]
    docs, bench = data.clashing(data.frame(spark, rows)).withColumns({c: F.lit("x") for c in ("tk", "ik", "c0", "places", "shifts")}), spark.createDataFrame(items, BENCH)
    a, b = (sorted(map(tuple, decontam.find_overlaps(docs, bench, **o).collect()), key=str) for o in ({}, {"block_words": 1}))
    assert a == b and len(a) > 20
    kept = [decontam.drop_contaminated(docs, bench, **o) for o in ({}, {"block_words": 1})]
    assert kept[0].columns == kept[1].columns == docs.columns
    assert [sorted(map(tuple, k.collect()), key=str) for k in kept][0] == sorted(map(tuple, kept[1].collect()), key=str)
    assert kept[0].count() < docs.count()
