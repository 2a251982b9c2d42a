import random
import re

from tests.llm import data

from voxstrata.llm import ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_components(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = data.awkward(random.Random(1))
    assert got(data.clashing(data.frame(spark, rows))) == brute(rows)


def test_near_copies_of_one_text_in_several_steps(spark):
    rng = random.Random(2)
    chain = [data.text(rng, 60)]
    for _ in range(30):  # each links with its neighbours only
        chain.append(data.near(rng, chain[-1], 1))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(chain)] + [(100 + i, data.text(rng, 60), "en", "a", 0) for i in range(20)]
    assert got(data.frame(spark, rows)) == brute(rows)


def test_passages_shared_by_many_documents(spark):
    rng = random.Random(3)
    passage = data.text(rng, 60)
    rows = [(i, passage + " " + data.text(rng, rng.randrange(2, 50)), "en", "a", 0) for i in range(80)]
    assert got(data.frame(spark, rows)) == brute(rows)


def test_links_of_every_document(spark):
    rng = random.Random(5)
    base = data.text(rng, 60)
    rows = data.awkward(rng) + [(200 + i, data.near(rng, base, i % 5), "en", "a", 0) for i in range(60)]
    sets = [shingles(r[1]) for r in rows]
    linked = [[bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets]
    expected = sorted(((r[0], sum(linked[i]) - linked[i][i]) for i, r in enumerate(rows)), key=str)
    df = data.clashing(data.frame(spark, rows))
    for block in (ngram_join.BLOCK, 7):
        found = ngram_join.near_duplicate_components(df, count_links=True, block=block).collect()
        assert sorted(((r.doc_id, r.n_links) for r in found), key=str) == expected
        pairs = [tuple(r) for r in ngram_join.linked_class_pairs(df, block=block).collect()]
        classes = {frozenset(s) for s in sets if s}
        assert len(pairs) == len(set(pairs)) == sum(100 * len(a & b) >= 75 * len(a | b) for a in classes for b in classes if a != b) // 2
    assert max(n for _, n in expected) > 7 + 1
    assert ngram_join.near_duplicate_components(data.empty(spark), count_links=True).count() == 0


def test_empty_table(spark):
    assert got(data.empty(spark)) == []


def test_one_of_each_stays(spark):
    rows = data.awkward(random.Random(4))
    df = data.clashing(data.frame(spark, rows))
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    found = brute(rows)
    assert set(ids) == {c for i, n, c in found if n} | {i for i, n, _ in found if not n}
    assert all(ids.count(i) == 1 for i, n, c in found if n and i == c)


def test_prefix_has_the_rarest_shingles():
    import numpy as np

    s = np.sort(np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64))
    ranks = np.zeros(ngram_join.SKETCH, np.uint16)
    ranks[(s[:10] & np.uint64(ngram_join.SKETCH - 1)).astype(int)] = 9
    first = ngram_join.prefix(s, ranks)
    assert len(first) == 40 - 30 + 1 and not set(first.tolist()) & set(s[:10].tolist())
