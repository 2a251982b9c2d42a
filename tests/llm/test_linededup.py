import random
import re

from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import linededup

INNER = "did th seq pos h w total upto before after a b v fp spans run origin opens first last lines runs found _h _lines _runs _did c0 c1".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines(rng, n):
    return [data.text(rng, rng.randrange(1, 25)) for _ in range(n)]


def corpus(rng):
    shared = [lines(rng, k) for k in (1, 3, 6, 12)] + [[data.text(rng, 70)]]
    docs = []
    for _ in range(60):
        own = lines(rng, rng.randrange(1, 12))
        if rng.random() < 0.7:
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(shared) + ([""] if rng.random() < 0.3 else [])
        docs.append("\n".join(own))
    docs += [docs[0], docs[1], docs[0] + "\n" + docs[0], None, "", "\n\n", "x\r\n y \n", "\n".join(shared[3]).replace("\n", " \n  ")]
    return docs


def brute(rows, least=50):
    """rows(doc_id, text, th) to kept texts, by (doc_id, th): for each line and each earlier equal one, the common run around both."""
    order = lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or 0)
    seqs = {}
    for i, t, th in rows:
        split = (t or "").split("\n")
        seqs[i, th] = (split, [(p, x.strip(" \t\r\v\f"), len(WORD.findall(x))) for p, x in enumerate(split) if WORD.search(x)])
    spots = {}
    for place in sorted(seqs, key=order):
        for k, (_, line, _) in enumerate(seqs[place][1]):
            spots.setdefault(line, []).append((place, k))
    out = {}
    for place, (split, seq) in seqs.items():
        gone = set()
        for k, (_, line, _) in enumerate(seq):
            for other, j in spots[line]:
                if (order(other), j) >= (order(place), k):
                    break
                theirs, lo, hi = seqs[other][1], 0, 0
                # the earlier run must not hold line k itself
                most = k - j - 1 if other == place else len(seq)
                while lo < min(j, k) and seq[k - lo - 1][1] == theirs[j - lo - 1][1]:
                    lo += 1
                while hi < most and k + hi + 1 < len(seq) and j + hi + 1 < len(theirs) and seq[k + hi + 1][1] == theirs[j + hi + 1][1]:
                    hi += 1
                if sum(x[2] for x in seq[k - lo : k + hi + 1]) >= least:
                    gone.add(k)
                    break
        # blank lines between two deleted ones go too
        dead = {p for k in gone for p in range(seq[k][0], seq[k + 1][0] if k + 1 in gone else seq[k][0] + 1)}
        out[place] = ("\n".join(x for p, x in enumerate(split) if p not in dead), len(dead))
    return out


def compare(spark, rows):
    df = data.clashing(data.frame(spark, rows)).withColumns({c: F.lit("x") for c in INNER})
    got = linededup.dedup_lines(df).withColumn("orig", F.lit(0)).collect()
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    expected = brute([(r.doc_id, r.text, r.th) for r in keyed])
    assert len(got) == len(rows)
    assert {c for r in got for c in INNER if r[c] != "x"} == set()
    texts = sorted(((r.doc_id, r.text or "", r.n_removed) for r in got), key=str)
    assert texts == sorted(((r.doc_id, *expected[r.doc_id, r.th]) for r in keyed), key=str)
    return got


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(random.Random(seed))
        got = compare(spark, [(i, t, "en", "a", 0) for i, t in enumerate(docs)])
        assert sum(r.n_removed for r in got) > 50


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    t = "\n".join(lines(rng, 10))
    rows = [(5, t, "en", "a", 0)] * 3 + [(None, t, "en", "a", 0), (7, t, "en", "a", 0), (5, t + "\nmore", "en", "a", 0)]
    got = compare(spark, rows)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert {r.n_removed for r in got if r.doc_id == 7} == {10}


def test_a_passage_in_one_line(spark):
    rng = random.Random(4)
    passage = data.text(rng, 55)
    rows = [(i, f"{data.text(rng, 5)}\n{passage}\n{data.text(rng, 5)}", "en", "a", 0) for i in range(5)]
    got = compare(spark, rows)
    assert sorted(r.n_removed for r in got) == [0, 1, 1, 1, 1]


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = "\n".join(lines(rng, 3000))
    compare(spark, [(1, long, "en", "a", 0), (2, long, "en", "a", 0)])
    assert linededup.dedup_lines(data.empty(spark)).count() == 0


def test_a_passage_that_overlaps_with_itself(spark):
    rng = random.Random(6)
    five, other = data.text(rng, 5), data.text(rng, 7)
    texts = ["\n".join([five] * 200), "\n".join([five] * 12), "\n\n".join([five] * 40), "\n".join([other, five, ""] * 30), "\n".join([five, other] * 9 + ["own words here"] + [five, other] * 9)]
    for t in texts:
        got = compare(spark, [(1, t, "en", "a", 0)])
        assert len(WORD.findall(got[0].text)) >= 50, got[0].n_removed
    compare(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    got = compare(spark, [(1, texts[0], "en", "a", 0)])
    assert (got[0].n_lines, got[0].n_removed) == (200, 190)


def test_a_document_in_itself_and_in_others(spark):
    rng = random.Random(7)
    part, tail = lines(rng, 9), lines(rng, 3)
    texts = ["\n".join(part + ["between"] + part), "\n".join(part), "\n".join(["x", *part[2:], *tail]), "\n".join(["y", *part[3:], *tail]), "\n".join(part[::-1])]
    got = compare(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    assert {r.doc_id: r.n_removed for r in got}[0] == 9


def test_the_longest_of_several_earlier_runs_counts(spark):
    """The first occurrence of a window may lack the lines that a later one shares."""
    rng = random.Random(8)
    long, short = data.text(rng, 49), [data.text(rng, 1) + str(i) for i in range(4)]
    texts = [[long, short[0], "z"], [long, *short], [long, *short], [short[3], long, short[0]]]
    got = compare(spark, [(i, "\n".join(t), "en", "a", 0) for i, t in enumerate(texts)])
    assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)] == [0, 2, 5, 2]
