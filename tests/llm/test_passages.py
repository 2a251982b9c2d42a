import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import passages
from voxstrata.plans.durable import DurableTable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=51):
    """rows(doc_id, text, th) to (kept words, removed), by (doc_id, th)."""
    docs = {(i, th): WORD.findall(t or "") for i, t, th in rows}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or 0)
    seen, out = set(), {}
    for p in sorted(docs, key=order):
        words, dead = docs[p], set()
        for a in range(len(words) - n + 1):
            key = tuple(words[a : a + n])
            if key in seen:
                dead.update(range(a, a + n))
            seen.add(key)
        out[p] = ([w for k, w in enumerate(words) if k not in dead], len(dead))
    return out


def compare(spark, texts):
    df = data.clashing(data.frame(spark, [(i, t, "en", "a", 0) for i, t in texts]))
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    expected = brute([(r.doc_id, r.text, r.th) for r in keyed])
    got = passages.dedup_passages(df).collect()
    assert sorted(((r.doc_id, WORD.findall(r.text or ""), r.n_removed) for r in got), key=str) == sorted(((r.doc_id, *expected[r.doc_id, r.th]) for r in keyed), key=str)
    return got


def test_passages_that_start_and_end_inside_lines(spark):
    rng = random.Random(6)
    passage = data.text(rng, 60)
    wrapped = re.sub(r"((?:\S+ ){9})", r"\1\n", passage)
    texts = [(i, f"{data.text(rng, 7)} {p} {data.text(rng, 9)}") for i, p in enumerate([passage, passage, wrapped, " ".join(passage.split()[:51]), " ".join(passage.split()[:50])])]
    got = compare(spark, texts)
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 60, 2: 60, 3: 51, 4: 0}


def test_against_brute_force(spark):
    rng = random.Random(7)
    shared = [data.text(rng, n) for n in (30, 51, 80, 200)]
    texts = [(i, f"{data.text(rng, rng.randrange(0, 40))}\n {rng.choice(shared)} {data.text(rng, rng.randrange(0, 30))} {rng.choice(shared)}") for i in range(60)]
    texts += [texts[0], (None, texts[1][1]), (7, texts[2][1]), (90, None), (91, ""), (92, " \n ")]
    assert sum(r.n_removed for r in compare(spark, texts)) > 500
    assert passages.dedup_passages(data.empty(spark)).count() == 0


def test_few_windows_become_rows(spark, monkeypatch):
    """Rows of all tables that are written, where one passage in 30 documents repeats."""
    rng, rows, init = random.Random(8), [], DurableTable.__init__

    def counted(self, df, tag):
        init(self, df, tag)
        rows.append(self.df.count())

    monkeypatch.setattr(DurableTable, "__init__", counted)
    passage = data.text(rng, 60)
    texts = [(i, f"{data.text(rng, 500)} x{i} {passage} y{i} {data.text(rng, 500)}", "en", "a", 0) for i in range(30)]
    got = passages.dedup_passages(data.frame(spark, texts)).agg(F.sum("n_words"), F.sum("n_removed")).first()
    assert tuple(got) == (30 * 1062, 29 * 60) and sum(rows) < 30 * 1062 / 4


def test_repeated_words_and_edges_of_copies(spark):
    rng = random.Random(9)
    base = data.text(rng, 700)
    texts = [(i, data.near(rng, base, i % 9)) for i in range(24)]
    texts += [(30, "a " * 300), (31, "a " * 52 + base), (32, "a b " * 90), (33, "a " * 51), (34, "a " * 50), (35, " ".join(base.split()[100:160] * 5)), (36, f"\t{base}\u3000é\n")]
    compare(spark, [*texts, (None, base), (40, base), (40, base), (41, "A " * 300)])


@pytest.mark.parametrize("min_words", [1, 3, 8, 9, 51])
def test_stretches_hold_each_window_once(min_words):
    rng = np.random.default_rng(min_words)
    lengths = [0, 200, min_words - 1, min_words, 0, 0, 130, 0]
    rows = np.cumsum([0, *lengths])
    words = rng.integers(0, 3, rows[-1]).astype(np.uint64) + np.uint64(5)
    lo, hi, anchors = passages.stretches(words, rows, min_words)
    found = [i for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)]
    assert found == [i for a, b in zip(rows[:-1], rows[1:], strict=True) for i in range(a, b - min_words + 1)]
    # equal windows have equal anchors
    of = {}
    for a, b, f in zip(lo, hi, anchors, strict=True):
        for i in range(a, b + 1):
            assert of.setdefault(words[i : i + min_words].tobytes(), f) == f
