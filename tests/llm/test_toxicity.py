import random

import numpy as np
from tests.llm import data

from voxstrata.llm import toxicity
from voxstrata.llm.textkernel import text_chunks


def corpus(rng, n=1500):
    """An insult is toxic only beside a group's name."""
    rows, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = data.text(rng, rng.randrange(10, 40)).split()
        if insult:
            words.insert(rng.randrange(len(words)), "grubby")
        if group:
            words.insert(rng.randrange(len(words)), "folkers")
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_interactions_are_learned(spark):
    rows, labels = corpus(random.Random(8))
    docs = data.frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held]) > 0.97


def test_pairs_whose_terms_tell_nothing_alone(spark):
    """Toxic is exactly one of two words; neither word says anything by itself."""
    rng = random.Random(18)
    rows, truth = [], {}
    for i in range(3000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = data.text(rng, rng.randrange(10, 60)).split() + ["grubby"] * one + ["folkers"] * two
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "a", 0))
        truth[i] = int(one != two)
    docs = data.frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, t) for i, t in truth.items()], LABELS))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held]) > 0.95
    assert len(model.terms) < 100


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(random.Random(9), 400)
    docs = data.frame(spark, rows)
    import zlib

    changed = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, changed))
    assert (a.terms == b.terms).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_awkward_rows(spark):
    rows = data.awkward(random.Random(10))
    docs = data.clashing(data.frame(spark, rows))
    labels = spark.createDataFrame([(i, 1, i % 2 if i % 5 else None) for i in range(60)] + [(None, 1, 1), (2, 1, 1)], LABELS)
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model)
    scores = got.collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score"]
    blank = {r.score for r in scores if not (r.text or "").strip()}
    assert len(blank) == 1


def test_contradictory_labels_of_equal_texts(spark):
    """Whatever order the rows come in, the largest label counts."""
    rng = random.Random(14)
    rows, labels = corpus(rng, 300)
    rows = [(i, t, *r) for i, t, *r in rows] + [(1000 + i, t, *r) for i, t, *r in rows]
    marks = [(i, q, t) for i, q, t in labels] + [(1000 + i, q, 0) for i, q, t in labels]
    once = [(i, q, t) for i, q, t in labels]
    import zlib

    both = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(1000 + i).encode()) % 3 != 1}
    keep = [m for m in marks if m[0] % 1000 in both]
    models = [toxicity.train(data.frame(spark, r).repartition(n), spark.createDataFrame(x, LABELS)) for r, x, n in ((rows, keep, 1), (rows[::-1], keep[::-1], 7), (rows, [m for m in once if m[0] in both], 3))]
    assert all((m.terms == models[0].terms).all() and (m.weights == models[0].weights).all() for m in models)


def test_all_telling_terms_are_kept(spark):
    """No number of terms is a cut: each of 3,000 words marks a few toxic rows."""
    rows = [(i, " ".join([f"bad{(i * 7 + j) % 3000}x" for j in range(40)] if i % 2 else [f"ok{(i * 7 + j) % 3000}x" for j in range(40)]), "en", "a", 0) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3000)], LABELS)
    model = toxicity.train(data.frame(spark, rows), labels)
    assert len(model.terms) > 4000


def test_scores_against_brute_force(spark):
    """The query's scores from plain Python: terms as sets, pairs one by one."""
    import math
    import re

    rows, labels = corpus(random.Random(15), 300)
    docs = data.frame(spark, rows + [(900, None, "en", "a", 0), (901, "Grubby grubby! folkersfolk \u00e9t\u00e9", "en", "a", 0)])
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    place = {int(t): i for i, t in enumerate(model.terms)}
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for doc, text in [(r.doc_id, r.text) for r in docs.collect()][::7] + [(900, None), (901, rows and "Grubby grubby! folkersfolk \u00e9t\u00e9")]:
        terms = set()
        for word in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
            raw = np.frombuffer(word.encode(), np.uint8)
            terms |= set(toxicity.text_terms(raw, np.array([0, len(raw)]))[1].tolist())
        at = sorted(place[t] for t in terms if t in place)
        z = model.bias + sum(model.weights[i] for i in at) + sum(model.factors[i] @ model.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert math.isclose(got[doc], 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-12)


def test_no_labels_and_no_documents(spark):
    docs = data.frame(spark, [(1, "a b", "en", "x", 0)])
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score_documents(docs, toxicity.train(docs, none)).first().score == 0.5
    one = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert 0.5 < toxicity.score_documents(docs, toxicity.train(docs, one)).first().score < 1
    assert toxicity.score_documents(data.empty(spark), toxicity.train(data.empty(spark), none)).count() == 0


def test_logits_equal_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.sort(rng.integers(0, 2**63, 6).astype(np.uint64)), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    at = np.array([0, 2, 5])
    pairs = sum(m.factors[i] @ m.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert np.isclose(m.logits(np.zeros(3, int), at, 1)[0], 0.3 + m.weights[at].sum() + pairs)


def test_terms_do_not_depend_on_the_chunk():
    import pyarrow as pa

    texts = pa.array(["Idiots here", "", None, "vequée IDIOTS"])
    every = [set(zip(*(x.tolist() for x in toxicity.text_terms(d, o)), strict=True)) for _, _, d, o in text_chunks(texts)][0]
    parts = {(a + r, h) for a, _, d, o in text_chunks(texts, 1) for r, h in zip(*(x.tolist() for x in toxicity.text_terms(d, o)), strict=True)}
    assert every == parts
    assert {h for r, h in every if r == 0} & {h for r, h in every if r == 3}
