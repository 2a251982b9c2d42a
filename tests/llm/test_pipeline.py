import random
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm import data

import corpus_pipeline
from voxstrata.llm import queries


INNER = "h tk ik win part2 s p start c0 c1 keep set_key2 _d _s _keep".split()


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(300):
        words = data.text(rng, rng.randrange(20, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            words.insert(3, "grubbyfolk")
        rows.append((i, " ".join(words), "en", rng.choice("abc"), 0))
        labels.append((i, 1, int(toxic)))
    item = data.text(rng, 30)
    rows += [(400 + i, rows[1 + i][1] + " end", "en", "a", 0) for i in range(4)]
    rows += [(500, f"{data.text(rng, 20)} {item} {data.text(rng, 20)}", "en", "a", 0), (501, None, "en", "b", None), rows[7]]
    data.frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids = docs.columns, [{r.doc_id for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/out/{k}")
        docs = spark.read.parquet(f"{tmp_path}/out/{k}")
        ids.append({r.doc_id for r in docs.collect()})
    toxic = {i for i in range(300) if i % 5 == 0}
    assert ids[0] - ids[1] == toxic
    assert ids[1] - ids[2] <= {400, 401, 402, 403} and len(ids[1] - ids[2]) >= 3
    assert ids[2] - ids[3] == {500}
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    assert docs.select("shard").distinct().count() > 20


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path):
    data.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"shard", "slot"} <= set(out.columns)


def test_awkward_rows_and_clashing_names(spark, corpus, tmp_path):
    rows = data.awkward(random.Random(33))
    docs = data.clashing(data.frame(spark, rows)).withColumns({c: F.lit("x") for c in INNER})
    spark.read.parquet(f"{corpus}/labels.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/two/labels.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/two/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/two/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/two")
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    texts = {r[1] for r in rows}
    assert got and {r.text for r in got} <= texts and {r.score for r in got} == {7} and all({r[c] for r in got} == {"x"} for c in INNER)


def test_a_brute_force_version(spark, corpus):
    """Stage by stage with plain Python on sets: what the pipeline keeps, up to the sampled mix."""
    import re

    from voxstrata.llm import sharding, toxicity

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{corpus}/labels.parquet"))
    scores = {(r.doc_id, r.text): r.score for r in toxicity.score_documents(docs, model).collect()}
    kept = sorted({(r.doc_id, r.text, r.source) for r in docs.collect() if scores[r.doc_id, r.text] < toxicity.THRESHOLD}, key=lambda r: r[0])
    shingles = {}
    for i, t, _ in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _, _ in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in root:
        for j in root:
            a, b = shingles[i], shingles[j]
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    kept = [r for r in kept if find(r[0]) == r[0]]
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text.split()

    def overlaps(words):
        for shift in range(-len(item) + 13, len(words) - 12):
            same = [k for k in range(len(item)) if 0 <= k + shift < len(words) and words[k + shift] == item[k]]
            if any(b - a + 1 >= 13 and y - x + 1 >= 0.8 * (b - a + 1) for x, a in enumerate(same) for y, b in enumerate(same) if b >= a):
                return True
        return False

    kept = [r for r in kept if not overlaps((r[1] or "").split())]
    out = corpus_pipeline.run(spark, corpus)
    got = out.collect()
    assert {r.doc_id for r in got} <= {i for i, _, _ in kept}
    # the mix: each source's words come near its target, none more than three times
    size = lambda t: len((t or "").split())
    total, order = sum(size(t) for _, t, _ in kept), sorted({s for _, _, s in kept})
    for k, source in enumerate(order):
        own = sum(size(t) for _, t, s in kept if s == source)
        target = min(3 * own, total * (1 + k % 3) / sum(1 + j % 3 for j in range(len(order))))
        assert abs(sum(size(r.text) for r in got if r.source == source) - target) <= max(0.02 * target, 40)
    expected = {r.doc_id: r.s for r in out.select("doc_id", sharding.rendezvous([F.col("doc_id")], [1.0] * 40).alias("s")).collect()}
    assert all(r.shard == expected[r.doc_id] for r in got)


def test_names(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(queries.queries()) <= set(found) and found["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
