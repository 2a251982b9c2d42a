import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import sharding


def test_facts_slots_and_growth(spark):
    rng = random.Random(11)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate([None, "", "é漢😀", *(data.text(rng, 5) for _ in range(500))])] + [(7, "again", "en", "a", 0)] * 30 + [(None, "x", "en", "a", 0)] * 5
    inner = "win part n s p start c0 c1 _rdv_part _rdv_start slot grown_shard law text_crc32".split()
    df = data.clashing(data.frame(spark, rows)).withColumns({c: F.lit("x") for c in inner})
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        assert {r[c] for c in inner[:10]} == {"x"}
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    moved = sum(r.grown_shard == 8 for r in got)
    assert 0.04 < moved / len(got) < 0.2


def test_the_grown_shard_is_the_shard_of_one_more(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    now = {r.doc_id: r.grown_shard for r in sharding.shard_documents(df, 5).collect()}
    assert now == {r.doc_id: r.shard for r in sharding.shard_documents(df, 6).collect()}


def test_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), sharding.rendezvous([F.col("id")], [1, 2, 0, 3]).alias("s"))
    n = Counter(r.s for r in df.collect())
    assert n[2] == 0 and [n[s] / 1000 for s in (0, 1, 3)] == pytest.approx([1, 2, 3], rel=0.1)
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("id")], [0.0])


def test_empty_table(spark):
    assert sharding.shard_documents(data.empty(spark)).count() == 0


def test_against_scores_of_every_shard(spark):
    """Each key's winner by scores worked out one by one, from hashes that Spark gives for (seed, shard, key)."""
    import math

    weights = [1.0, 0.5, 0.0, 3.0, 2.0]
    df = spark.range(400).select(F.when(F.col("id") != 7, F.col("id")).alias("k"))
    got = {r.k: (r.shard, r.grown_shard) for r in sharding.shard_records(df, ["k"], weights, grow=1.5).collect()}
    hashes = {r.k: r.h for r in df.select("k", F.array(*[F.xxhash64(F.lit(sharding.SEED), F.lit(s), "k") for s in range(6)]).alias("h")).collect()}
    for k, h in hashes.items():
        scores = [-w / math.log((((x % 2**64) >> 12) + 0.5) / 2**52) if w else 0.0 for x, w in zip(h, [*weights, 1.5], strict=True)]
        assert got[k] == (scores.index(max(scores[:5])), scores.index(max(scores)))


def test_very_long_texts(spark):
    texts = ["x" * 3_000_000, "\u00e9 " * 1_000_000]
    got = {r.doc_id: r for r in sharding.shard_documents(data.frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]), 3).collect()}
    assert all(got[i]["size"] == len(t.encode()) + 16 and got[i].text_crc32 == zlib.crc32(t.encode()) for i, t in enumerate(texts))
