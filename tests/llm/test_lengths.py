import random
from pathlib import Path

from tests.llm import data

from voxstrata.llm import lengths


def test_histogram_against_lists(spark):
    rows = data.awkward(random.Random(7))
    df = data.clashing(data.frame(spark, rows))
    encoder = lengths._encoder(Path(f"{lengths.TOKENIZER_DIR}/{lengths.VOCABULARY}").read_bytes(), lengths.PATTERN)
    n = [len(encoder.encode_ordinary(r[1] or "")) for r in rows]
    bars = lengths.length_histogram(lengths.token_counts(df)).collect()
    assert sorted(r.n_tokens for r in bars) == sorted(set(n))
    for r in bars:
        limit = r.n_tokens
        assert r.docs == n.count(limit) and r.docs_upto == sum(x <= limit for x in n) and r.docs_over == sum(x > limit for x in n)
        assert r.tokens == sum(n) and r.tokens_upto == sum(x for x in n if x <= limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in n) and r.quantile == sum(x <= limit for x in n) / len(n)


def test_any_limit_and_quantile(spark):
    counts = spark.createDataFrame([(x,) for x in (0, 3, 3, 10, 50)], "n_tokens long")
    bars = lengths.length_histogram(counts)
    assert lengths.truncated_total(bars, 7).first().asDict() == {"truncated_tokens": 20, "docs_over": 2}
    assert [lengths.quantile_length(bars, q).first().n_tokens for q in (0.2, 0.5, 0.8, 1.0)] == [0, 3, 10, 50]


def test_groups_and_empty(spark):
    df = data.frame(spark, [(1, "a b", "en", "x", 0), (2, None, "de", None, 0)])
    got = lengths.length_histogram(lengths.token_counts(df, keep=["source"]), by=["source"])
    assert sorted((r.source or "", r.n_tokens, r.tokens) for r in got.collect()) == [("", 0, 0), ("x", 2, 2)]
    assert lengths.length_histogram(lengths.token_counts(data.empty(spark))).count() == 0


def test_control_strings_are_text(spark):
    df = data.frame(spark, [(1, "<|endoftext|>", "en", "x", 0)])
    assert lengths.token_counts(df).first().n_tokens > 1


def test_long_runs_of_white_space(monkeypatch):
    encoder = lengths._encoder(Path(f"{lengths.TOKENIZER_DIR}/{lengths.VOCABULARY}").read_bytes(), lengths.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", " ", "\n", "\t", "\xa0", "\u3000", " \n\n\n", "       ", "x.", "\x1c"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    plain = [len(encoder.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(lengths, "LONG_RUN", 3)
    monkeypatch.setattr(lengths, "_RUN", lengths.regex.compile(r"\p{White_Space}{3,}"))
    assert [lengths.count_tokens(encoder, t) for t in texts] == plain


def test_ten_million_characters(spark):
    n = 10_000_000
    df = data.frame(spark, [(1, "\n" * n, "en", "x", 0), (2, " " * n + "word", "en", "x", 0), (3, "a" * n, "en", "x", 0), (4, "word " * 1_000_000, "en", "x", 0)])
    got = {r.doc_id: r.n_tokens for r in lengths.token_counts(df, keep=["doc_id"]).collect()}
    # two line breaks are a token; each space is one, the last goes with the word
    assert got[1] == n // 2 and got[2] == n and got[4] == 1_000_001 and 0 < got[3] <= n


def test_kept_columns_of_any_name(spark):
    df = data.clashing(data.frame(spark, [(1, "a b", "en", "x", 0)])).withColumnRenamed("n", "c0")
    got = lengths.token_counts(df, keep=["_text", "c0", "_text"])
    assert got.columns == ["_text", "c0", "_text", "n_tokens"] and tuple(got.first()) == ("t", 1, "t", 2)
