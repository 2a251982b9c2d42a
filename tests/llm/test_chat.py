import hashlib
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxstrata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(df):
    out = chat.format_conversations(df)
    read = out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in read.collect()}


def check(spark, rows):
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    by_conv = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == [x for r, x in turns if r == "assistant"]


PIECES = [*chat.CONTROLS, "\\", "<\\s>", "[\\\\INST]", "<", "[", "]", ">", "/", "é", "漢", "😀", "\n", " ", "ok", "s>", "INST]"]
TEXTS = st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "system", "tool[:]", "</s>", None]), TEXTS), min_size=1, max_size=40))
def test_round_trip(spark, rows):
    check(spark, rows)


def test_same_roles_are_merged_and_nulls_kept(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, 3, "assistant", ""), (None, None, None, None), (None, 0, "user", "x"), (1, 0, "user", "a")]
    check(spark, rows)
    got = read_back(spark.createDataFrame(rows, SCHEMA))[1]
    assert got.formatted == "<s>[INST] a[NEXT]a[NEXT]</s>[ANS] b[NEXT]</s>"


def test_control_strings_never_stay(spark):
    text = "".join(chat.CONTROLS) * 2
    got = read_back(spark.createDataFrame([(1, 0, "user", text)], SCHEMA))[1]
    inside = got.formatted.removeprefix("<s>[INST] ").removesuffix("</s>")
    assert not any(c in inside for c in chat.CONTROLS)


def test_long_text_and_empty_table(spark):
    check(spark, [(1, 0, "assistant", "</s>é" * 30000)])
    assert read_back(spark.createDataFrame([], SCHEMA)) == {}


def test_query_digest(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op5_chat_formatting(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() + [type("R", (), {"conv_id": -7, "turn": k, "role": role, "text": chat.PROBE}) for k, role in enumerate(("user", "assistant"))]
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.turn):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_many_turns_cost_in_proportion(spark):
    def rows(n):
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s>é "), F.col("id").cast("string")).alias("text"))
        return turns.repartition(4)

    def took(n):
        began = time.monotonic()
        got = read_back(rows(n))[1]
        assert [t.text for t in got.turns] == [f"</s>é {i}" for i in range(n)]
        assert got.loss == [f"</s>é {i}" for i in range(1, n, 2)]
        return time.monotonic() - began

    took(chat.CHUNK + 1)
    assert took(100_000) < 60


def test_many_turns_of_one_role(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.lit("é[NEXT]").alias("text"))
    got = read_back(rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [("tool", "é[NEXT]")] * n and got.loss == []


def test_chunk_ends(spark):
    for n in (1, chat.CHUNK - 1, chat.CHUNK, chat.CHUNK + 1, 2 * chat.CHUNK):
        check(spark, [(1, t, ("user", "assistant", "assistant")[t % 3], f"é{t}") for t in range(n)])
