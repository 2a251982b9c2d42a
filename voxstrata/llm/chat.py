"""Relational chat formatting with reversible escapes and a loss mask.

A conversation is one string::

    <s>[SYS] text</s>[INST] text[NEXT]text</s>[ANS] text</s>

Turns are collected as structs and sorted, adjacent turns of a role are merged
into one block whose texts stand apart by ``[NEXT]``, and the blocks are
concatenated.  A role other than system, user and assistant has the header
``[ROLE]name[:] ``.  A control string inside a text gets a backslash behind its
first character, and one more if it has some already, so that it is never a
control string in the output and the text can be read back exactly.  The loss
mask is a list of (start, length) in code points of assistant texts.
Offsets are running sums inside chunks of turns and over the chunks, so that a
conversation of many turns costs time in proportion to them.  Expressions only.

Defined cases: a null text is empty; a null role is the empty role; turns are
ordered by turn (null first), then role, then text, so ties have one order;
repeated rows are repeated turns; very many turns (100,000 is tested) and very
long texts are one string; a null conv_id is one conversation; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[/ANS]", "[NEXT]", "[ROLE]", "[:]")
_TAILS = r"/?s>|/?INST\]|/?SYS\]|/?ANS\]|NEXT\]|ROLE\]|:\]"
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"
#: Turns whose offsets are added up together; an array that grows is copied at each step.
CHUNK = 512
HEADERS = {"system": "[SYS] ", "user": "[INST] ", "assistant": "[ANS] "}
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def _header(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[:] "))
    for name, header in HEADERS.items():
        out = F.when(role == name, F.lit(header)).otherwise(out)
    return out


def _chunks(values: Column) -> Column:
    """The array in pieces of ``CHUNK``; an empty one is one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
    return F.transform(F.array(values), lambda whole: F.transform(starts, lambda at: F.slice(whole, at + 1, F.lit(CHUNK))))[0]


def _total(lens: Column) -> Column:
    return F.aggregate(lens, F.lit(0).cast("long"), lambda acc, n: acc + n)


def _running(lens: Column, start: Column | int) -> Column:
    """What stands before each entry, from ``start`` on; the array grows by one entry a step."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.aggregate(
        lens,
        F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        lambda acc: acc["starts"],
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start long, length long>>."""
    turns = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    marked = sorted_turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                escape(t["text"]).alias("body"),
                ((i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])).alias("opens"),
                ((i == F.size("turns") - 1) | (F.get(F.col("turns"), i + 1)["role"] != t["role"])).alias("closes"),
            ),
        ).alias("turns"),
    )
    pieces = marked.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.when(t["opens"], _header(t["role"])).otherwise(F.lit("[NEXT]")).alias("lead"),
                t["body"].alias("body"),
                F.when(t["closes"], F.lit("</s>")).otherwise(F.lit("")).alias("tail"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ).alias("p"),
    ).withColumn("lens", F.transform("p", lambda x: (F.length(x["lead"]) + F.length(x["body"]) + F.length(x["tail"])).cast("long")))
    pieces = pieces.withColumn("chunks", _chunks(F.col("lens")))
    pieces = pieces.withColumn("bases", _running(F.transform("chunks", _total), len("<s>")))
    ends = F.flatten(F.zip_with("chunks", "bases", _running))
    return pieces.withColumn("starts", ends).select(
        "conv_id",
        F.concat(F.lit("<s>"), F.array_join(F.transform("p", lambda x: F.concat(x["lead"], x["body"], x["tail"])), "")).alias("formatted"),
        F.transform(
            F.filter(
                F.zip_with("p", "starts", lambda x, s: F.struct(x["loss"].alias("loss"), (s + F.length(x["lead"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))),
                lambda x: x["loss"],
            ),
            lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    blocks = F.filter(F.split(F.substring(formatted, len("<s>") + 1, 2**31 - 1), "</s>"), lambda b: b != "")

    def role(b: Column) -> Column:
        out = unescape(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[:\] ", 1))
        for name, header in HEADERS.items():
            out = F.when(F.startswith(b, F.lit(header)), F.lit(name)).otherwise(out)
        return out

    def body(b: Column) -> Column:
        return F.regexp_replace(b, r"(?s)^(\[SYS\] |\[INST\] |\[ANS\] |\[ROLE\].*?\[:\] )", "")

    # a block's role and texts are worked out once, however many texts it has
    parts = F.transform(blocks, lambda b: F.struct(role(b).alias("role"), F.split(body(b), r"\[NEXT\]").alias("texts")))
    return F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    A substring by code points reads the string from its beginning, so spans are
    read from strips of the string, one for each ``CHUNK`` of spans.
    """

    def cut(text: Column, start: Column, length: Column) -> Column:
        return F.substr(text, (start + 1).cast("int"), length.cast("int"))

    def strip(text: Column, chunk: Column) -> Column:
        first, last = F.get(chunk, F.lit(0))["start"], F.get(chunk, F.size(chunk) - 1)
        return F.struct(chunk.alias("spans"), first.alias("base"), cut(text, first, last["start"] + last["length"] - first).alias("text"))

    strips = F.flatten(F.transform(F.array(formatted), lambda text: F.transform(_chunks(spans), lambda chunk: strip(text, chunk))))
    return F.flatten(F.transform(strips, lambda s: F.transform(s["spans"], lambda p: unescape(cut(s["text"], p["start"] - s["base"], p["length"])))))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    out = format_conversations(rows.unionByName(probe))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
