"""Weighted rendezvous sharding of records by a stable key.

Every (record key, shard) pair has a hash; a record goes to the shard with the
largest ``-weight / ln(hash)``.  A shard that is added takes records only into
itself, a shard that is removed gives only its own away, and no other record
moves.  Expressions only: no Python runs on the executors.

Defined cases: a null key is a key of its own; equal keys share a shard;
a null text has 0 bytes and CRC 0; very long texts are read whole; an empty
table gives an empty result; columns of the input are taken by place and kept
whatever their names, but those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 8_140_221
#: Parts that a shard's rows are numbered in, so that no task sorts a whole shard.
SLOT_PARTS = 256


def score(key: Sequence[Column], shard: int, weight: float, seed: int = SEED) -> Column:
    """-weight / ln(u) for the hash u of key and shard, in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), *key), 12).cast("double")
    unit = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.log(unit)


def winner(key: Sequence[Column], weights: Sequence[float], seed: int = SEED) -> Column:
    """struct<s, k> of the largest score and the shard's number, negated so that the least wins a tie."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    scores = [F.struct(score(key, shard, weight, seed).alias("s"), F.lit(-shard).alias("k")) for shard, weight in enumerate(weights) if weight > 0]
    return F.array_max(F.array(*scores))


def rendezvous(key: Sequence[Column], weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard (0 .. len(weights) - 1) of a key; weights are relative and >= 0."""
    return (-winner(key, weights, seed)["k"]).cast("int")


def shard_records(
    df: DataFrame,
    key: Sequence[str],
    weights: Sequence[float],
    *,
    spread: Sequence[str] = (),
    grow: float | None = None,
    slot_parts: int = SLOT_PARTS,
    seed: int = SEED,
) -> DataFrame:
    """df with ``shard`` and ``slot``; slots of a shard run from 0 without gaps.

    With ``grow`` also ``grown_shard``, the shard if there were one more of that weight.

    ``spread`` names further columns that part rows of one key for numbering.
    The numbers of rows per (shard, part), at most ``len(weights) * slot_parts``
    of them, are summed first; rows are then numbered inside a part only.
    """
    # columns by place, so that their names can't clash with those in here
    names = df.columns
    by_place = {name: f"c{i}" for i, name in enumerate(names)}
    keys, more = ([F.col(by_place[c]) for c in columns] for columns in (key, spread))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), *keys, *more), F.lit(slot_parts)).cast("int")
    placed = df.toDF(*by_place.values()).withColumns({"win": winner(keys, weights, seed), "part": part}).withColumn("shard", (-F.col("win.k")).cast("int"))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy(*keys, *more)
    # starts has at most len(weights) * slot_parts rows of three numbers
    rows = placed.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    added = {"shard": F.col("shard"), "slot": (F.col("start") + F.row_number().over(inside) - 1).cast("long")}
    if grow is not None:
        extra = score(keys, len(weights), grow, seed) if grow > 0 else F.lit(0.0)
        added["grown_shard"] = F.when(extra > F.col("win.s"), F.lit(len(weights))).otherwise(F.col("shard"))
    stay = [name for name in names if name not in added]
    return rows.select(*(by_place[name] for name in stay), *added.values()).toDF(*stay, *added)


def text_facts(df: DataFrame, text: str = "text", overhead: int = 16) -> DataFrame:
    """df with ``size`` (UTF-8 bytes and overhead) and ``text_crc32`` (unsigned)."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return df.withColumns({"size": (F.octet_length(raw) + F.lit(overhead)).cast("long"), "text_crc32": F.crc32(raw).cast("long")})


def shard_documents(docs: DataFrame, shards: int = 40, *, seed: int = SEED) -> DataFrame:
    """Documents in equally weighted shards by doc_id, with what one more shard would change."""
    facts = text_facts(docs)
    rows = shard_records(facts, ["doc_id"], [1.0] * shards, spread=["text_crc32", "size"], grow=1.0, seed=seed)
    return rows.withColumn("law", F.lit("key"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
