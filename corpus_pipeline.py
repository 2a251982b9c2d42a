"""A training-corpus pipeline: five stages over the ``documents`` table.

toxicity: documents scored as toxic go.  ngram_dedup: one document of each
near-duplicate component stays.  decontamination: documents that overlap with a
benchmark item go.  mixing: documents are repeated or left out so that sources
reach their target weights.  sharding: the rows get shards and slots.  Every
stage but the last returns the columns of ``documents``.

Defined cases: a null or empty text has the score of no terms, is no duplicate
and overlaps with nothing, has 0 words (a source of such texts only is taken 0
times) and 16 bytes in a shard; texts are read whole however long.  A null
doc_id is a key of its own.  Of rows that repeat doc_id and text one stays;
of a component the least doc_id stays, so ties can't occur.  A null source is a
source of its own.  Empty tables give an empty result; without labels nothing is
toxic unless the smoothed rate is, without benchmark items nothing overlaps.
Further columns go through whatever their names, by place; those named like a
column that sharding adds (size, text_crc32, shard, slot, law, grown_shard) are
replaced by it in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxstrata.llm import decontam, mixing, ngram_join, sharding, toxicity
from voxstrata.plans.durable import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # columns by place, so that a score of the input stays
    names = docs.columns
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    scored = toxicity.score_documents(placed, model, text=f"c{names.index('text')}")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*placed.columns).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: SQL can't express the trained model, the components or the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{name}")
    return docs
