"""Token counts by an exact histogram of encoded lengths.

Each document is encoded once and only its length is kept; documents are
counted by length, so what is shuffled and kept grows with the number of
distinct lengths, not of documents.  Suffix sums over the histogram then give,
for every context limit at once, the number of longer documents, their tokens,
and the tokens that remain if each document is cut at the limit; running counts
give exact quantiles.

The splitting pattern looks ahead in white space and would go back through a run
of a million characters; so long runs are cut out first, by the pattern's own
rule, and merged without it, which gives the same tokens.

Defined cases: a null text and an empty text have 0 tokens; control strings in
a text are ordinary text; very long texts and runs are encoded whole; an empty
table gives an empty histogram; other columns are ignored, and columns to keep
are taken by place, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[tuple[int, str], object] = {}


def _encoder(raw: bytes, pattern: str):
    """The byte-level BPE of a rank file's bytes, made once a process."""
    key = (zlib.crc32(raw), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


#: How byte-level BPE splits a text before merging (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space from this length on are merged without the pattern.
LONG_RUN = 10_000
_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")


def count_tokens(encoder, text: str) -> int:
    """Tokens of a text under a pattern that splits white space as ``PATTERN`` does."""
    total = at = 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        # a run before a word leaves its last character to it
        end = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, text: str = "text", keep: Sequence[str] = (), *, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` of docs with ``n_tokens``."""
    # the driver reads the vocabulary, a file of a megabyte, and sends it along
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or f"{TOKENIZER_DIR}/{VOCABULARY}").read_bytes())
    kept = docs.select(*keep)
    # by place, so that names can't clash
    chosen = docs.select(*keep, text).toDF(*(f"c{i}" for i in range(len(keep) + 1)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            counts = [count_tokens(encoder, t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    schema = ", ".join([*(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(chosen.columns, kept.schema.fields, strict=False)), "n_tokens long"])
    return chosen.mapInArrow(encode, schema).toDF(*kept.columns, "n_tokens")


def length_histogram(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and distinct length L, with sums over the whole group:

    docs: documents of length L; docs_upto, docs_over: those of length <= L, > L;
    tokens: tokens of all; tokens_upto: in documents of length <= L;
    truncated_tokens: left if each document is cut at L; quantile: docs_upto / all.
    """
    bars = counts.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    # windows over the histogram: one row per distinct length
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("docs") * F.col("n_tokens")
    sums = bars.withColumns({"docs_upto": F.sum("docs").over(upto), "tokens_upto": F.sum(mass).over(upto), "_docs": F.sum("docs").over(group), "tokens": F.sum(mass).over(group)})
    over = F.col("_docs") - F.col("docs_upto")
    return sums.select(
        *by, "n_tokens", "docs", "docs_upto", over.alias("docs_over"), "tokens_upto", "tokens", (F.col("tokens_upto") + over * F.col("n_tokens")).alias("truncated_tokens"), (F.col("docs_upto") / F.col("_docs")).alias("quantile")
    )


def truncated_total(histogram: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Tokens left under any context limit, whether or not a document has that length."""
    return histogram.groupBy(*by).agg(F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit))).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > limit, F.col("docs")).otherwise(0)).alias("docs_over"))


def quantile_length(histogram: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The least length that a part q of the documents doesn't exceed."""
    return histogram.where(F.col("quantile") >= q).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return length_histogram(token_counts(docs))
