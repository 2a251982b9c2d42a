"""Passage deduplication by word windows: repeated runs wherever they start or end.

``linededup`` deletes whole lines.  Here a document is its sequence of words,
and each run of ``MIN_WORDS`` words is a window.  Of equal windows the first one,
by (doc_id, text hash, place), stays, and the words of every later one are
deleted, so any repeated run of that many words or more is caught down to its
border words, within lines and across them.

Every window counts, but few are shuffled one by one:

1. A window's anchor is the least hash of the runs of ``GRAM`` words in it, the
   leftmost of equal ones; equal windows have equal anchors at equal places.
   Windows in a row with one anchor are a stretch, one row for some 22 words
   (one row a window where words repeat so that anchors move on at each word).
2. A stretch whose anchor stands nowhere else has no window that repeats.
3. Stretches of equal words are a class, which has its windows in common: all
   but its first member go whole.
4. Only the first members of classes whose anchor other classes have too are
   spread into windows, which are compared by their hashes.

Texts are hashed by NumPy in tasks; what is shuffled are stretches, the windows of
step 4, and the texts twice.  No key is dropped or capped; a key's rows are
pre-aggregated or the splittable side of a join.

Defined cases: null and empty texts have no words and stay as they are; white
space between words doesn't count for a match, and a deleted word takes the white
space behind it along; rows that repeat doc_id and text are one document and get
one result each; a null doc_id sorts first; columns of the input are kept, those
named like an added column are replaced; an empty table gives an empty result.
Stretches and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.durable import DurableTable, durable
from .textkernel import U64, ngram_hashes, run_hashes, span_hashes, text_chunks, word_spans

MIN_WORDS = 51
#: Words of a run that can be an anchor.
GRAM = 8
_HIGH = U64(0xFFFFFFFF00000000)
_EDGES = "array<struct<lo:int,hi:int>>"


def stretches(words: np.ndarray, rows: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor's hash) of all runs of windows with one anchor, by the word that opens a window; rows are word offsets of documents."""
    k = min(GRAM, min_words)
    grams = ngram_hashes(words, k)
    span = min_words - k + 1
    if len(grams) < span:
        return (np.zeros(0, np.int64),) * 2 + (grams[:0],)
    # of equal upper halves the leftmost
    least, width = (grams & _HIGH) | np.arange(len(grams), dtype=U64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    opens = np.flatnonzero(np.arange(len(least)) + min_words <= np.repeat(rows[1:], np.diff(rows))[: len(least)])
    anchor = (least[opens] & ~_HIGH).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    return opens[starts], opens[np.r_[starts[1:] - 1, len(opens) - 1][: len(starts)]], grams[anchor[starts]]


def _chunk_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows)."""
    for first, _, data, offs in text_chunks(texts):
        starts, ends, rows = word_spans(data, offs)
        yield first, span_hashes(data, starts, ends, lower=False), rows


def _stretch_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, texts = batch.columns
            for row, words, rows in _chunk_words(texts):
                lo, hi, f = stretches(words, rows, min_words)
                doc = np.searchsorted(rows, lo, "right") - 1
                of = pa.array(doc + row)
                places = (pa.array((a - rows[doc]).astype(np.int32)) for a in (lo, hi))
                hashes = (pa.array(h.view(np.int64)) for h in (f, run_hashes(words, lo, hi + min_words)))
                yield pa.RecordBatch.from_arrays([did.take(of), th.take(of), *places, *hashes], ["did", "th", "lo", "hi", "f", "whole"])

    return run


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, texts, edges = batch.columns
            for row, words, rows in _chunk_words(texts):
                here = edges.slice(row, len(rows) - 1)
                lo, hi = (c.to_numpy() for c in here.flatten().flatten())
                doc, n = np.repeat(np.arange(len(here)), here.value_lengths().to_numpy()), hi - lo + 1
                first = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc, n)
                at, of = first + rows[doc], pa.array(doc + row)
                yield pa.RecordBatch.from_arrays([did.take(of), th.take(of), pa.array(first.astype(np.int32)), pa.array(run_hashes(words, at, at + min_words).view(np.int64))], ["did", "th", "first", "key"])

    return run


def repeated_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, runs array<struct<first, last>>): maximal runs of words to delete, counted from 0."""
    texts = docs.select(F.col(doc_id).alias("did"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    kind = texts.schema["did"].dataType.simpleString()
    tables = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        """Written, so that a join has an exchange on each side and a frequent key's partition can be split."""
        tables.append(DurableTable(df, tag))
        return tables[-1].df

    found = kept(texts.where("t IS NOT NULL").mapInArrow(_stretch_rows(min_words), f"did {kind}, th long, lo int, hi int, f long, whole long"), "stretches")
    place = F.struct("did", "th", "lo")
    anchors = kept(found.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("f"), "anchors")
    shared = kept(found.join(anchors.hint("merge"), "f", "left_semi"), "shared-stretches")
    classes = kept(shared.groupBy("f", "whole").agg(F.min(F.struct("did", "th", "lo", "hi")).alias("a"), F.max(place).alias("b")), "stretch-classes")
    first = F.struct("a.did", "a.th", "a.lo")
    # all but the first member of a class
    copies = shared.join(classes.where(~first.eqNullSafe(F.col("b"))).select("f", "whole", first.alias("a")).hint("merge"), ["f", "whole"]).where(~place.eqNullSafe(F.col("a")))
    copies = copies.select("did", "th", F.col("lo").alias("first"), (F.col("hi") + min_words - 1).alias("last"))
    # windows of the first members of classes with a common anchor
    several = kept(classes.groupBy("f").agg(F.min("whole").alias("u"), F.max("whole").alias("v")).where("u != v").select("f"), "anchors")
    edges = classes.join(several.hint("merge"), "f", "left_semi").groupBy("a.did", "a.th").agg(F.collect_list(F.struct("a.lo", "a.hi")).cast(_EDGES).alias("edges"))
    owner = edges.select(F.col("did").alias("d"), F.col("th").alias("h"), "edges")
    narrow = texts.join(owner.hint("merge"), F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("did", "th", "t", "edges")
    windows = kept(narrow.mapInArrow(_window_rows(min_words), f"did {kind}, th long, first int, key long"), "word-windows")
    place = F.struct("did", "th", "first")
    origin = kept(windows.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("key", "a"), "window-origins")
    later = windows.join(origin.hint("merge"), "key").where(~place.eqNullSafe(F.col("a"))).select("did", "th", "first", (F.col("first") + min_words - 1).alias("last"))
    # ranges to maximal runs: a range opens a run if no earlier one reaches it
    doc = Window.partitionBy("did", "th").orderBy("first", "last")
    opened = copies.unionByName(later).withColumn("opens", F.coalesce((F.col("first") > F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("did", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    out = durable(runs.groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")), "word-runs")
    for table in tables:
        table.drop()
    return out


@F.arrow_udf(T.StructType().add("n_words", T.IntegerType()).add("kept", T.StringType()))
def _without_runs(text: pa.Array, runs: pa.Array) -> pa.Array:
    """A text's number of words, and if it has runs what is left without them and the white space behind their words."""
    counts, kept = [], []
    for row, stop, data, offs in text_chunks(text):
        starts, _, rows = word_spans(data, offs)
        counts.append(np.diff(rows).astype(np.int32))
        for i, own in zip(range(stop - row), runs.slice(row, stop - row).to_pylist(), strict=True):
            if not own:
                kept.append(None)
                continue
            edges = np.append(starts[rows[i] : rows[i + 1]], offs[i + 1])
            cuts = [offs[i], *(edge for r in own for edge in (edges[r["first"]], edges[r["last"] + 1])), offs[i + 1]]
            kept.append(b"".join(data[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *counts])), pa.array(kept, pa.binary()).view(pa.string())], ["n_words", "kept"])


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without later repeated runs, n_words, n_removed and removed_runs."""
    # columns by place, so that their names can't clash with those in here
    names = docs.columns
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id, own_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    runs = repeated_words(placed, doc_id=own_id, text=own_text, min_words=min_words)
    joined = placed.withColumn("h", F.xxhash64(own_text)).join(runs.hint("merge"), F.col(own_id).eqNullSafe(F.col("did")) & (F.col("h") == F.col("th")), "left")
    found = F.coalesce(F.col("runs"), F.array().cast("array<struct<first:int,last:int>>"))
    removed = F.aggregate(found, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    out = joined.withColumns({"removed_runs": found, "n_removed": removed}).withColumn("cut", _without_runs(own_text, "removed_runs"))
    out = out.withColumns({own_text: F.when(F.size("removed_runs") > 0, F.col("cut.kept")).otherwise(F.col(own_text)), "n_words": F.col("cut.n_words")})
    added = ("n_words", "n_removed", "removed_runs")
    stay = [(f"c{i}", name) for i, name in enumerate(names) if name not in added]
    return out.select(*(c for c, _ in stay), *added).toDF(*(name for _, name in stay), *added)


def passage_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.array_join(F.transform("removed_runs", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", spans.alias("removed_runs"), F.coalesce(F.length("text"), F.lit(0)).alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
