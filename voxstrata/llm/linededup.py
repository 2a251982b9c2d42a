"""Line deduplication by winnowing over line hashes.

A document is its sequence of lines that have words, each a 64-bit hash and a
number of words.  A window is the shortest run of consecutive lines with at
least ``MIN_WORDS`` words that starts, or that ends, at a line.  The least line
hash in a window is its fingerprint.  Two documents with a common run of lines
of that many words have a window in common, and so a fingerprint, wherever the
run stands: fingerprints are guaranteed.

1. ``fingerprints`` keeps the selected positions only, one row for each.
2. Positions are joined by fingerprint; those of a fingerprint that stands at
   one position only match nothing and go.
3. A match is extended to both sides, line by line, until the common run has
   ``MIN_WORDS`` words.  A frequent line may stand at a third of all positions,
   so its positions aren't taken in pairs: the extensions of a position are the
   windows that selected it, positions whose extensions are equal are one class,
   and each later one is joined with the first of its class.
4. Of equal runs the first one, by (doc_id, text hash, line), stays, and the
   lines of every later one are deleted; overlapping runs are merged, and blank
   lines inside a run go with it.

A line is deleted if and only if it is in a run of lines with ``MIN_WORDS`` words
that equals an earlier run which doesn't hold this line itself.  So where a
passage repeats with overlap, as one line many times in a row does, the lines of
its first occurrence stay.

Expressions only; rows are linear in the lines, hot lines are counted before
they are shuffled, and joins on hot fingerprints are splittable.  A window has
at most ``MIN_WORDS`` lines.

Defined cases: null and empty texts have no lines with words and stay as they
are; lines are compared without white space around them, and tabs in them
count as spaces; rows that repeat doc_id
and text are one document and get one result each; equal texts with different
ids lose all lines but those of the first, if they have enough words; a null
doc_id sorts first; columns of the input are taken by place and kept whatever
their names, but those named like an added column are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import DurableTable, durable

MIN_WORDS = 50
_WORD = "[^\\x20\\x09-\\x0D]+"
ADDED = ("n_lines", "n_removed", "removed_runs")


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(did, th, seq, pos, h, w, total): lines with words of each distinct (doc_id, text), and the document's words."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.trim(F.translate(x, "\t\r\x0b\x0c", "    "))).alias("h"), F.regexp_count(x, F.lit(_WORD)).alias("w")),
    )
    per_doc = docs.select(F.col(doc_id).alias("did"), F.xxhash64(text).alias("th"), F.filter(lines, lambda x: x["w"] > 0).alias("lines")).where(F.size("lines") > 0)
    distinct = per_doc.groupBy("did", "th").agg(F.first("lines").alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["w"])
    return distinct.select("did", "th", total.alias("total"), F.posexplode("lines").alias("seq", "x")).select("did", "th", "seq", "x.pos", "x.h", "x.w", "total")


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, seq, fp, spans): selected positions and, for each, the windows that selected it.

    spans: array<struct<s0, s1, first, last, after, key>>: numbers of the first
    and last line among those with words, their positions, the position of the
    line with words behind them, and a hash of the window's lines (for windows
    that start at a line apart from those that end at one).
    """
    doc = Window.partitionBy("did", "th")
    upto = F.sum("w").over(doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumns({"upto": upto, "after": F.coalesce(F.lead("pos").over(doc.orderBy("seq")), F.col("pos") + 1)}).withColumn("before", F.col("upto") - F.col("w"))
    # a line is in the window from line i if fewer than min_words words lie between their starts, and alike for ends
    ahead, behind = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    def span(frame, kind: int):
        ends = [f("seq").over(frame).alias(name) for f, name in ((F.min, "s0"), (F.max, "s1"))] + [f(c).over(frame).alias(name) for f, c, name in ((F.min, "pos", "first"), (F.max, "pos", "last"), (F.max, "after", "after"))]
        return F.struct(F.min(F.struct("h", "seq")).over(frame).alias("low"), F.struct(*ends, F.xxhash64(F.lit(kind), F.collect_list("h").over(frame)).alias("key")).alias("span"))

    found = placed.select("did", "th", F.when(F.col("total") - F.col("before") >= min_words, span(ahead, 1)).alias("a"), F.when(F.col("upto") >= min_words, span(behind, 2)).alias("b"))
    each = found.select("did", "th", F.explode(F.array("a", "b")).alias("v")).where("v IS NOT NULL")
    return each.groupBy("did", "th", F.col("v.low.seq").alias("seq")).agg(F.first("v.low.h").alias("fp"), F.collect_list("v.span").alias("spans"))


def matched_runs(prints: DataFrame) -> DataFrame:
    """(did, th, run, origin): the extensions of later positions, each with the first one of its class.

    run: struct<s0, s1, first, last, after, key>; origin: the same with did and th.
    """
    place = F.struct("did", "th", "seq")
    repeated = prints.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("fp")
    spans = prints.join(repeated, "fp", "left_semi").select("did", "th", F.explode("spans").alias("run")).withColumn("key", F.col("run.key"))
    start, of_origin = F.struct("did", "th", "run.s0"), F.struct("origin.did", "origin.th", "origin.s0")
    first = spans.groupBy("key").agg(F.min(F.struct("did", "th", "run.s0", "run.s1", "run.last", "run.after")).alias("origin"), F.max(start).alias("b")).where(~of_origin.eqNullSafe(F.col("b"))).select("key", "origin")
    return spans.join(first, "key").where(~start.eqNullSafe(of_origin)).select("did", "th", "run", "origin")


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, runs array<struct<first, last>>): maximal runs of line positions to delete."""
    prints = DurableTable(fingerprints(document_lines(docs, doc_id, text), min_words), "line-fingerprints")
    own = F.col("did").eqNullSafe(F.col("origin.did")) & (F.col("th") == F.col("origin.th")) & (F.col("origin.s1") >= F.col("run.s0"))
    # what overlaps with the first occurrence isn't a repetition of it
    start = F.when(own, F.struct((F.col("origin.s1") + 1).alias("s"), F.col("origin.after").alias("p"))).otherwise(F.struct(F.col("run.s0").alias("s"), F.col("run.first").alias("p")))
    later = matched_runs(prints.df).groupBy("did", "th", start.alias("a")).agg(F.max(F.struct(F.col("run.s1").alias("s"), F.col("run.last").alias("p"))).alias("b"))
    # ranges to maximal runs: a range opens a run if no earlier one reaches it
    doc = Window.partitionBy("did", "th").orderBy("a")
    reach = F.max("b.s").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.coalesce((F.col("a.s") > reach + 1).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("did", "th", "run").agg(F.min("a.p").alias("first"), F.max("b.p").alias("last"))
    out = durable(runs.groupBy("did", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-runs")
    prints.drop()
    return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without later repeated runs, n_lines, n_removed and removed_runs."""
    # columns by place, so that their names can't clash with those in here
    names = docs.columns
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id, own_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    runs = repeated_runs(placed, doc_id=own_id, text=own_text, min_words=min_words)
    # a plan for few runs and for many
    joined = placed.withColumn("h", F.xxhash64(own_text)).join(runs.hint("merge"), F.col(own_id).eqNullSafe(F.col("did")) & (F.col("h") == F.col("th")), "left")
    found = F.coalesce(F.col("runs"), F.array().cast("array<struct<first:int,last:int>>"))
    removed = F.aggregate(found, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    # what stays lies between the end of one run and the start of the next
    edge = F.array(F.struct(F.size("lines").alias("first"), F.size("lines").alias("last")))
    gaps = F.transform(F.concat("removed_runs", edge), lambda r, i: F.struct((F.coalesce(F.get(F.col("removed_runs"), i - 1)["last"], F.lit(-1)) + 1).alias("a"), r["first"].alias("b")))
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 1, g["b"] - g["a"]))), "\n")
    out = joined.withColumns({"removed_runs": found, "n_removed": removed, "lines": F.split(F.col(own_text), "\n")}).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)))
    out = out.withColumn(own_text, F.when(F.size("removed_runs") > 0, kept).otherwise(F.col(own_text)))
    stay = [(f"c{i}", name) for i, name in enumerate(names) if name not in ADDED]
    return out.select(*(c for c, _ in stay), *ADDED).toDF(*(name for _, name in stay), *ADDED)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    spans = F.array_join(F.transform("removed_runs", lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_removed", spans.alias("removed_runs"), F.coalesce(F.length("text"), F.lit(0)).alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
