"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words; targets are filled like water: every
source gets its weight's part, none more than ``max_copies`` times its own
size, and what is cut off is shared by weight among the others.  A document of
a source with target / size = c gets floor(c) whole copies for certain.  The
rest of the target is a sample of a fixed number of words: a document's
inclusion probability is in proportion to its size (and to a document weight, if
there is one), so that all of them together expect the rest; documents for which
that is 1 or more are certain.  Documents are ranked by random odds divided by
inclusion odds (Pareto order sampling) and taken in that order until the next
would exceed the rest.  Long documents so come early, while there is room, and
short ones fill up.  While a source misses more than ``TOLERANCE`` of its target
and left-over documents fit, the order goes on among those.  What is missing
then is made up by exchange: of at most ``CANDIDATES`` documents of each size
class, taken and left over, one is added, or one is swapped for another,
whichever brings the sum nearest to the target, again and again until it is
within ``TOLERANCE`` or no such step helps.

No task holds a source: rank keys are cut into ``RANK_CELLS`` cells, sums per
(source, cell), and of blocks of cells, find the one cell in which a source's rest is reached, and only
that cell's rows are ordered one by one.  What is known of a source reaches its
rows by a broadcast of at most ``BROADCAST_SOURCES`` sources, else by a join in
which each source has ``SALT`` parts.

Defined cases: a null text has 0 words; a null source is a source of its own,
after all others; a document without words is taken 0 words; an empty table
gives an empty result; repeated rows are separate rows, ranked alike, each at
most ``max_copies`` times; random numbers are hashes of doc_id, size and text, so
reruns agree; columns of the input are kept, those named like an added column
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = 2_718_281
RANK_CELLS = 1 << 14
CELL_BLOCK = 1 << 7
MAX_COPIES = 3
#: Documents of one size class (16 classes for each doubling) that an exchange looks at, taken and left over.
CANDIDATES = 8
TOLERANCE = 1e-3
SALT = 64
#: Up to so many sources, the table of targets (a row of a few numbers each) is broadcast.
BROADCAST_SOURCES = 10_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(by_source: DataFrame) -> DataFrame:
    """by_source with ``_i``, its place in the order of sources; counted by ranges, so no task holds all sources."""
    ranges = durable(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-sources")
    # one row a range
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return ranges.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn("_i", F.col("_start") + F.row_number().over(inside) - 1)


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float | None = None, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): one row per source.

    The filling level t solves sum(min(weight * t, max_copies * size)) = budget.
    It rises from budget / sum(weight): each round shares what the sources above
    their cap leave among the others, until no further source is above it.  The
    driver sees three sums a round.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_i"), F.lit(len(weights))) + 1).cast("int"))
    ranked = _ranked(by_source).select("source", "source_size", weight.alias("weight"), (F.lit(float(max_copies)) * F.col("source_size")).alias("cap"))
    table = durable(ranked, "mix-caps")
    words, caps, left = table.agg(F.sum("source_size"), F.sum("cap"), F.sum("weight")).first()
    if words is None:
        return table.select("source", "source_size", F.col("cap").alias("target"))
    total = float(words) if budget is None else min(float(budget), caps)
    level, above = total / left, 0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        now, cut, left = table.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if now == above or left <= 0:
            break
        level, above = (total - cut) / left, now
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _with_source(rows: DataFrame, facts: DataFrame, key: str, few: bool, how: str = "inner") -> DataFrame:
    """rows(_row, source, ..) with facts, a row for each source in ``key``; no task gets all rows of a source."""
    same = F.col("source").eqNullSafe(F.col(key))
    if few:
        return rows.join(F.broadcast(facts), same, how)
    parts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
    return salted.join(parts, same & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")


def _cut(keyed: DataFrame, few: bool) -> DataFrame:
    """keyed(_row, doc_id, source, size, _key, _cell, _goal, ..) with ``_in``: taken in the order of keys before ``_goal`` is exceeded."""
    cells = keyed.groupBy("source", "_cell").agg(F.sum("size").alias("_words"), F.first("_goal").alias("_goal"))
    # first the block of cells, then the cell in it: windows of RANK_CELLS / CELL_BLOCK and of CELL_BLOCK rows a source
    block = F.floor(F.col("_cell") / CELL_BLOCK).cast("int")

    def first_over(sums: DataFrame, place: str, before: Column) -> DataFrame:
        run = sums.withColumn("_sum", F.sum("_words").over(Window.partitionBy("source").orderBy(place)) + before)
        edge = F.min_by(F.struct(place, (F.col("_sum") - F.col("_words")).alias("before")), place)
        return run.where("_sum > _goal").groupBy(F.col("source").alias("_es")).agg(edge.alias("edge"))

    blocks = cells.groupBy("source", block.alias("_block")).agg(F.sum("_words").alias("_words"), F.first("_goal").alias("_goal"))
    reached = first_over(blocks, "_block", F.lit(0))
    reached = F.broadcast(reached) if few else reached
    inside = cells.join(reached, F.col("source").eqNullSafe(F.col("_es")) & (block == F.col("edge._block"))).select("source", "_cell", "_words", "_goal", F.col("edge.before").alias("_from"))
    edges = first_over(inside, "_cell", F.col("_from")).select("_es", F.col("edge._cell").alias("_edge"), F.col("edge.before").alias("_before"))
    placed = _with_source(keyed, edges, "_es", few, "left")
    # every cell before the edge is taken; a source that never reaches its goal takes all
    run = Window.partitionBy("source").orderBy("_key", "doc_id", "size", "_row")
    ordered = placed.where("_cell = _edge").withColumn("_sum", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    decided = ordered.withColumn("_in", F.col("_sum") <= F.col("_goal"))
    others = placed.where("_cell <> _edge OR _edge IS NULL").withColumn("_in", F.coalesce(F.col("_cell") < F.col("_edge"), F.lit(True)) & (F.col("_goal") > 0))
    columns = [*keyed.columns, "_in"]
    return decided.select(*columns).unionAll(others.select(*columns))


def _size_factors(rows: DataFrame, few: bool) -> DataFrame:
    """(_ls, _lambda) from rows(source, size, _tilt, _rest): sum(size * min(1, lambda * size * tilt)) is the rest of each source.

    Sizes are summed by classes first, so a source has a few hundred rows here.
    """
    pull = F.col("size") * F.col("_tilt")
    classes = rows.groupBy("source", F.floor(4 * F.log2(pull)).alias("_class")).agg(F.sum("size").cast("double").alias("_one"), F.sum(F.col("size") * pull).alias("_two"), F.first("_rest").alias("_rest"))
    # the classes of the largest are certain first
    mean = F.col("_two") / F.col("_one")
    order = Window.partitionBy("source").orderBy(mean.desc(), "_class")
    certain = F.coalesce(F.sum("_one").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("_two").over(Window.partitionBy("source").orderBy(mean, F.col("_class").desc()).rowsBetween(Window.unboundedPreceding, 0))
    tried = classes.select("source", mean.alias("_mean"), ((F.col("_rest") - certain) / others).alias("_lambda"))
    found = tried.where("_lambda * _mean <= 1").groupBy(F.col("source").alias("_ls")).agg(F.max_by("_lambda", "_mean").alias("_lambda"))
    return F.broadcast(found) if few else found


def mix_copies(rows: DataFrame, targets: DataFrame, *, doc_weight: str | None = None, seed: int = SEED, max_copies: int = MAX_COPIES, few_sources: bool = False) -> DataFrame:
    """rows(_row, doc_id, source, size) with source_size, target, whole copies ``_sure``, ``_rest``, and ``_in``: in the sample up to the first that doesn't fit.

    ``_row`` must be unique; a column ``_tie`` of rows goes into the random numbers.
    With ``few_sources`` tables of sources are broadcast.  ``doc_weight`` names a
    positive column that the inclusion probabilities are multiplied by.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = targets.select(F.col("source").alias("_source"), "source_size", "target", F.least(F.floor(rate), F.lit(max_copies)).cast("int").alias("_sure"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_sure") * F.col("source_size"))
    tilt = F.coalesce(F.col(doc_weight).cast("double"), F.lit(1.0)) if doc_weight else F.lit(1.0)
    known = _with_source(rows, goal, "_source", few_sources).withColumn("_tilt", tilt)
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("_rest"))
    odd = _with_source(known, _size_factors(known.where(fits), few_sources), "_ls", few_sources, "left")
    # a source whose documents are all certain has no factor
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.coalesce("_lambda", F.lit(1.0)) * F.greatest("size", F.lit(1)) * F.col("_tilt")))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", *(c for c in ("_tie",) if c in rows.columns)), 12).cast("double") + 0.5) / float(1 << 52)
    key = (unit / (1 - unit)) / (p / (1 - p))
    # the rest is reached at odds of about 1, in the middle of the cells
    keyed = odd.withColumn("_key", key).withColumns({"_cell": F.least(F.floor(F.col("_key") / (1 + F.col("_key")) * RANK_CELLS), F.lit(RANK_CELLS - 1)).cast("int"), "_goal": F.col("_rest")})
    keyed = keyed.select(*rows.columns, "source_size", "target", "_sure", "_rest", "_key", "_cell", "_goal")
    return _cut(keyed.where(fits), few_sources).unionAll(keyed.where(~fits).withColumn("_in", F.lit(False)))


def _exchange(table: pa.Table) -> pa.Table:
    """Changes of one source: +1 for a document added, -1 for one given up; rows(_row, taken, size, _key, doc_id, _gap, _slack)."""
    gap, slack = table.column("_gap")[0].as_py(), table.column("_slack")[0].as_py()
    parts = []
    for taken in (True, False):
        rows = sorted(((r["size"], r["_key"], r["doc_id"] is None, r["doc_id"], r["_row"]) for r in table.to_pylist() if r["taken"] == taken), key=lambda r: (*r[:3], str(r[3]), r[4]))
        parts.append((np.array([r[0] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)))
    (outs, out_rows), (ins, in_rows) = parts
    changes: list[tuple[int, int]] = []
    while abs(gap) > slack and len(ins):
        # giving up nothing, or one of the taken
        given = np.append(0, outs)
        at = np.searchsorted(ins, given + gap)
        low, high = np.maximum(at - 1, 0), np.minimum(at, len(ins) - 1)
        pick = np.where(np.abs(gap + given - ins[low]) <= np.abs(gap + given - ins[high]), low, high)
        error = np.abs(gap + given - ins[pick])
        best = int(np.argmin(error))
        if error[best] >= abs(gap):
            break
        k = int(pick[best])
        changes.append((int(in_rows[k]), 1))
        gap += int(given[best]) - int(ins[k])
        ins, in_rows = np.delete(ins, k), np.delete(in_rows, k)
        if best:
            changes.append((int(out_rows[best - 1]), -1))
            outs, out_rows = np.delete(outs, best - 1), np.delete(out_rows, best - 1)
    rows, deltas = zip(*changes, strict=True) if changes else ((), ())
    return pa.table({"_frow": pa.array(rows, pa.int64()), "_delta": pa.array(deltas, pa.int32())})


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    row_id: str | None = None,
    budget: float | None = None,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """(_row, doc_id, source, size, source_size, target, copies) for each document.

    ``_row`` numbers the rows, or is the unique column that ``row_id`` names.
    """
    row = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    tie = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    narrow = docs.select(row.alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), tie.alias("_tie"))
    sizes = durable(narrow, "mix-sizes")
    targets = durable(source_targets(sizes, weights, budget, max_copies), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    chosen = durable(mix_copies(sizes, targets, seed=seed, max_copies=max_copies, few_sources=few), "mix-chosen")
    taken = chosen.where("_in").groupBy(F.col("source").alias("_ts")).agg(F.sum("size").alias("_taken"))
    sure = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(0)
    gaps = targets.join(taken, F.col("source").eqNullSafe(F.col("_ts")), "left").select(
        F.col("source").alias("_gs"), (F.col("target") - sure * F.col("source_size") - F.coalesce("_taken", F.lit(0))).alias("_gap"), (F.lit(TOLERANCE) * F.col("target")).alias("_slack")
    )
    gaps = durable(gaps, "mix-gaps")
    columns = ["_row", "doc_id", "source", "size", "_key", "_cell"]
    left, more = chosen.where("NOT _in AND size > 0 AND _rest > 0").select(*columns), []
    # the order goes on behind a document that doesn't fit: each round takes what fits of the documents that fitted before
    while True:
        fits = _with_source(left, gaps.where("_gap > _slack").select("_gs", F.col("_gap").alias("_goal")), "_gs", few).where("size <= _goal")
        fits = durable(_cut(fits.drop("_gs"), few), "mix-fits")
        now = fits.where("_in")
        gains = now.groupBy(F.col("source").alias("_ts")).agg(F.sum("size").alias("_more"))
        following = durable(gaps.join(gains, F.col("_gs").eqNullSafe(F.col("_ts")), "left").select("_gs", (F.col("_gap") - F.coalesce("_more", F.lit(0))).alias("_gap"), "_slack", F.col("_more").isNotNull().alias("_moved")), "mix-gaps")
        gaps = following.drop("_moved")
        if following.where("_moved").isEmpty():
            break
        more.append(now.select("_row"))
        left = fits.where("NOT _in").select(*columns)
    added = reduce(DataFrame.unionAll, more).withColumn("_more", F.lit(True)) if more else None
    state = chosen.where("size > 0 AND _rest > 0").select(*columns, "_in")
    if added is not None:
        state = state.join(added, "_row", "left").select(*columns, (F.col("_in") | F.coalesce("_more", F.lit(False))).alias("_in"))
    # only the last of the taken and the first of the left-over documents of a size class are looked at
    short = _with_source(state, gaps.where("_gap > _slack"), "_gs", few).withColumn("_class", F.floor(16 * F.log2("size")))
    rank = Window.partitionBy("source", "_in", "_class").orderBy(F.when(F.col("_in"), -F.col("_key")).otherwise(F.col("_key")), "doc_id", "size", "_row")
    near = short.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= CANDIDATES)
    changes = near.select("source", "_row", F.col("_in").alias("taken"), "size", "_key", "doc_id", "_gap", "_slack").groupBy("source").applyInArrow(_exchange, "_frow long, _delta int")
    if added is not None:
        changes = changes.unionAll(added.select(F.col("_row").alias("_frow"), F.lit(1).alias("_delta")))
    changes = changes.groupBy("_frow").agg(F.sum("_delta").cast("int").alias("_delta"))
    out = chosen.join(changes, F.col("_row") == F.col("_frow"), "left")
    copies = F.least(F.lit(max_copies), F.col("_sure") + F.col("_in").cast("int") + F.coalesce("_delta", F.lit(0)))
    return out.select("_row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_corpus(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), *, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    # columns by place, so that their names can't clash with those in here
    names = docs.columns
    by_place = {name: f"c{i}" for i, name in enumerate(names)}
    # the numbers must be the same for every reader, so rows are written with them
    rows = durable(docs.toDF(*by_place.values()).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    chosen = mix_documents(rows, weights, text=by_place[text], source=by_place[source], doc_id=by_place[doc_id], row_id="_row", **options)
    copies = chosen.where("copies > 0").select(F.col("_row").alias("_taken"), "copies")
    out = rows.join(copies, F.col("_row") == F.col("_taken"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*by_place.values()).toDF(*names)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
