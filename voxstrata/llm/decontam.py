"""Benchmark decontamination by spaced-seed hashing.

Texts are word sequences (runs of letters and digits, lower-cased; punctuation
is dropped).  A fixed mask reads some of the words of a window and ignores the
others, so two windows that differ only at ignored places have equal hashes.
The hashes of all benchmark windows are joined with those of all training
windows; around each hit the two texts are laid side by side, and the longest
stretch between two equal words in which at least ``min_match`` of the words
agree is taken.  It counts if it has ``min_words`` words (or the whole item, if
shorter).

A benchmark of up to ``BLOCK_WORDS`` words is one table of hashes that is
broadcast; the documents are read once.  A larger one is never brought together:
its hashes are a table in the shared folder, a filter of 2**26 bits made from
them (its size is fixed) picks the documents' hashes that may be in it, and both
are joined by a shuffle; the pairs are verified where their two texts meet.
Documents are read once for their hashes, and those in pairs once more.

A hash that stands at many places of one document and of one item, as in texts
that repeat themselves, isn't expanded to all pairs of places: of the pairs only
the distinct distances count, at most as many as both texts have words, and a
correlation of the places gives them.

Defined cases: null texts are empty and overlap with nothing; an item with
fewer words than a mask reads is found only as a whole document; items and
documents that repeat are each reported; very long texts are read whole; empty
tables give empty results; null ids stay null; other columns are ignored, or
kept by place where rows are filtered, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.durable import durable
from .textkernel import U64, mix64, ngram_hashes, text_chunks, word_hashes

#: Places that each mask reads.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 7), (0, 1, 2, 4, 5))
MIN_WORDS = 13
MIN_MATCH = 0.8
BLOCK_WORDS = 400_000
_BITS, _FILTER_BITS = 22, 26
#: Pairs of places that are expanded at a time, and for one document, item and hash.
_SLICE, _PRODUCT = 1 << 18, 1 << 14


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct values of p - q for two sorted lists of places."""
    reach = int(p[-1] - p[0] + q[-1] - q[0]) + 1
    if len(p) * len(q) <= max(_PRODUCT, reach):
        return np.unique(p[:, None] - q[None, :])
    size = 1 << int(reach).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[p - p[0]] = 1
    y[q[-1] - q] = 1
    both = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)
    return np.flatnonzero(both[:reach] > 0.5) + int(p[0] - q[-1])


def longest_stretch(same: np.ndarray, min_match: float) -> tuple[int, int, int] | None:
    """(start, words, matches) of the longest stretch between two matches that has enough of them.

    With a match worth 1 - min_match and a substitution -min_match, those
    are the stretches whose sum isn't negative; ``low`` is the least prefix
    sum before a match up to each place.
    """
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - min_match, -min_match))])
    low = np.minimum.accumulate(np.where(same, total[:-1], np.inf))
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return None
    starts = np.searchsorted(-low, -total[ends] - 1e-9, "left")
    best = int(np.argmax(ends - starts))
    start, n = int(starts[best]), int(ends[best] - starts[best])
    return start, n, int(same[start : start + n].sum())


def best_overlap(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH) -> tuple[int, int, int, int] | None:
    """(start in doc, start in item, words, matches) of the stretch with most matches, of those the one of the least shift.

    Shifts with the longest common part come first; those whose part is no
    longer than the matches already found can't be better.
    """
    first, last = np.maximum(0, shifts), np.minimum(len(doc), len(item) + shifts)
    best, at = None, 0
    for k in np.lexsort((shifts, first - last)).tolist():
        a, b, shift = int(first[k]), int(last[k]), int(shifts[k])
        if best and (b - a < best[3] or (b - a == best[3] and shift > at)):
            break
        found = longest_stretch(doc[a:b] == item[a - shift : b - shift], min_match)
        if found and found[1] >= min(min_words, len(item)) and (not best or (found[2], -shift) > (best[3], -at)):
            best, at = (a + found[0], a + found[0] - shift, found[1], found[2]), shift
    return best


class SeedTable:
    """Hashes of the windows of some benchmark items."""

    def __init__(self, ids: list, texts: list, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH):
        self.ids, self.min_words, self.min_match = ids, min_words, min_match
        words, rows = [], [0]
        for _, _, data, offs in text_chunks(pa.array(texts, pa.string())):
            w, r = word_hashes(data, offs, letters_only=True)
            words.append(w)
            rows.extend((r[1:] + rows[-1]).tolist())
        self.words = np.concatenate(words) if words else np.zeros(0, U64)
        self.rows = np.array(rows)
        self.seeds = []
        for mask in MASKS:
            span = mask[-1] + 1
            h = ngram_hashes(self.words, span, mask)
            at = np.arange(len(h))
            item = np.searchsorted(self.rows, at, "right") - 1
            ok = at + span <= self.rows[item + 1]
            h, at = h[ok], at[ok]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[(h >> U64(64 - _BITS)).astype(np.int64)] = True
            self.seeds.append((mask, span, h[order], at[order], seen))
        self.short = {}
        for i in np.flatnonzero((np.diff(self.rows) > 0) & (np.diff(self.rows) < len(MASKS[0]))):
            self.short.setdefault(self.words[self.rows[i] : self.rows[i + 1]].tobytes(), []).append(int(i))

    def overlaps(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, start in row, start in item, words, matches) of the best stretch of each pair."""
        width, items = len(words) + len(self.words) + 1, len(self.rows) - 1
        keys = [np.zeros(0, np.int64)]

        def keep(row, item, p, q) -> None:
            shift = (p - rows[row]) - (q - self.rows[item])
            keys.append(np.unique((row * items + item) * width + shift + len(self.words)))

        for mask, span, hashes, at, seen in self.seeds:
            if not len(hashes):
                continue
            h = ngram_hashes(words, span, mask)
            p = np.flatnonzero(seen[(h >> U64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[p], "left"), np.searchsorted(hashes, h[p], "right")
            row = np.searchsorted(rows, p, "right") - 1
            ok = (hi > lo) & (p + span <= rows[row + 1])
            p, lo, n, row = p[ok], lo[ok], (hi - lo)[ok], row[ok]
            # places of one hash in one row; those with many pairs are taken by item
            group, of, count = np.unique(row * len(hashes) + lo, return_inverse=True, return_counts=True)
            hot = (count[of] > 1) & (count[of] * n > _PRODUCT)
            for g in np.unique(of[hot]).tolist():
                mine = np.flatnonzero(of == g)
                q = at[lo[mine[0]] : lo[mine[0]] + n[mine[0]]]
                item = np.searchsorted(self.rows, q, "right") - 1
                for i in np.unique(item).tolist():
                    shift = distances(p[mine] - rows[row[mine[0]]], q[item == i] - self.rows[i])
                    keys.append((row[mine[0]] * items + i) * width + shift + len(self.words))
            p, lo, n, row = p[~hot], lo[~hot], n[~hot], row[~hot]
            cuts = np.searchsorted(np.cumsum(n), np.arange(_SLICE, n.sum() + _SLICE, _SLICE), "left") + 1
            a = 0
            for b in np.minimum(cuts, len(n)).tolist():
                k = n[a:b]
                q = at[np.repeat(lo[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                if len(q):
                    keep(np.repeat(row[a:b], k), np.searchsorted(self.rows, q, "right") - 1, np.repeat(p[a:b], k), q)
                a = b
        found = np.unique(np.concatenate(keys))
        pair, shift = found // width, found % width - len(self.words)
        edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True][: len(pair) + 1]) if len(pair) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            row, item = divmod(int(pair[a]), items)
            best = best_overlap(words[rows[row] : rows[row + 1]], self.words[self.rows[item] : self.rows[item + 1]], shift[a:b], self.min_words, self.min_match)
            if best:
                yield row, item, *best
        if self.short:
            for row in np.flatnonzero(np.diff(rows) < len(MASKS[0])).tolist():
                n = int(rows[row + 1] - rows[row])
                for item in self.short.get(words[rows[row] : rows[row + 1]].tobytes(), ()):
                    yield row, item, 0, 0, n, n


def _is_large(benchmark: DataFrame, text: str, block_words: int) -> bool:
    """Whether the benchmark may have more than block_words words of four bytes."""
    return (benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0) > 4 * block_words


def _seed_table(benchmark: DataFrame, item_id: str, text: str, **options) -> SeedTable:
    items = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("i", "t").collect()
    return SeedTable([r.i for r in items], [r.t for r in items], **options)


def _seeds(words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in row, hash) for each mask; rows of fewer words than a mask reads have one hash of all."""
    for k, mask in enumerate(MASKS):
        span = mask[-1] + 1
        h = mix64(ngram_hashes(words, span, mask) ^ U64(k))
        row = np.searchsorted(rows, np.arange(len(h)), "right") - 1
        ok = np.arange(len(h)) + span <= rows[row + 1]
        yield row[ok], np.flatnonzero(ok) - rows[row[ok]], h[ok]
    short = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < len(MASKS[0])))
    whole = [ngram_hashes(words[rows[r] : rows[r + 1]], int(rows[r + 1] - rows[r])) ^ U64(len(MASKS)) for r in short]
    yield short, np.zeros(len(short), np.int64), mix64(np.concatenate([np.zeros(0, U64), *whole]))


def _seed_places(shared=None):
    """(key, text) to (key, hash, places): one row for each text and hash, if shared is given those in its filter only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for first, _, data, offs in text_chunks(batch.column(1)):
                row, place, h = (np.concatenate(x) for x in zip(*_seeds(*word_hashes(data, offs, letters_only=True)), strict=True))
                if bits is not None:
                    cell = h >> U64(64 - _FILTER_BITS)
                    may = (bits[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) == 1
                    row, place, h = row[may], place[may], h[may]
                order = np.lexsort((place, h, row))
                row, place, h = row[order], place[order], h[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)])
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[new])), pa.array(h[new].view(np.int64)), places], names=["key", "hash", "places"])

    return run


def _pair_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tk, ik, doc places, item places) to (tk, ik, shifts)."""
    for batch in batches:
        out = [distances(p.values.to_numpy(), q.values.to_numpy()) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["tk", "ik", "shifts"])


def _verify_pairs(min_words: int, min_match: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for i in range(batch.num_rows):
                doc, item = (word_hashes(data, offs, letters_only=True)[0] for c in (2, 3) for _, _, data, offs in text_chunks(batch.column(c).slice(i, 1)))
                short = len(item) < len(MASKS[0])
                if short:
                    best = (0, 0, len(item), len(item)) if len(item) == len(doc) and (item == doc).all() else None
                else:
                    best = best_overlap(doc, item, batch.column(4)[i].values.to_numpy(), min_words, min_match)
                if best:
                    keys.append(i)
                    out.append(best)
            numbers = zip(*out, strict=True) if out else [()] * 4
            chosen = [batch.column(c).take(pa.array(keys, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*chosen, *(pa.array(n, pa.int64()) for n in numbers)], names=["tk", "ik", "doc_word", "item_word", "n_words", "n_matches"])

    return run


def text_key(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def joined_overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", min_words: int = MIN_WORDS, min_match: float = MIN_MATCH) -> DataFrame:
    """(tk, ik, doc_word, item_word, n_words, n_matches) of overlapping texts, named by ``text_key``, for a benchmark of any size."""
    spark = docs.sparkSession
    texts = docs.select(text_key(F.col(text)).alias("tk"), F.coalesce(F.col(text), F.lit("")).alias("doc"))
    items = benchmark.select(text_key(F.col(item_text)).alias("ik"), F.coalesce(F.col(item_text), F.lit("")).alias("item")).groupBy("ik").agg(F.first("item").alias("item"))
    seeds = durable(items.mapInArrow(_seed_places(), "ik string, hash long, places array<int>"), "seeds")
    cell = F.shiftrightunsigned("hash", 64 - _FILTER_BITS)
    words = seeds.groupBy(F.shiftright(cell, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - _FILTER_BITS}) & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 6), U64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    shared = spark.sparkContext.broadcast(bits)
    hits = texts.mapInArrow(_seed_places(shared), "tk string, hash long, places array<int>").withColumnRenamed("places", "at").dropDuplicates(["tk", "hash"])
    near = hits.join(seeds, "hash").select("tk", "ik", "at", "places").mapInArrow(_pair_distances, "tk string, ik string, shifts array<long>")
    pairs = durable(near.select("tk", "ik", F.explode("shifts").alias("shift")).distinct().groupBy("tk", "ik").agg(F.collect_list("shift").alias("shifts")), "seed-pairs")
    met = texts.join(pairs.select("tk").distinct(), "tk", "left_semi").groupBy("tk").agg(F.first("doc").alias("doc"))
    rows = pairs.join(met, "tk").join(items, "ik").select("tk", "ik", "doc", "item", "shifts")
    return rows.mapInArrow(_verify_pairs(min_words, min_match), "tk string, ik string, doc_word long, item_word long, n_words long, n_matches long")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_matches for each overlapping pair."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    if _is_large(benchmark, item_text, block_words):
        found = durable(joined_overlaps(narrow, benchmark, item_text=item_text, **options), "overlaps")
        named = benchmark.select(F.col(item_id).alias("item_id"), text_key(F.col(item_text)).alias("ik"))
        of_docs = narrow.select("doc_id", text_key(F.col("text")).alias("tk"))
        return of_docs.join(found, "tk").join(named, "ik").select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matches")
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    shared = spark.sparkContext.broadcast(_seed_table(benchmark, item_id, item_text, **options))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: SeedTable = shared.value
        for batch in batches:
            ids, out = batch.column(0), []
            for first, _, data, offs in text_chunks(batch.column(1)):
                out.extend((first + row, *rest) for row, *rest in table.overlaps(*word_hashes(data, offs, letters_only=True)))
            if out:
                rows, items, *numbers = zip(*out, strict=True)
                columns = [ids.take(pa.array(rows)), pa.array([table.ids[i] for i in items], item_type), *(pa.array(n, pa.int64()) for n in numbers)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matches"])

    return narrow.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_word long, item_word long, n_words long, n_matches long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The rows of docs that overlap with no benchmark item, in the same pass."""
    names = docs.columns
    placed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text)
    if _is_large(benchmark, item_text, block_words):
        found = durable(joined_overlaps(placed, benchmark, text=f"c{at}", item_text=item_text, **options).select("tk").distinct(), "overlaps")
        return placed.withColumn("key", text_key(F.col(f"c{at}"))).join(found, F.col("key") == F.col("tk"), "left_anti").select(*placed.columns).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(_seed_table(benchmark, item_id, item_text, **options))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: SeedTable = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, data, offs in text_chunks(batch.column(at)):
                for row, *_ in table.overlaps(*word_hashes(data, offs, letters_only=True)):
                    keep[first + row] = False
            yield batch.filter(pa.array(keep))

    return placed.mapInArrow(clean, placed.schema).toDF(*names)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
