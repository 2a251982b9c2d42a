"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first 4 and 5 bytes of
longer words, as 64-bit hashes.  Of a bounded sample of labelled rows two kinds
of terms are kept, each in at least ``min_rows`` rows: those whose own
likelihood-ratio statistic is at least ``min_statistic``, and those in pairs that
tell something, though their terms may not.  Pairs are found by a sketch: terms
are hashed with signs into ``SKETCH`` buckets, and what the model of the single
terms leaves unexplained is summed over rows by pairs of buckets.  Terms whose
buckets are in a pair far from chance (``PAIR_DEVIATIONS``) under each of
``SKETCHES`` hashings are kept, and the model is fitted again; the second fit stays
if its F1 on rows kept out of the fit is higher by ``PAIR_GAIN``.  The sketch has one
size whatever the texts are; a pair that stands in few rows isn't seen by it.

The model scores a text by a bias, one weight a term, and the inner products of all
pairs of its terms' factor vectors, so a pair such as an insult beside a group
name can weigh more, or less, than its parts.  It is fitted by Adam on the
logistic loss with L2 decay; the cut between the classes, found on rows kept
out of the fit, is moved to a score of ``THRESHOLD``.

The sample has at most ``max_rows`` labelled documents, the ones with the least
hashes; that bounds the terms too, and so what reaches the driver and what is
sent to the executors (16 bytes and the factors for each term).  Scoring reads
every whole text once.

Defined cases: a null or empty text has no terms and gets the bias's score;
labels that are null are not learned from, of repeated labels and of the labels
of equal texts the largest counts; without labels of both classes all scores are the smoothed rate of 1;
repeated rows are scored alike; an empty table gives an empty result; columns
of the input are kept where ``score_documents`` is asked to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import U64, mix64, span_hashes, text_chunks, trim_memory, word_spans

THRESHOLD = 0.7
MAX_ROWS = 12_000
RANK = 8
PREFIXES = (4, 5)
#: Buckets of a pair sketch, sketches, and the standard deviations from chance that a pair of buckets must reach.
SKETCH, SKETCHES, PAIR_DEVIATIONS = 512, 3, 8.0
PAIR_GAIN = 0.005
_BITS = 20


def text_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) for every word and long enough word start."""
    starts, ends, rows = word_spans(data, offs, letters_only=True)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    hashes = span_hashes(data, starts, ends, *(np.minimum(ends, starts + n) for n in PREFIXES))
    rows_out, out = [row], [hashes[0]]
    for n, h in zip(PREFIXES, hashes[1:], strict=True):
        longer = ends - starts > n
        rows_out.append(row[longer])
        out.append(mix64(h[longer] ^ U64(n)))
    return np.concatenate(rows_out), np.concatenate(out)


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    #: what to add to a logit so that the sample's scores add up to its labels
    level: float = 0.0
    #: F1 at the threshold on rows kept out of the fit
    f1: float = 0.0

    def __post_init__(self):
        self._seen = np.zeros(1 << _BITS, bool)
        self._seen[(self.terms >> U64(64 - _BITS)).astype(np.int64)] = True

    def lookup(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of a kept term)."""
        near = np.flatnonzero(self._seen[(hashes >> U64(64 - _BITS)).astype(np.int64)])
        rows, hashes = rows[near], hashes[near]
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        ok = self.terms[at] == hashes if len(self.terms) else np.zeros(0, bool)
        both = np.unique(rows[ok] * len(self.terms) + at[ok])
        return (both // len(self.terms), both % len(self.terms)) if len(both) else (both, both)

    def logits(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(rows, self.weights[at], n) + self.bias
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        rows, at = self.lookup(*text_terms(data, offs))
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, at, n), -500, 500)))


def fit(terms: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, *, rank: int = RANK, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Adam on all rows at once; rows whose index is 4 modulo 5 only place the cut."""
    n, m = len(labels), len(terms)
    prior = (labels.sum() + 1) / (n + 2)
    model = FactorizationMachine(terms, float(np.log(prior / (1 - prior))), np.zeros(m), np.random.default_rng(seed).normal(0, 0.02, (m, rank)))
    if not m or not 0 < labels.sum() < n:
        return model
    learn = (np.arange(n) % 5 != 4) if n >= 200 else np.ones(n, bool)
    used = learn[rows]
    r, a = rows[used], at[used]
    # entries by row and by term, so that sums are over runs of neighbours
    by_row, by_term = np.lexsort((a, r)), np.lexsort((r, a))
    r, a, turned = r[by_row], a[by_row], r[by_term]
    row_at, term_at = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)]) for x in (r, at[used][by_term]))
    some, every = r[row_at], at[used][by_term][term_at]
    state = [np.zeros((rank + 1, m + 1)) for _ in range(2)]
    weights, factors = model.weights, np.ascontiguousarray(model.factors.T)
    for step in range(1, steps + 1):
        v = factors[:, a]
        sums, logits = np.zeros((rank, n)), np.full(n, model.bias)
        if len(a):
            sums[:, some] = np.add.reduceat(v, row_at, axis=1)
            own = weights[a] - 0.5 * np.einsum("fi,fi->i", v, v)
            logits[some] += np.add.reduceat(own, row_at) + 0.5 * (sums[:, some] ** 2).sum(axis=0)
        error = np.where(learn, 1 / (1 + np.exp(-np.clip(logits, -60, 60))) - labels, 0.0) / learn.sum()
        grad = decay * np.vstack([weights, factors])
        grad = np.hstack([grad, np.zeros((rank + 1, 1))])
        if len(a):
            pull = np.add.reduceat(error[turned], term_at)
            grad[0, every] += pull
            grad[1:, every] += np.add.reduceat((sums * error)[:, turned], term_at, axis=1) - factors[:, every] * pull
        grad[0, m] = error.sum()
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[0, :m]
        factors -= move[1:, :m]
        model.bias -= move[0, m]
    model.factors = np.ascontiguousarray(factors.T)
    held = ~learn if 0 < labels[~learn].sum() < (~learn).sum() else learn
    model.bias += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(model.logits(rows, at, n)[held], labels[held])
    logits = model.logits(rows, at, n)
    model.level = _level(logits, labels)
    found = logits >= np.log(THRESHOLD / (1 - THRESHOLD))
    model.f1 = float(2 * (found & (labels > 0))[held].sum() / max(1, found[held].sum() + labels[held].sum()))
    return model


def _level(logits: np.ndarray, labels: np.ndarray) -> float:
    """By bisection: the shift at which the scores add up to the labels."""
    low, high = -1e3, 1e3
    for _ in range(80):
        middle = (low + high) / 2
        more = (1 / (1 + np.exp(-np.clip(logits + middle, -500, 500)))).sum() > labels.sum()
        low, high = (low, middle) if more else (middle, high)
    return low


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    gap = z - np.append(z[1:], z[-1] - 1.0)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gap[best])]
    return float(z[k] - gap[k] / 2)


def _signed(hashes: np.ndarray, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of terms in a sketch."""
    h = mix64(hashes ^ mix64(np.array([sketch], U64)))
    return (h % U64(SKETCH)).astype(np.int64), 1.0 - 2.0 * (h >> U64(63)).astype(float)


def _distinct_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes = text_terms(data, offs)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])][: len(rows)]
    return rows[new], hashes[new]


def _pair_terms(rows: DataFrame, model: FactorizationMachine, min_rows: int) -> np.ndarray:
    """Hashes of the terms in pairs that tell what the model doesn't; rows(_y, text) is the sample."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)

    def sums_of(names: tuple[str, ...], make, shape: tuple[int, ...]) -> DataFrame:
        """Sums of make(y, data, offs) over the rows of four tasks, each of one size."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(shape) for _ in names]
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                for first, stop, data, offs in text_chunks(batch.column(1)):
                    make(sums, y[first:stop], data, offs)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in sums], names=list(names))
            trim_memory()

        return rows.coalesce(4).mapInArrow(run, ", ".join(f"{n} binary" for n in names))

    def sketched(k: int, r: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        bucket, sign = _signed(h, k)
        return np.bincount(r * SKETCH + bucket, sign, n * SKETCH).reshape(n, SKETCH)

    def add(sums, y, data, offs) -> None:
        r, h = _distinct_terms(data, offs)
        for k in range(SKETCHES):
            sums[0][k] += sketched(k, r, h, len(y)).sum(axis=0)

    count = rows.count()
    shape = (SKETCHES, SKETCH)
    mean = context.broadcast(sum((np.frombuffer(r.z).reshape(shape) for r in sums_of(("z",), add, shape).collect()), np.zeros(shape)) / max(count, 1))

    def pairs(sums, y, data, offs) -> None:
        n, known = len(y), shared.value
        r, h = _distinct_terms(data, offs)
        logits = known.logits(*known.lookup(r, h), n) + known.level
        error = (y - 1 / (1 + np.exp(-np.clip(logits, -500, 500))))[:, None]
        for k in range(SKETCHES):
            # about its mean, so that a word of most rows isn't a pair with every other
            z = sketched(k, r, h, n) - mean.value[k]
            sums[0][k] += (z * error).T @ z
            sums[1][k] += ((z * error) ** 2).T @ z**2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros((*shape, SKETCH)), np.zeros((*shape, SKETCH))
        for batch in batches:
            for k in range(batch.num_rows):
                one += np.frombuffer(batch.column(0)[k].as_buffer()).reshape(one.shape)
                two += np.frombuffer(batch.column(1)[k].as_buffer()).reshape(two.shape)
        far = np.abs(one) > PAIR_DEVIATIONS * np.sqrt(two)
        far[:, np.arange(SKETCH), np.arange(SKETCH)] = False
        yield pa.RecordBatch.from_arrays([pa.array([far.any(axis=2).tobytes()])], names=["heavy"])
        trim_memory()

    # four rows of one size are added up by a task, the driver gets a flag for each bucket
    flags = sums_of(("one", "two"), pairs, (*shape, SKETCH)).repartition(1).mapInArrow(judge, "heavy binary").collect()
    heavy = np.frombuffer(flags[0].heavy, bool).reshape(shape)
    if not heavy.any(axis=1).all():
        return np.zeros(0, U64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(1)):
                _, h = _distinct_terms(data, offs)
                for k in range(SKETCHES):
                    h = h[heavy[k][_signed(h, k)[0]]]
                terms, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(count)], names=["term", "n"])

    met = rows.mapInArrow(found, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    return np.array([r.term for r in met.collect()], np.int64).view(U64)


def in_training_fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = MAX_ROWS, min_rows: int = 3, min_statistic: float = 10.0) -> FactorizationMachine:
    """Fit on labelled documents outside the held-out fold."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_training_fold(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    # at most max_rows ids are broadcast
    chosen = marks.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offs in text_chunks(batch.column(1)):
                rows, hashes = text_terms(data, offs)
                order = np.lexsort((rows, hashes))
                h, r = hashes[order], rows[order]
                new = np.r_[True, h[1:] != h[:-1]][: len(h)]
                pair = new | np.r_[True, r[1:] != r[:-1]][: len(r)]
                group = np.cumsum(new)[pair] - 1
                terms = h[new]
                ones = np.bincount(group, y[first + r[pair]], len(terms)).astype(np.int64)
                every = np.bincount(group, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(ones), pa.array(every)], names=["term", "ones", "every"])
        trim_memory()

    from ..plans.durable import DurableTable

    table = DurableTable(sample.groupBy("text").agg(F.max("_y").alias("_y")).select("_y", "text"), "toxicity-sample")
    rows = table.df
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if n == 0 or n1 in (0, n):
        table.drop()
        return fit(np.zeros(0, U64), np.zeros(0, int), np.zeros(0, int), np.repeat([0, 1], [n - n1, n1]))
    seen = rows.mapInArrow(count, "term long, ones long, every long").groupBy("term").agg(F.sum("ones").alias("a"), F.sum("every").alias("k")).where(F.col("k") >= min_rows)

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    a, k = F.col("a").cast("double"), F.col("k").cast("double")
    p = float(n1) / n
    statistic = 2 * (part(a, k * p) + part(k - a, k * (1 - p)) + part(n1 - a, (n - k) * p) + part(n - k - n1 + a, (n - k) * (1 - p)))
    kept = seen.where(F.col("k") < n).withColumn("g", statistic).where(F.col("g") >= min_statistic).select("term").collect()
    terms = np.sort(np.array([r.term for r in kept], np.int64).view(U64))
    model = _fitted(rows, terms)
    more = np.union1d(terms, _pair_terms(rows, model, min_rows))
    if len(more) > len(terms):
        wider = _fitted(rows, more)
        model = wider if wider.f1 >= model.f1 + PAIR_GAIN else model
    table.drop()
    return model


def _fitted(rows: DataFrame, terms: np.ndarray) -> FactorizationMachine:
    """The model of some terms, from rows(_y, text)."""
    finder = FactorizationMachine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 0)))
    shared = rows.sparkSession.sparkContext.broadcast(finder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for first, _, data, offs in text_chunks(batch.column(1)):
                for row, at in zip(*(x.tolist() for x in shared.value.lookup(*text_terms(data, offs))), strict=True):
                    found[first + row].append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(f, ">i4").tobytes() for f in found], pa.binary())], names=["y", "at"])

    # at most max_rows rows of small numbers; big-endian, so that bytes are in the order of the numbers
    coded = sorted((r.y, bytes(r.at)) for r in rows.mapInArrow(encode, "y int, at binary").collect())
    shared.unpersist()
    order = np.random.default_rng(3).permutation(len(coded))
    coded = [coded[i] for i in order]
    at = np.frombuffer(b"".join(ts for _, ts in coded), ">i4").astype(np.int64)
    row = np.repeat(np.arange(len(coded)), [len(ts) // 4 for _, ts in coded])
    model = fit(terms, row, at, np.array([y for y, _ in coded], float))
    trim_memory()
    return model


def score_documents(docs: DataFrame, model: FactorizationMachine, *, text: str = "text") -> DataFrame:
    """docs with ``score``; a column of that name is replaced."""
    docs = docs.drop("score")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(data, offs) for _, _, data, offs in text_chunks(batch.column(at))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
        trim_memory()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
