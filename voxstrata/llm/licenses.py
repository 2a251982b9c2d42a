"""Licence scans by a trained paragraph classifier.

A paragraph ends at a blank line.  It is read line by line, and one of several
lines once more as a whole, so that a wrapped notice is in a window; what has
more than ``WINDOW`` words is read in windows of that many words, half
overlapping.  A finding across lines counts if it is confirmed and no line in it
has its family; it replaces a line's finding if that line speaks as much for its
family as for the line's own.

The templates are short notices, standard file headers and paragraphs of the
licences themselves (``license_texts``), cut to windows as texts are.  A window's
features are the word 1- to 3-grams that occur in templates.  Multinomial
logistic regression over the licence families and one class "unknown" is fitted
on noisy variants of the templates (words dropped, parts cut off, foreign words
around them), on scrambled ones as "unknown", and on windows of a bounded sample
of the corpus as "unknown".  A temperature fitted on variants kept out of the
training calibrates the probabilities; ``calibration`` measures what is left.

A predicted family is confirmed if the window holds at least ``MIN_SIMILARITY``
of the word bigrams of one of the family's templates, unless a template of
another family has all of these bigrams too: the words that two versions share
confirm neither.  (A template that is there as a whole is confirmed unless
another family's is as well.)  A bare reservation of rights within ``NEAR`` words of
another confirmed family is part of that notice and isn't confirmed itself.

The sample has at most ``SAMPLE_DOCS`` distinct texts and ``SAMPLE_WINDOWS``
windows of each, the ones with the least hashes; every paragraph of every
document is classified.

Defined cases: null and empty texts have no paragraphs and no licence; repeated
rows are scanned alike; very long texts are scanned whole; of families that are
equally probable the first by name counts; an empty table gives an empty result;
null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES, PARAGRAPHS
from .textkernel import _SPACE, U64, mix64, ngram_hashes, span_hashes, text_chunks, word_spans

WINDOW = 40
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
SAMPLE_DOCS = 2_000
SAMPLE_WINDOWS = 4
#: Words between a reservation of rights and the licence that it belongs to.
NEAR = 60
#: Tasks that the sample is read in.
SAMPLE_TASKS = 16
_BITS = 20

FAMILIES = (*NOTICES, "unknown")


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offs in text_chunks(pa.array(texts, pa.string())):
        starts, ends, rows = word_spans(data, offs, letters_only=True)
        h = span_hashes(data, starts, ends)
        out.extend(h[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True))
    return out


def templates() -> list[tuple[int, np.ndarray]]:
    """(family, word hashes) of every template, in windows."""
    out = []
    for family, name in enumerate(NOTICES):
        for words in _words([*NOTICES[name], *PARAGRAPHS.get(name, ())]):
            starts = range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if len(words) > WINDOW else (0,)
            out.extend((family, words[a : a + WINDOW]) for a in starts)
    return out


def _grams(words: np.ndarray) -> list[np.ndarray]:
    return [ngram_hashes(words, k) for k in (1, 2, 3)]


@dataclass
class LicenseModel:
    terms: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # (terms, families)
    bias: np.ndarray
    temperature: float
    family: np.ndarray  # of each template, ascending
    bigrams: np.ndarray  # sorted hashes
    held: np.ndarray  # (bigrams, templates): whether the template has the bigram

    def __post_init__(self):
        self.sizes = self.held.sum(axis=0)
        self._seen = np.zeros(1 << _BITS, bool)
        self._seen[(self.terms >> U64(64 - _BITS)).astype(np.int64)] = True

    def windows(self, data: np.ndarray, offs: np.ndarray, wrapped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, and for each window its row, first word and end; if wrapped, the windows that cross a newline."""
        starts, ends, rows = word_spans(data, offs, letters_only=True)
        words = span_hashes(data, starts, ends)
        breaks = lines = np.flatnonzero(data == 10)
        if wrapped:
            marks = np.concatenate([[0], np.cumsum(~_SPACE[data])])
            breaks = lines[1:][marks[lines[1:]] == marks[lines[:-1]]]
        cuts = np.unique(np.concatenate([rows, np.searchsorted(starts, breaks)]))
        a, b = cuts[:-1], cuts[1:]
        half = WINDOW // 2
        n = np.where(b - a <= WINDOW, 1, -(-(b - a - WINDOW) // half) + 1)
        first = np.repeat(a, n) + half * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        last = np.minimum(first + WINDOW, np.repeat(b, n))
        if wrapped:
            inner = np.searchsorted(starts, lines)
            crosses = np.searchsorted(inner, first, "right") < np.searchsorted(inner, last, "left")
            first, last = first[crosses], last[crosses]
        return words, np.searchsorted(rows, first, "right") - 1, first, last

    def features(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, term) pairs."""
        windows, terms = [], []
        for k, grams in enumerate(_grams(words), 1):
            p = np.flatnonzero(self._seen[(grams >> U64(64 - _BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, grams[p]), len(self.terms) - 1)
            p, at = p[self.terms[at] == grams[p]], at[self.terms[at] == grams[p]]
            # windows that hold the gram: those that start at or before it and end behind it
            lo, hi = np.searchsorted(last, p + k, "left"), np.searchsorted(first, p, "right")
            n = np.maximum(hi - lo, 0)
            windows.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            terms.append(np.repeat(at, n))
        both = np.unique(np.concatenate(windows) * len(self.terms) + np.concatenate(terms))
        return both // len(self.terms), both % len(self.terms)

    def probabilities(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        z = np.stack([np.bincount(window, self.weights[term, f], n) for f in range(len(self.bias))], axis=1) + self.bias
        z /= self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _matched(self, words: np.ndarray) -> np.ndarray:
        """The bigrams of the words that a template has, by template."""
        have = np.unique(ngram_hashes(words, 2))
        at = np.minimum(np.searchsorted(self.bigrams, have), len(self.bigrams) - 1)
        return self.held[at[self.bigrams[at] == have]]

    def similarity(self, words: np.ndarray, family: int) -> float:
        return self.evidence(words, family)[0]

    def nearest(self, words: np.ndarray) -> float:
        return float((self._matched(words).sum(axis=0) / self.sizes).max())

    def evidence(self, words: np.ndarray, family: int) -> tuple[float, bool]:
        """The similarity of the family's nearest template, and whether it speaks for this family alone."""
        if family >= len(FAMILIES) - 1:
            return 0.0, False
        matched = self._matched(words)
        share = matched.sum(axis=0) / self.sizes
        mine = np.flatnonzero(self.family == family)
        best = mine[np.argmax(share[mine])]
        others = np.flatnonzero(self.family != family)
        same = others[matched[matched[:, best]][:, others].all(axis=0)]
        # a template that is there as a whole yields only to another one
        same = same if share[best] < 1 else same[share[same] >= 1]
        return float(share[best]), not len(same)

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, float, float, bool]]:
        """(row, first word in row, words, family, probability, similarity, confirmed) of windows of a known family, in text order."""
        found = list(self._scan(data, offs, False))
        across = [f for f in self._scan(data, offs, True) if f[6]]
        by_row: dict[int, list] = {}
        for f in found:
            by_row.setdefault(f[0], []).append(f)
        if across:
            starts, ends, rows = word_spans(data, offs, letters_only=True)
            words = span_hashes(data, starts, ends)
        for f in across:
            row, a, n, family = f[:4]
            mine = by_row.setdefault(row, [])
            inside = [x for x in mine if x[1] < a + n and a < x[1] + x[2]]
            if any(x[3] == family and x[6] for x in inside):
                continue
            for x in inside:
                line = words[rows[row] + x[1] : rows[row] + x[1] + x[2]]
                if x[5] < f[5] and self.similarity(line, family) >= x[5]:
                    mine.remove(x)
            mine.append(f)
        reserved = FAMILIES.index("proprietary")
        for row in sorted(by_row):
            mine = sorted(by_row[row], key=lambda f: f[1:3])
            granted = [x for x in mine if x[6] and x[3] != reserved]
            for x in mine:
                beside = x[3] == reserved and any(g[1] - NEAR <= x[1] + x[2] and x[1] <= g[1] + g[2] + NEAR for g in granted)
                yield (*x[:6], x[6] and not beside)

    def _scan(self, data: np.ndarray, offs: np.ndarray, wrapped: bool) -> Iterator[tuple[int, int, int, int, float, float, bool]]:
        words, row, first, last = self.windows(data, offs, wrapped)
        if not len(first):
            return
        window, term = self.features(words, first, last)
        used, window = np.unique(window, return_inverse=True)
        if not len(used):
            return
        p = self.probabilities(window, term, len(used))
        best = p.argmax(axis=1)
        begin = word_spans(data, offs, letters_only=True)[2]
        for i in np.flatnonzero((best < len(FAMILIES) - 1) & (p.max(axis=1) >= MIN_PROBABILITY)).tolist():
            w = used[i]
            similar, alone = self.evidence(words[first[w] : last[w]], int(best[i]))
            yield int(row[w]), int(first[w] - begin[row[w]]), int(last[w] - first[w]), int(best[i]), float(p[i, best[i]]), similar, alone and similar >= MIN_SIMILARITY


def _untrained() -> LicenseModel:
    every = templates()
    terms = np.unique(np.concatenate([g for _, w in every for g in _grams(w)]))
    pairs = [np.unique(ngram_hashes(w, 2)) for _, w in every]
    bigrams = np.unique(np.concatenate(pairs))
    held = np.stack([np.isin(bigrams, p, assume_unique=True) for p in pairs], axis=1)
    return LicenseModel(terms, np.zeros((len(terms), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, np.array([f for f, _ in every]), bigrams, held)


def _softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4):
    w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    state = [np.zeros((x.shape[1] + 1, len(FAMILIES)), np.float32) for _ in range(2)]
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * weight[:, None]
        grad = np.vstack([x.T @ error + decay * w, error.sum(axis=0)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def variants(count: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(template, family, words): noisy variants of every template, each with a scrambled one of the class unknown."""
    rng = np.random.default_rng(seed)
    every = templates()
    pool = np.concatenate([w for _, w in every])
    for i, (family, words) in enumerate(every):
        for v in range(count):
            keep = words if v == 0 or len(words) < 4 else words[rng.random(len(words)) > 0.05 * (v % 4)]
            if v % 3 == 2 and len(keep) >= 16:
                cut = int(rng.integers(0, len(keep) // 3))
                keep = keep[cut:] if v % 2 else keep[: len(keep) - cut]
            room = max(0, min(8, WINDOW - len(keep)))
            noise = mix64(rng.integers(0, 2**63, rng.integers(0, room + 1)).astype(np.uint64))
            cut = int(rng.integers(0, len(noise) + 1))
            yield i, family, np.concatenate([noise[:cut], keep, noise[cut:]])
            # the same words out of order, or mixed with others', are no notice
            mixed = np.concatenate([words[rng.random(len(words)) < 0.5], rng.choice(pool, 3)]) if v % 2 else words
            yield i, len(FAMILIES) - 1, rng.permutation(mixed)


def calibration(model: LicenseModel, count: int = 6, seed: int = 99, bins: int = 10) -> tuple[float, float]:
    """(expected calibration error, accuracy) on fresh variants of the templates."""
    made = list(variants(count, seed))
    rows = [np.unique(model.features(w, np.array([0]), np.array([len(w)]))[1]) for _, _, w in made]
    p = model.probabilities(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), len(rows))
    top, right = p.max(axis=1), p.argmax(axis=1) == np.array([f for _, f, _ in made])
    cell = np.minimum((top * bins).astype(int), bins - 1)
    n, hit, sure = (np.bincount(cell, w, bins) for w in (None, right, top))
    return float(np.abs(hit - sure).sum() / n.sum()), float(right.mean())


def fit(corpus_windows: list[np.ndarray], count: int = 12, seed: int = 5) -> LicenseModel:
    """corpus_windows: term indices of windows of the corpus that hold no notice."""
    model = _untrained()
    made = list(variants(count, seed))
    rows = [np.unique(model.features(w, np.array([0]), np.array([len(w)]))[1]) for _, _, w in made]
    y = [f for _, f, _ in made]
    # windows of the corpus with the same terms are one row of their number's weight
    alike: dict[bytes, int] = {}
    for terms in corpus_windows:
        alike[terms.tobytes()] = alike.get(terms.tobytes(), 0) + 1
    rows.extend(np.frombuffer(k, np.int64) for k in alike)
    y = np.array(y + [len(FAMILIES) - 1] * len(alike))
    times = np.array([1.0] * len(made) + list(alike.values()))
    x = np.zeros((len(rows), len(model.terms)), np.float32)
    for i, terms in enumerate(rows):
        x[i, terms] = 1
    learn = np.arange(len(rows)) % 8 < 6  # a variant and its scrambled form stay together
    share = np.bincount(y[learn], times[learn], minlength=len(FAMILIES))
    weight = times * (1 / np.maximum(share, 1))[y] * np.where(y == len(FAMILIES) - 1, 4.0, 1.0)
    model.weights, model.bias = _softmax_fit(x[learn], y[learn], (weight[learn] / weight[learn].sum()).astype(np.float32))
    z = x[~learn] @ model.weights + model.bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.average(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[~learn]], weights=times[~learn]))

    model.temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
    return model


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> LicenseModel:
    blank = docs.sparkSession.sparkContext.broadcast(_untrained())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LicenseModel = blank.value
        for batch in batches:
            out = []
            for _, _, data, offs in text_chunks(batch.column(0)):
                words, row, first, last = model.windows(data, offs)
                window, term = model.features(words, first, last)
                chosen: dict[int, int] = {}
                ends = np.searchsorted(window, np.arange(len(first) + 1))
                for w in np.argsort(words[first] ^ words[last - 1], kind="stable").tolist() if len(first) else ():
                    if chosen.get(row[w], 0) < SAMPLE_WINDOWS:
                        mine = term[ends[w] : ends[w + 1]]
                        if not len(mine) or model.nearest(words[first[w] : last[w]]) < 0.4:
                            chosen[row[w]] = chosen.get(row[w], 0) + 1
                            out.append(mine.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["terms"])

    # distinct texts; a cut of the hashes first, so that hardly more than the sample's are brought together
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit(3), text).alias("h")).where("text IS NOT NULL")
    n = texts.agg(F.approx_count_distinct("h")).first()[0]
    cut = int(-(2**63) + 2**64 * min(1.0, 2.0 * sample_docs / max(n, 1))) - 1
    few = texts.where(F.col("h") <= F.lit(min(cut, 2**63 - 1))).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(sample_docs).select("text")
    rows = few.repartition(SAMPLE_TASKS).mapInArrow(sample, "terms array<int>").collect()
    return fit(sorted((np.array(r.terms, np.int64) for r in rows), key=lambda t: t.tobytes()))


def scan_documents(docs: DataFrame, model: LicenseModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_windows and findings of each document, in text order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    finding = pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LicenseModel = shared.value
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            counts = []
            for begin, _, data, offs in text_chunks(batch.column(1)):
                counts.append(sum(np.bincount(model.windows(data, offs, wrapped)[1], minlength=len(offs) - 1) for wrapped in (False, True)))
                for row, word, n, family, p, similar, confirmed in model.scan(data, offs):
                    found[begin + row].append({"word": word, "n_words": n, "family": FAMILIES[family], "probability": p, "similarity": similar, "confirmed": confirmed})
            n_windows = np.concatenate(counts) if counts else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_windows, pa.int64()), pa.array(found, pa.list_(finding))], names=["doc_id", "n_windows", "findings"])

    return narrow.mapInArrow(run, f"doc_id {kind}, n_windows long, findings array<struct<word:long,n_words:long,family:string,probability:double,similarity:double,confirmed:boolean>>")


def op6_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = scan_documents(docs, train(docs))
    sure = F.filter("findings", lambda f: f["confirmed"])
    # the most probable one, of equal ones the first by name
    best = F.element_at(F.array_sort(F.transform(sure, lambda f: F.struct((-f["probability"]).alias("minus"), f["family"].alias("family"), f["probability"].alias("probability")))), 1)
    return scanned.select("doc_id", "n_windows", F.size("findings").alias("n_findings"), F.size(sure).alias("n_confirmed"), F.array_distinct(F.transform(sure, lambda f: f["family"])).alias("families"), F.when(F.size(sure) > 0, best["family"]).alias("license"), F.when(F.size(sure) > 0, best["probability"]).alias("probability"))
