"""Ordinal quality classifier on hashed words.

Cumulative-link (proportional odds) regression: one weight vector over hashed
words and text statistics is shared by all grades; ordered thresholds cut its
score. P(grade <= k) = sigmoid(threshold_k - score), which gives the expected
grade and the tail probability used for selection.

Training reads a bounded sample of labelled documents (``SAMPLE_ROWS``, the
smallest hashes of doc_id, whatever the input's size); a fifth of it is held
out and sets the cutoff. Every document is read whole, those of the sample too:
executors make their features, and the driver collects only these.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import lean, relieve_driver, text_or_empty, workers

#: Labelled documents read for fitting.
SAMPLE_ROWS = 6000
BITS = 18
EXTRA = 8
WORD = re.compile(r"[^\W\d_]+|[\d]+|[^\w\s]+")
GRADES = 3
#: A statistic counts once more for each of these that it reaches.
STEPS = np.array([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6])
#: Buckets in fewer sampled documents get no weight.
MIN_DOCUMENTS = 5


#: Words a worker keeps the buckets of.
CACHE_WORDS = 1 << 16


class _Buckets(dict):
    """Hash buckets of a word and of its first 4 and 6 letters, side by side in one number; bounded."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        parts = word, f"4:{word[:4]}", f"6:{word[:6]}"
        v = 0
        for k, x in enumerate(parts):
            v |= (zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)) << (BITS * k)
        self[word] = v
        return v


_BUCKETS = _Buckets()


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words that occur, their weights, and dense statistics."""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float64), np.array([1.0] + [0.0] * (EXTRA - 1))
    lower = text.lower()
    lower = words if lower == text else WORD.findall(lower)
    packed = np.fromiter(map(_BUCKETS.__getitem__, lower), np.int64, len(lower))
    b = packed & ((1 << BITS) - 1)
    kinds = [np.unique((packed >> (BITS * k)) & ((1 << BITS) - 1), return_counts=True) for k in range(3)]
    at, counts = (np.concatenate([k[j] for k in kinds]) for j in (0, 1))
    upper = sum(map(str.isupper, words)) / n
    marks = sum(not w[0].isalnum() for w in words) / n
    repeats = 1 - len(kinds[0][0]) / n
    same = float(((b[2:] == b[:-2]) | (b[1:-1] == b[:-2])).mean()) if len(b) > 2 else 0.0
    lines = text.split("\n")
    dup_lines = 1 - len(set(lines)) / len(lines)
    share = float(kinds[0][1].max()) / len(b) if len(b) else 0.0
    stats = (upper, marks, repeats * min(1.0, 50 / n), same, dup_lines, share)
    bins = [zlib.crc32(b"%d:%d" % (j, k)) & ((1 << BITS) - 1) for j, x in enumerate(stats) for k in range(int(np.searchsorted(STEPS, x, "right")))]
    dense = np.array([1.0, np.log1p(n) / 8, *stats])
    return np.concatenate([at, np.array(bins, np.int64)]), np.concatenate([1 + np.log(counts), np.full(len(bins), 3.0)]), dense


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    def __init__(self, weights, dense, thresholds, cutoff=0.5):
        self.weights, self.dense, self.thresholds, self.cutoff = weights, dense, thresholds, cutoff

    def score(self, text: str) -> float:
        return self.score_of(*features(text))

    def score_of(self, at, v, d) -> float:
        return float(self.weights[at] @ v + self.dense @ d)

    def probabilities(self, score):
        """P(grade > k) for each threshold, along the last axis."""
        return sigmoid(np.asarray(score)[..., None] - self.thresholds)


def fit(texts, grades, grade_weights=None, epochs: int = 20, rate: float = 0.1, decay: float = 2e-5, seed: int = 3, sparsity: float = 0.1) -> OrdinalModel:
    """``fit_features`` of whole texts."""
    return fit_features([features(t) for t in texts], grades, grade_weights, epochs, rate, decay, seed, sparsity)


def fit_features(rows, grades, grade_weights=None, epochs: int = 20, rate: float = 0.1, decay: float = 2e-5, seed: int = 3, sparsity: float = 0.1) -> OrdinalModel:
    """AdaGrad on the cumulative-link likelihood; a threshold never falls below the one before it (running maximum).

    ``sparsity``: an L1 penalty, taken off after each step, so that the many
    words that say nothing get no weight and do not add up in long texts.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(grades, dtype=np.int64)
    seen = np.zeros(1 << BITS, np.int64)
    for at, _, _ in rows:
        seen[np.unique(at)] += 1
    rows = [(at[common], v[common], d) for at, v, d in rows for common in [seen[at] >= MIN_DOCUMENTS]]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    dense, d2 = np.zeros(EXTRA), np.full(EXTRA, 1e-3)
    theta, t2 = np.linspace(-1.0, 1.0, GRADES - 1), np.full(GRADES - 1, 1e-3)
    balance = np.ones(GRADES) if grade_weights is None else np.asarray(grade_weights)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, d = rows[i]
            score = w[at] @ v + dense @ d
            c = np.concatenate([[0.0], sigmoid(theta - score), [1.0]])  # P(grade <= k - 1)
            k = y[i]
            slope = c * (1 - c)
            p = max(c[k + 1] - c[k], 1e-9)
            weight = balance[k]
            g = weight * (slope[k + 1] - slope[k]) / p  # of -log p by score
            gw = g * v + decay * w[at]
            g2[at] += gw * gw
            pace = rate / np.sqrt(g2[at])
            new = w[at] - pace * gw
            w[at] = np.sign(new) * np.maximum(np.abs(new) - pace * sparsity, 0.0)
            gd = g * d
            d2 += gd * gd
            dense -= rate * gd / np.sqrt(d2)
            gt = np.zeros(GRADES - 1)
            if k < GRADES - 1:
                gt[k] -= weight * slope[k + 1] / p
            if k > 0:
                gt[k - 1] += weight * slope[k] / p
            t2 += gt * gt
            theta = np.maximum.accumulate(theta - rate * gt / np.sqrt(t2))
    return OrdinalModel(w, dense, theta)


def graded(labels: DataFrame) -> DataFrame:
    """Grade 0: toxic; 1: poor; 2: good. Null labels and repeated rows of a document: the worst counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


FEATURES = "doc_id long, grade int, buckets binary, weights binary, dense binary"


def sampled(docs: DataFrame, few: DataFrame) -> list:
    """(doc_id, grade, features of the whole text) of the documents in ``few``, in an order of their own.

    One row per doc_id, however often its row is repeated: of different texts
    the one with the least features, byte by byte.
    """
    workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(2)]
            cols = [pa.array([x[k].astype(kind).tobytes() for x in made], pa.binary()) for k, kind in enumerate(("<i4", "<f8", "<f8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["doc_id", "grade", "buckets", "weights", "dense"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    made = texts.select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text").mapInArrow(lean(run), FEATURES)
    least = F.min(F.struct("buckets", "weights", "dense", "grade")).alias("x")
    rows = made.groupBy("doc_id").agg(least).select("doc_id", "x.grade", "x.buckets", "x.weights", "x.dense").collect()  # at most sample_rows
    relieve_driver(docs.sparkSession, now=True)  # of what the rows passed through
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [(r.doc_id, r.grade, tuple(np.frombuffer(x, kind) for x, kind in zip(r[2:], ("<i4", "<f8", "<f8")))) for r in rows]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_good: float = 0.985) -> OrdinalModel:
    """Fits on the sample's larger part; the cutoff on P(grade = best) keeps ``keep_good`` of the held-out good ones.

    Without a label of at least two grades nothing is learnt and all documents stay.
    """
    few = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = sampled(docs, few)
    grades = np.array([g for _, g, _ in rows], dtype=np.int64)
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(1 << BITS), np.zeros(EXTRA), np.linspace(-1, 1, GRADES - 1), cutoff=-1.0)
    held = np.arange(len(rows)) % 5 == 0
    n = np.bincount(grades[~held], minlength=GRADES)
    balance = np.sqrt(n.max() / np.maximum(n, 1))
    model = fit_features([x for (_, _, x), h in zip(rows, held) if not h], grades[~held], balance)
    tail = np.array([model.probabilities(model.score_of(*x))[-1] for (_, g, x), h in zip(rows, held) if h and g == GRADES - 1])
    model.cutoff = min(0.5, float(np.quantile(tail, 1 - keep_good))) if len(tail) >= 20 else 0.5
    del rows
    relieve_driver(docs.sparkSession, now=True)
    return model


SCORED = "score double, expected_grade double, p_poor_or_better double, p_good double, kept boolean"


def scored(docs: DataFrame, model: OrdinalModel, carry: tuple[str, ...] = ("doc_id",), text_column: bool = False) -> DataFrame:
    """``carry`` columns and the model's verdict for every document; null text counts as empty."""
    spark = docs.sparkSession
    workers(spark)
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.dense, model.thresholds, model.cutoff))  # 2**BITS weights
    keep = [docs.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), SCORED])
    at = carry.index("text") if text_column else len(keep)

    def run(batches):
        w, dense, theta, cutoff = shared.value
        m = OrdinalModel(w, dense, theta, cutoff)
        for batch in batches:
            s = np.array([m.score(t.as_py() or "") for t in batch.column(at)], dtype=np.float64)
            p = m.probabilities(s)
            cols = [s, p.sum(axis=1), p[:, 0], p[:, -1], p[:, -1] >= cutoff]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, cols)], [*(f.name for f in keep), "score", "expected_grade", "p_poor_or_better", "p_good", "kept"])

    columns = [F.col(f.name) for f in keep] + ([] if text_column else [text_or_empty().alias("_text")])
    return docs.select(*columns).mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Trains and scores every row of ``docs``, repeated ones alike.

    Null text counts as empty, and a null doc_id is scored like any other.
    Empty tables give an empty result; ties with the cutoff are kept. Columns
    of ``docs`` beyond doc_id, text and ``carry`` are ignored.
    """
    return scored(docs, train(docs, labels), carry)
