"""Severity of toxic text by cumulative-link ordinal regression.

Grades 0 < 1 < 2 ... share one weight vector w over sparse features (the distinct words of a
text and their stems, the first bytes of longer words, as 64-bit hashes): P(grade <= j) = sigmoid(t_j - w.x) with ordered thresholds
t_j. The expected grade is the severity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import over_rows
from .text_hash import words_and_stems

ROWS_PER_CLASS = 1500
LEAST_TEXTS = 5
FILTER_BITS = 20
STEMS = (4, 5, 6)
STRONG = 8.0
SPARSE = 0.0001
STEPS = 3000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their stems, and the text of each; repeats included."""
    found, first = words_and_stems(texts, STEMS)
    hashes = np.concatenate(found)
    owner = np.tile(np.repeat(np.arange(len(texts)), np.diff(first)), len(found))
    there = hashes != 0
    return hashes[there], owner[there]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> Model:
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return Model(keys, weights, thresholds, seen)

    def grades(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each grade; one row per text."""
        score = np.zeros(len(texts))
        if len(self.keys):
            hashes, owner = text_features(texts)
            maybe = self.seen[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
            hashes, owner = hashes[maybe], owner[maybe]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            distinct = np.unique(owner[known] * len(self.keys) + at[known])
            score = np.bincount(distinct // len(self.keys), self.weights[distinct % len(self.keys)], minlength=len(texts))
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate((np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))), axis=1)
        return np.diff(edges, axis=1)


def _loss(p: np.ndarray, owner: np.ndarray, feature: np.ndarray, width: int, grade: np.ndarray):
    """Mean negative log-likelihood and its gradient; p holds the weights, the first threshold and the logs of the gaps."""
    n, gaps = len(grade), np.exp(p[width + 1 :])
    t = np.concatenate(([-np.inf], p[width] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
    score = np.bincount(owner, p[feature], minlength=n)
    upper = np.where(np.isinf(t[grade + 1]), 1.0, _sigmoid(t[grade + 1] - score))
    lower = np.where(np.isinf(t[grade]), 0.0, _sigmoid(t[grade] - score))
    likely = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / likely / n, lower * (1 - lower) / likely / n
    by_threshold = np.array([low[grade == j + 1].sum() - up[grade == j].sum() for j in range(len(t) - 2)])
    g = np.zeros_like(p)
    g[:width] = np.bincount(feature, (up - low)[owner], minlength=width)
    g[width] = by_threshold.sum()
    for j, gap in enumerate(gaps):
        g[width + 1 + j] = by_threshold[j + 1 :].sum() * gap
    return -np.log(likely).mean(), g


def fit(owner: np.ndarray, feature: np.ndarray, width: int, grade: np.ndarray, sparse: float = SPARSE, steps: int = STEPS):
    """Weights, mostly zero, and ordered thresholds; (owner, feature) are the ones of x.

    Accelerated proximal gradient descent on the mean log-likelihood with an absolute penalty on
    the weights; the step halves until the quadratic bound holds.
    """
    share = np.array([(grade <= j).mean() for j in range(int(grade.max()))])
    first = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    ahead, pull, step = p.copy(), 1.0, 64.0
    for _ in range(steps):
        value, g = _loss(ahead, owner, feature, width, grade)
        while True:
            new = ahead - step * g
            new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - step * sparse, 0)
            moved = new - ahead
            after, _ = _loss(new, owner, feature, width, grade)
            if after <= value + g @ moved + (moved @ moved) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        further = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        ahead = new + (pull - 1) / further * (new - p)
        p, pull = new, further
    return p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :]))))


def marks(toxic: np.ndarray, owner: np.ndarray, feature: np.ndarray, width: int) -> np.ndarray:
    """Features whose share of the toxic texts is ``STRONG`` times their share of the others."""
    in_toxic = np.bincount(feature[toxic[owner]], minlength=width) + 0.5
    in_clean = np.bincount(feature[~toxic[owner]], minlength=width) + 0.5
    return in_toxic / (toxic.sum() + 1) >= STRONG * in_clean / ((~toxic).sum() + 1)


def graded(toxic: np.ndarray, marked: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Grades from yes-or-no labels: 0 clean, 2 for the toxic texts with more marks than half of them have, else 1."""
    held = np.bincount(owner, marked[feature], minlength=len(toxic))
    grade = toxic.astype(np.int64)
    if toxic.any():
        grade[toxic & (held > np.median(held[toxic]))] = 2
    return grade


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """A model from about ``rows_per_class`` labelled texts of each label (0 or 1), chosen by a hash of the id.

    Null labels, null texts and labels without a document teach nothing. Without both kinds of
    label there is nothing to tell apart, and every text is grade 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), (F.col(label_col) != 0).alias("toxic")
    )
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    nothing = Model.of(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([60.0, 61.0]))
    if len(counts) < 2:
        return nothing
    place = F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1 << 30))
    limit = F.lit(0)
    for kind, n in counts.items():
        limit = F.when(F.col("toxic") == kind, int(min(1.0, rows_per_class / n) * (1 << 30))).otherwise(limit)
    chosen = known.where(place < limit)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.where("text is not null").join(F.broadcast(chosen), "_id").select("toxic", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(text_features([t])[0]).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "features"])

    # Copies of a text would make its own words look like marks: each set of features counts once.
    got = sorted(
        {(r.toxic, bytes(r.features)) for r in rows.mapInArrow(over_rows(work), "toxic boolean, features binary").collect()}
    )
    toxic = np.array([r[0] for r in got], dtype=bool)
    if not toxic.any() or toxic.all():
        return nothing
    sizes = np.array([len(r[1]) // 8 for r in got])
    hashes, owner = np.frombuffer(b"".join(r[1] for r in got), dtype=np.uint64), np.repeat(np.arange(len(got)), sizes)
    keys, feature, count = np.unique(hashes, return_inverse=True, return_counts=True)
    kept = count >= LEAST_TEXTS
    number = np.cumsum(kept) - 1
    use = kept[feature]
    keys, owner, feature = keys[kept], owner[use], number[feature[use]]
    marked = marks(toxic, owner, feature, len(keys))
    grade = graded(toxic, marked, owner, feature)
    if grade.max() < 2 or (grade == 1).sum() == 0:  # as many marks everywhere: one toxic grade is left
        grade = toxic.astype(np.int64)
    # Only marks are features, so that a long text is not cleared by the number of its other words.
    number, use = np.cumsum(marked) - 1, marked[feature]
    keys, owner, feature = keys[marked], owner[use], number[feature[use]]
    weights, thresholds = fit(owner, feature, len(keys), grade)
    # The sample holds more toxic texts than the labels do; the thresholds take that back.
    odds = (counts[False] / counts[True]) / ((~toxic).sum() / toxic.sum())
    thresholds = thresholds + np.log(odds)
    used = weights != 0
    return Model.of(keys[used], weights[used], thresholds)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic): one row per row of ``docs``.

    Severity is the expected grade, grade the likeliest one (the lower of equals), and toxic says
    that grades above 0 are at least as likely as grade 0. Null and empty texts have no features and get what the
    thresholds alone say. Repeated rows and null ids stay; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.grades(batch.column(1).to_pylist())
        columns = [pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] <= 0.5)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "severity", "grade", "toxic"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(over_rows(work), "doc_id long, severity double, grade int, toxic boolean")
