"""Operator 2, toxicity: a linear classifier on character n-grams scaled by naive Bayes.

A text is its set of character 4- to 6-grams (lower case, anything but letters
and digits as one space), hashed into a fixed number of cells. How many toxic
and clean labelled texts hold a cell is counted over a bounded sample of the
training rows; the log of the ratio of the two shares scales the cell. A
logistic regression on the scaled cells is fitted on a smaller sample. Its scale
and threshold come from rows left out of fits and counts in turn, weighted to the
base rate of all training rows.

Defined results: null and empty texts have no n-gram and score the base rate.
Without training rows of both labels every text scores the base rate (0.5 if
there is none). Rows are scored one by one, so repeated rows repeat results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import base_counts, batches_of, bounded_sample, fold_of, mapped, pick, stored, training_labels

BITS = 20
CELLS = 1 << BITS
ORDERS = (4, 5, 6)
CHUNK = 1 << 16
SLICES = 64
#: Rows of each label for the counts and for the regression, and the longest text among them.
COUNT_ROWS = 10_000
TRAIN_ROWS = 1500
TRAIN_CHARS = 20_000
#: Texts that must hold a cell, the likelihood ratio that its shares must reach (chance does once in some 10,000 cells), tasks that count, and parts of the sample of which each is left out once.
LEAST_TEXTS, LEAST_SURPRISE = 3, 15.0
COUNT_TASKS = 8
PARTS = 4

_MULT = np.uint32(0x9E3779B1)
_ASCII = np.full(128, 32, np.uint32)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _ASCII[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ASCII[_c] = _c + 32


def letters(text: str) -> np.ndarray:
    """Code points of the normalised text, one space at each end and between words."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(raw < 128, _ASCII[np.minimum(raw, 127)], np.where((raw >= 0x2000) & (raw < 0x2070), np.uint32(32), raw))
    space = low == 32
    return low[~(space & np.concatenate([[False], space[:-1]]))]


def cells(points: np.ndarray) -> np.ndarray:
    """Cell of each n-gram of each order, repeats included."""
    out = []
    n = len(points)
    with np.errstate(over="ignore"):
        value = points * _MULT
        for size in range(2, ORDERS[-1] + 1):
            if n < size:
                break
            value = (value[: n - size + 1] ^ (value[: n - size + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[size - 1 :] * _MULT
            if size in ORDERS:
                h = value ^ (value >> np.uint32(13))
                out.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Features:
    """Distinct cells of a text. Texts of any length are read in pieces of bounded size."""

    def __init__(self) -> None:
        self.stamp = np.zeros(CELLS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        points = letters(text)
        if len(points) <= CHUNK:
            found = cells(points)
            order = np.arange(len(found), dtype=np.int32)
            self.stamp[found] = order
            return found[self.stamp[found] == order]
        seen = np.zeros(CELLS, bool)
        for start in range(0, len(points), CHUNK):
            seen[cells(points[start : start + CHUNK + ORDERS[-1] - 1])] = True
        return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> float:
        total = self.intercept + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log of the ratio of the two classes' shares of texts with each cell; 0 where chance explains the difference.

    With few texts most cells differ by chance alone, and a text has thousands of
    them. The test is the likelihood ratio of one share against two.
    """
    ratio = np.log((positive + 1) / (n1 + 2)) - np.log((negative + 1) / (n0 + 2))
    both = (positive + negative) / max(1, n1 + n0)
    surprise = np.zeros(len(ratio))
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, n, share in ((positive, n1, both), (negative, n0, both), (n1 - positive, n1, 1 - both), (n0 - negative, n0, 1 - both)):
            surprise += np.where(seen > 0, 2 * seen * np.log(seen / np.maximum(n * share, 1e-300)), 0.0)
    return np.where((positive + negative >= LEAST_TEXTS) & (surprise >= LEAST_SURPRISE), ratio, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 60, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on cells times ratios, by accelerated gradient steps; weights come back scaled."""
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    scale = ratios[used]
    ends = np.cumsum([len(r) for r in rows])
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.diff(np.concatenate([[0], ends]))
    y = labels.astype(np.float64)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        value = w * scale
        margin = np.array([s.sum() for s in np.split(value[flat], ends[:-1])]) if (sizes == 0).any() else np.add.reduceat(value[flat], starts)
        p = 1 / (1 + np.exp(-np.clip(margin + b, -500, 500)))
        g = (p - y) * balance
        grad = np.append(np.bincount(flat, np.repeat(g, sizes), len(used)) * scale + penalty * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(CELLS, np.float32)
    out[used] = w * scale
    return out, float(b)


def margins(rows: list[np.ndarray], weights: np.ndarray, b: float) -> np.ndarray:
    return np.array([b + float(weights[r].sum(dtype=np.float64)) for r in rows])


def calibrated(values: np.ndarray, labels: np.ndarray, n1: int, n0: int) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on margins of rows that were not fitted, at the base rate of all training rows.

    Labels are smoothed as if one more row of each class had been seen, so that
    margins that part the classes give a finite slope.
    """
    y = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    weight = np.where(labels == 1, n1 / max(1, labels.sum()), n0 / max(1, (1 - labels).sum()))
    weight = weight / weight.mean()
    slope, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * values + b, -500, 500)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * values * values).sum() + 1e-6, (h * values).sum()], [(h * values).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hessian, [(g * values).sum(), g.sum()])
        move = move / max(1.0, np.abs(move).max())
        slope, b = slope - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(max(slope, 1e-3)), float(b)


def learned(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, float]:
    """Weights and intercept: a fit on all rows, its scale and threshold from fits that leave a part of the rows out.

    Of a part that is left out the counts are taken back as well, so its margins
    are those of texts never seen.
    """
    part = np.zeros(len(labels), np.int64)
    for value in (0, 1):
        own = np.flatnonzero(labels == value)
        part[own] = np.arange(len(own)) % PARTS
    values = np.zeros(len(labels))
    for k in range(PARTS):
        out, held = part == k, counts.copy()
        less = np.array([(labels[out] == value).sum() for value in (0, 1)])
        for r, label in zip(np.flatnonzero(out), labels[out], strict=True):
            held[label, rows[r]] -= 1
        weights, b = fitted([r for r, o in zip(rows, out, strict=True) if not o], labels[~out], log_count_ratios(held[1], held[0], *(sizes - less)[::-1]))
        values[out] = margins([r for r, o in zip(rows, out, strict=True) if o], weights, b)
    slope, shift = calibrated(values, labels, n1, n0)
    weights, b = fitted(rows, labels, log_count_ratios(counts[1], counts[0], sizes[1], sizes[0]))
    return (weights * slope).astype(np.float32), slope * b + shift


def fitted(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    known = [r[ratios[r] != 0] for r in rows]
    if not 0 < labels.sum() < len(labels) or not sum(map(len, known)):
        return np.zeros(CELLS, np.float32), 0.0
    return fit(known, labels, ratios)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros((2, CELLS), np.int64)
    for batch, texts in batches_of("text", batches):
        for label, text in zip(batch.column("label").to_pylist(), texts, strict=True):
            counts[int(label > 0), features(text)] += 1
    width = CELLS // SLICES
    yield pa.RecordBatch.from_pydict({
        "slice": pa.array(range(SLICES), pa.int32()),
        "counts": pa.array([counts[:, k * width : (k + 1) * width].tobytes() for k in range(SLICES)], pa.binary()),
    })


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"slice": group.column("slice")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", count_rows: int = COUNT_ROWS, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS,
) -> Model:
    """Counts over a bounded sample, then a regression on its first rows, in one task.

    The sample is written once and counted by a fixed number of tasks. What
    reaches the driver has a fixed size: two counts per cell and one weight.
    """
    known = stored(training_labels(labels, target))
    n0, n1 = base_counts(known)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model(np.zeros(CELLS, np.float32), prior)
    drawn = stored(bounded_sample(docs, known, count_rows, target, train_chars))
    sizes = np.array(base_counts(drawn))
    counted = mapped(drawn.select("text", "label").coalesce(COUNT_TASKS), _count, "slice int, counts binary")
    counted = counted.groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    counts = np.concatenate(
        [np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in sorted(counted.collect(), key=lambda r: r.slice)], axis=1
    )
    # The rows of the regression are among the counted ones: those that come first by the same key.
    least = [known.where(F.col("label") == v).select(F.xxhash64(F.lit(target), "doc_id").alias("key"), "doc_id").orderBy("key", "doc_id").limit(train_rows) for v in (0, 1)]
    first = F.broadcast(least[0].unionByName(least[1]).select("doc_id"))
    sample = drawn.join(first, "doc_id", "left_semi").select("doc_id", "text", "label").coalesce(1).sortWithinPartitions("label", "doc_id", "text")

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows, marks = Features(), [], []
        for batch, texts in batches_of("text", batches):
            marks += batch.column("label").to_pylist()
            rows += [features(text) for text in texts]
        weights, b = learned(rows, np.array(marks, np.int64), counts, sizes, n1, n0) if 0 < sum(marks) < len(marks) else (np.zeros(CELLS, np.float32), prior)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "b": pa.array([b])})

    found = mapped(sample, regress, "weights binary, b double").first()
    return Model(np.frombuffer(found.weights, np.float32), found.b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), shared.value
        for batch, texts in batches_of("text", batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fitted.score(features(t)) for t in texts], pa.float64())], ["doc_id", "score"]
            )

    rows = pick(docs, doc_id="doc_id", text="text")
    return mapped(rows, run, rows.select("doc_id").schema.add("score", "double")).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
