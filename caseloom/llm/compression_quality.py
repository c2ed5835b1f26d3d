"""Operator 5, quality: a classifier by compression with two trained dictionaries.

One zstandard dictionary is trained on labelled good text and one on bad text.
A text is cut into blocks, each block is compressed with either dictionary, and
the summed sizes are compared: (bad - good) / (bad + good), above 0 where the
good dictionary fits better. A logistic curve over this difference and the
compressed share of the text, fitted on other labelled rows, gives the score.
The length of a text is no term of it.

Defined results: null and empty texts have no bytes and take the share of good
rows among all training rows; so does every text when one label has no rows.
Rows are scored one by one, so repeated rows repeat results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import base_counts, batches_of, bounded_sample, encode, fold_of, mapped, pick, stored, training_labels, with_rows

BLOCK = 4096
LEVEL = 3
#: Rows of each label: the first half trains the dictionaries, the rest the curve.
FIT_ROWS = 3000
FIT_CHARS = 20_000
DICTIONARY_BYTES = 65_536
#: A document is kept from this score on.
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    base: float


class Sizes:
    """Compressed sizes of a text by blocks, under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for content in (good, bad):
            dictionary = zstd.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.by.append(zstd.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            ))

    def __call__(self, data: bytes) -> tuple[int, int]:
        good = bad = 0
        for start in range(0, len(data), BLOCK):
            block = data[start : start + BLOCK]
            good += len(self.by[0].compress(block))
            bad += len(self.by[1].compress(block))
        return good, bad


def signals(sizes: Sizes, text: str) -> tuple[float, float] | None:
    """(difference, share of bytes left), none for an empty text."""
    data = encode(text)
    if not data:
        return None
    good, bad = sizes(data)
    return (bad - good) / (bad + good), min(good, bad) / len(data)


def value(curve: tuple[float, ...], signal: tuple[float, float]) -> float:
    d, share = signal
    x = np.array([1.0, d, share, d * d, share * share, d * share])
    return float(np.clip(np.dot(curve, x), -700, 700))


def fit_curve(points: np.ndarray, y: np.ndarray, penalty: float = 1e-6, steps: int = 50) -> tuple[float, ...]:
    """Class-balanced logistic regression by Newton steps, on scaled columns."""
    d, share = points.T
    x = np.stack([np.ones(len(d)), d, share, d * d, share * share, d * share], 1)
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 5 / max(1e-12, np.abs(move).max()))
    return tuple(w / scale)


def build(texts: list[str], labels: list[int]) -> tuple[bytes, bytes, tuple[float, ...]]:
    """Dictionaries from the first half of each label's texts, the curve from the rest."""
    by = {v: [t for t, label in zip(texts, labels, strict=True) if label == v and t] for v in (0, 1)}
    content = {}
    for v, own in by.items():
        blocks = [b for t in own[: (len(own) + 1) // 2] for data in [encode(t)] for b in (data[k : k + BLOCK] for k in range(0, len(data), BLOCK))]
        raw = b"".join(blocks)
        try:
            content[v] = zstd.train_dictionary(DICTIONARY_BYTES, blocks, k=512, d=8).as_bytes()
        except zstd.ZstdError:  # too few samples to train on: the text itself serves
            content[v] = raw[-DICTIONARY_BYTES:] or b" " * 8
    sizes = Sizes(content[1], content[0])
    points, y = [], []
    for v, own in by.items():
        for t in own[len(own) // 2 :]:
            points.append(signals(sizes, t))
            y.append(v)
    return content[1], content[0], fit_curve(np.array(points), np.array(y, float))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model | float:
    """A model, or the base rate alone where one label has no rows.

    The fit runs in one task on a sample of bounded size; the driver receives two
    dictionaries and a curve.
    """
    known = stored(training_labels(labels, target))
    n0, n1 = base_counts(known)
    base = (n1 + 1) / (n0 + n1 + 2)
    sample = stored(bounded_sample(docs, known, fit_rows, target, fit_chars).where("text <> ''"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch, own in batches_of("text", batches):
            texts += own
            marks += batch.column("label").to_pylist()
        if 0 < sum(marks) < len(marks):
            good, bad, curve = build(texts, marks)
            yield pa.RecordBatch.from_pydict({"good": [good], "bad": [bad], "curve": pa.array([list(curve)], pa.list_(pa.float64()))})

    found = mapped(sample.coalesce(1).sortWithinPartitions("key", "doc_id"), run, "good binary, bad binary, curve array<double>").collect()
    if not found:
        return base
    # The curve is fitted on balanced labels; the base rate moves it back.
    curve = list(found[0].curve)
    curve[0] += float(np.log((n1 + 1) / (n0 + 1)))
    return Model(bytes(found[0].good), bytes(found[0].bad), tuple(curve), base)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sizes = None if isinstance(fitted, float) else Sizes(fitted.good, fitted.bad)
        for batch, texts in batches_of("text", batches):
            out = []
            for text in texts:
                if sizes is None:
                    out.append(fitted)
                    continue
                signal = signals(sizes, text)
                out.append(fitted.base if signal is None else 1 / (1 + float(np.exp(-value(fitted.curve, signal)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = pick(docs, doc_id="doc_id", text="text")
    return mapped(rows, run, rows.select("doc_id").schema.add("score", "double")).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def good_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns, whose text is predicted to be good."""
    found = score(with_rows(docs), train(docs, labels))
    return found.where(F.col("predicted") == 1).select("doc_id.*")
