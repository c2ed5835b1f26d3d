"""Helpers the operators share: input columns, storage, labels, byte tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Extra input columns, whatever they are called, cannot clash with columns
    that an operator makes, and never reach a shuffle.
    """
    return frame.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def stored(frame: DataFrame) -> DataFrame:
    """Write a result to the cluster's checkpoint folder and go on from there.

    The folder is the one in ``spark.checkpoint.dir``. Where a session on one
    machine names none, as in tests, a folder of that machine is made.
    """
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint()


def with_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where ``doc_id`` holds the whole row, for operators that carry ids along."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col("`text`").alias("text"))


#: Rows that go to a Python worker at once. Texts are some kilobytes; Spark's default of 10,000 rows would hold tens of megabytes several times over.
BATCH_ROWS = 1000


def mapped(frame: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded size; a smaller setting of the session stays."""
    conf = frame.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return frame.mapInArrow(function, schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: remainder 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label 0 or 1) outside the held-out fold, one row per document.

    Null ids and null labels train nothing. A doc_id labelled more than once
    takes its smallest label, so repeated label rows cannot repeat documents.
    """
    rows = pick(labels, doc_id="doc_id", label=target).where("doc_id is not null and label is not null")
    rows = rows.where(fold_of(F.col("doc_id")) != 0)
    return rows.groupBy("doc_id").agg(F.min((F.col("label") > 0).cast("int")).alias("label"))


def base_counts(known: DataFrame) -> tuple[int, int]:
    """How many training labels are 0 and 1."""
    found = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return found.get(0, 0), found.get(1, 0)


def bounded_sample(docs: DataFrame, known: DataFrame, per_class: int, seed: str, max_chars: int) -> DataFrame:
    """(doc_id, text, label, key): texts of at most ``per_class`` documents of each label.

    The documents are those with the smallest hash of seed and id, an order with
    a limit over the labels alone. So the ids that are sent to the rows of the
    documents number at most ``2 * per_class``, and no text is shuffled. Texts of
    more than ``max_chars`` are not drawn, which bounds the sample's size.
    """
    keyed = known.select("doc_id", "label", F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    parts = [keyed.where(F.col("label") == value).orderBy("key", "doc_id").limit(per_class) for value in (0, 1)]
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    drawn = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return drawn.where(F.length("text") <= max_chars).select("doc_id", "text", "label", "key")


def batches_of(column: str, batches: Iterator) -> Iterator[tuple]:
    """(record batch, list of texts) pairs, nulls as empty text."""
    for batch in batches:
        for part in slices(batch):
            yield part, [x or "" for x in part.column(column).to_pylist()]


def slices(batch, rows: int = 256) -> Iterator:
    """A record batch a few rows at a time, so that few texts are Python strings at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


#: Bytes of texts that are worked on at once; a longer text is a slice alone.
SLICE_BYTES = 4 << 20


def sized_slices(batch, column: str = "text", most: int = SLICE_BYTES) -> Iterator:
    """A record batch in slices of at most so many bytes of one column."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        spent = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, spent + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_RANDOM = np.random.Generator(np.random.PCG64(20260101))
#: A random 64-bit value for each byte, and an odd base, for polynomial hashes modulo 2**64.
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes."""
    flags = is_word[data].view(np.int8)
    edge = np.diff(flags, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=total[1:])
        return mixed((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(BASE) + words[k : k + n]
        return mixed(out)


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
