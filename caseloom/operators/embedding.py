"""Embeddings: signed feature hashing, pluggable models, reuse and pooling."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.defaults import DEFAULTS
from caseloom.functions.patterns import as_col, words

VECTOR = T.ArrayType(T.DoubleType())
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

#: Keys whose cells one task counts and holds.
TASK_KEYS = 2_000
#: Tokens whose codes an embedder keeps before it begins anew.
MOST_CODES = 1 << 18


def hashed_terms(texts: DataFrame, key: str, text: str, dim: int = DEFAULTS.embedding_dim) -> DataFrame:
    """Signed feature hashing in long form: ``key, index, value`` with unit norm.

    Bucket: first four bytes of the token's SHA-256 modulo the dimension. Sign:
    parity of the fifth byte. Stays inside the JVM. Texts are dealt out by key,
    ``TASK_KEYS`` a task, and counted where they then are: a task holds the
    cells of its own keys, however many texts a file has.
    """
    digest = F.sha2("token", 256)
    dealt = texts.select(key, text).repartition(max(1, -(-texts.count() // TASK_KEYS)), key)
    tokens = dealt.select(key, F.explode(words(F.lower(F.col(text)))).alias("token"))
    signed = tokens.select(
        key,
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("index"),
        F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1)
        .otherwise(-1)
        .alias("sign"),
    )
    cells = signed.groupBy(key, "index").agg(F.sum("sign").alias("weight")).where("weight <> 0")
    held = cells.groupBy(key).agg(
        F.collect_list(F.struct("index", "weight")).alias("cells"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    return held.select(key, "norm", F.inline("cells")).select(key, "index", (F.col("weight") / F.col("norm")).alias("value"))


def hash_embedder(dim: int = DEFAULTS.embedding_dim) -> Embedder:
    """The same hashing as a batch callable; each distinct token is digested once."""

    class Codes(dict):
        """Twice the index of a token, plus one where its sign is negative."""

        def __missing__(self, token: str) -> int:
            digest = hashlib.sha256(token.encode("utf-8")).digest()
            self[token] = code = int.from_bytes(digest[:4], "big") % dim * 2 + digest[4] % 2
            return code

    codes = Codes()

    def some(texts: Sequence[str]) -> np.ndarray:
        if len(codes) > MOST_CODES:
            codes.clear()
        tokens = [text.lower().split() for text in texts]
        counts = [len(t) for t in tokens]
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(tokens)), np.int64, sum(counts))
        index, sign = code >> 1, 1.0 - 2.0 * (code & 1)
        row = np.repeat(np.arange(len(counts)), counts)
        # Sums of signs are whole numbers, so their order does not matter.
        vectors = np.bincount(row * dim + index, weights=sign, minlength=len(counts) * dim).reshape(-1, dim)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        return vectors / np.where(norms == 0, 1.0, norms)

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for at in range(0, len(texts), 256):
            out[at : at + 256] = some(texts[at : at + 256])
        return out

    return embed


def embed_column(text: Column | str, factory: Callable[[], Embedder] = hash_embedder,
                 dim: int = DEFAULTS.embedding_dim) -> Column:
    """Vectors for a text column from a pluggable model.

    ``factory`` runs once per task and returns a callable on a batch of texts;
    Arrow batches take the place of request batching. A batch that comes back
    with another count or another width fails the task.
    """

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            vectors = model(batch.fill_null("").to_pylist())
            if len(vectors) != len(batch):
                raise ValueError("embedding backend returned an unexpected result count")
            if any(len(v) != dim for v in vectors):
                raise ValueError("embedding dimension does not match the vector index")
            cells = np.asarray(vectors, dtype="float64").reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(cells))

    return run(as_col(text))


def normalize(vector: Column | str) -> Column:
    """Vector over its Euclidean norm; a zero vector stays as it is."""
    vector = as_col(vector)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm == 0, vector.cast(VECTOR)).otherwise(
        F.transform(vector, lambda x: x.cast("double") / norm)
    )


def embed_with_reuse(texts: DataFrame, known: DataFrame, text: str = "text", *,
                     factory: Callable[[], Embedder] = hash_embedder, model: str = "hash",
                     version: str = DEFAULTS.index_version, dim: int = DEFAULTS.embedding_dim
                     ) -> tuple[DataFrame, DataFrame]:
    """Embed each distinct text once and only where no vector is known.

    ``known`` holds ``embedding_key, vector``. Returns the vectors to add and
    the input rows with their keys; copies of a text share one key, so a
    frequent text costs one embedding.
    """
    key = F.sha2(F.concat_ws(":", F.lit(version), F.lit(model), F.sha2(F.col(text), 256)), 256)
    keyed = texts.withColumn("embedding_key", key)
    missing = (
        keyed.groupBy("embedding_key")
        .agg(F.min(text).alias(text))
        .join(known.select("embedding_key"), "embedding_key", "left_anti")
    )
    fresh = missing.select("embedding_key", embed_column(text, factory, dim).alias("vector"))
    return fresh, keyed


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean of the token vectors of each document, position by position.

    Sums are formed per position before the shuffle, so a long document does
    not gather its vectors in one place.
    """
    cells = tokens.select(key, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg("x").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(key).agg(F.transform(ordered, lambda c: c["mean"]).alias(vector))


def dimension_guard(vectors: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Tag vectors of another width with the public failure code."""
    return vectors.withColumn(
        "failure_code", F.when(F.coalesce(F.size(vector), F.lit(-1)) != dim, "embedding_failed")
    )
