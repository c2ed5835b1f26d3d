"""Operator 11, embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, the method builds orthonormal bases V of coordinates and
U of rows, step by step, in which X is (block) upper bidiagonal:

    X V_k     = U_{k-1} B_{k-1} + U_k A_k
    X' U_k    = V_k A_k' + V_{k+1} B_k'

The singular values of that small matrix over the square root of the number of
rows are the deviations, and its right singular vectors turn V into the
components. A step takes ``block`` vectors at once (1 is the classical method),
so that a component of up to that multiplicity cannot be missed and a basis of d
coordinates is complete after d / block steps, each of which is one scan.

The vectors u have a number for every row. They are never stored or sent: each is
X p for a p of d numbers, which the driver keeps, so every task makes its own part
of u again from the rows it reads, multiplies the same rows by it, and adds up
X'u. Full reorthogonalisation needs nothing more: the products of a new u with all
earlier ones follow from X'u and the p, and v is held against all of V. What
crosses the network is d x block sums for each task, added up by coordinate.

Vectors become whole numbers first, so counts and sums are exact. Steps end when
the basis is complete, or when the residuals of the wanted components are at the
level of rounding.

Defined results: a vector that is null, or holds a null or a non-finite entry, is
dropped; so is one of another length than most vectors have (of equally common
lengths the longer one counts). Entries beyond +-2**52 / 1024 count as that bound.
Components along which the vectors do not vary do not exist, so equal vectors, a
single one and an empty table give no rows. Rows that repeat a vec_id or a vector
count and are returned each for itself. A deviation that a long cannot hold is
null. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mapped, pick

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
BOUND = float(1 << 52)
#: A component exists if its variance is more than this share of the largest one.
LEAST_SHARE = 1e-12
#: Steps end when the residuals are below this share of the largest singular value. Squares of lengths below the
#: second share of its square are rounding.
TOLERANCE, ROUNDING = 1e-13, 1e-14


def whole(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their entries as whole numbers): vectors of ``size`` finite entries."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    good = np.isfinite(flat).all(axis=1)
    scaled = np.floor(np.clip(SCALE * flat[good], -BOUND, BOUND))
    return fits[good], scaled.astype(np.int64) + SHIFT


def dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors; of equally common ones the greatest. 0 without vectors."""
    found = rows.where("vector is not null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Number of a task's vectors, and of each coordinate the exact sum and sum of squares."""
    n, total, squares = 0, [0] * size, [0] * size
    for batch in batches:
        x = whole(batch.column("vector"), size)[1]
        n += len(x)
        # A thousand entries below 2**52, or squares of such below 2**26, fit a long.
        square = np.square(x if np.abs(x).max(initial=0) < 1 << 26 else x.astype(object))
        total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        squares = [a + int(b) for a, b in zip(squares, square.sum(axis=0).tolist(), strict=True)]
    kind = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total, kind), pa.array(squares, kind)],
        ["place", "n", "total", "squares"],
    )


def _products(batches: Iterator[pa.RecordBatch], size: int, mean: np.ndarray, factor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """X'(X Q) and (X Q)'(X Q) of a task's rows for a factor Q: d and then block rows of block numbers."""
    width = factor.shape[1]
    crossed, own = np.zeros((size, width)), np.zeros((width, width))
    for batch in batches:
        x = whole(batch.column("vector"), size)[1] - mean
        u = x @ factor
        crossed += x.T @ u
        own += u.T @ u
    sums = np.concatenate([crossed, own])
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(size + width), pa.int32()), *(pa.array(sums[:, k]) for k in range(width))], ["place", *(f"s{k}" for k in range(width))]
    )


@dataclass
class Whitening:
    """The fitted list: its size, exact sums, components as columns, and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0
    scans: int = 0

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.size)

    @property
    def factor(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


class Scans:
    """The distributed products with the centred rows."""

    def __init__(self, rows: DataFrame, size: int, mean: np.ndarray) -> None:
        self.rows, self.size, self.mean, self.count = rows, size, mean, 0

    def products(self, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X'(X Q) and (X Q)'(X Q) over all rows."""
        self.count += 1
        width = factor.shape[1]
        names = [f"s{k}" for k in range(width)]
        schema = ", ".join(["place int", *(f"{c} double" for c in names)])
        parts = mapped(self.rows, partial(_products, size=self.size, mean=self.mean, factor=factor), schema)
        found = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).collect()
        sums = np.zeros((self.size + width, width))
        for r in found:
            sums[r.place] = r[1:]
        own = sums[self.size :]
        return sums[: self.size], (own + own.T) / 2


def orthonormal(columns: np.ndarray, against: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the columns beside ``against``, without directions of a length below ``least``."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
    left, lengths, _ = np.linalg.svd(columns, full_matrices=False)
    kept = left[:, lengths > least]
    kept = kept - against @ (against.T @ kept)
    return np.linalg.qr(kept)[0] if kept.shape[1] else kept


def fill(basis: np.ndarray, against: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """More random directions beside all others, up to ``width`` or until coordinates are used up."""
    size = len(basis)
    more = min(width - basis.shape[1], size - basis.shape[1] - against.shape[1])
    if more <= 0:
        return basis
    return np.hstack([basis, orthonormal(rng.standard_normal((size, more)), np.hstack([against, basis]), 1e-8)])


def bidiagonalised(scans: Scans, wanted: int, block: int, seed: int = 20260101) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values) of the centred rows, the ``wanted`` largest first."""
    size, rng = scans.size, np.random.default_rng(seed)
    none = np.zeros((size, 0))
    basis = v = fill(none, none, block, rng)
    makers, crossed = none, none  # of each u = X p: the p, and X'u
    largest = 0.0
    while True:
        q, _ = scans.products(v)
        p, largest = v, max(largest, float(np.linalg.norm(q, 2)))  # at most the square of the largest singular value
        # U_k A_k = X V_k - U_{k-1} B_{k-1}: the second term is what full reorthogonalisation against U takes away.
        for _ in range(2):
            shares = makers.T @ q
            p, q = p - makers @ shares, q - crossed @ shares
        squares, turn = np.linalg.eigh((p.T @ q + q.T @ p) / 2)
        good = squares > ROUNDING * largest
        turn = turn[:, good] / np.sqrt(squares[good])
        makers, crossed = np.hstack([makers, p @ turn]), np.hstack([crossed, q @ turn])
        # X between both bases: bidiagonal by blocks. What X'U has beside V is the next block and the residual.
        left, singular, right = np.linalg.svd(crossed.T @ basis, full_matrices=False)
        rest = crossed - basis @ (basis.T @ crossed)
        residuals = np.linalg.norm(rest @ left[:, :wanted], axis=0)
        met = basis.shape[1] > wanted and (residuals <= TOLERANCE * np.sqrt(largest)).all()
        if met or basis.shape[1] == size:
            return basis @ right[:wanted].T, singular[:wanted]
        width = min(block, size - basis.shape[1])
        v = orthonormal(rest[:, rest.shape[1] - int(good.sum()) :], basis, TOLERANCE * np.sqrt(largest))[:, :width]
        v = fill(v, basis, width, rng)
        basis = np.hstack([basis, v])


def fit(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block: int | None = None) -> Whitening:
    """Means, components and variances of all vectors. A scan sends d times ``block`` numbers to the driver."""
    rows = pick(frame, vector=vector)
    size = dimension(rows)
    model = Whitening(0, [0] * size, np.zeros((size, 0)), np.zeros(0), 0.0)
    if not size:
        return model
    parts = mapped(rows, partial(_sums, size=size), "place int, n long, total decimal(38, 0), squares decimal(38, 0)")
    sums = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    found = sums.orderBy("place").collect()
    if not found or not found[0].n:
        return model
    model.n, model.sums = found[0].n, [int(r.total) for r in found]
    model.trace = sum(model.n * int(r.squares) - int(r.total) ** 2 for r in found) / model.n**2
    if not model.trace:
        return model
    scans = Scans(rows, size, model.mean)
    vectors, singular = bidiagonalised(scans, min(components, size), min(block or components, size))
    variances = singular**2 / model.n
    real = variances > LEAST_SHARE * variances[0]
    model.components, model.variances = vectors[:, real], variances[real]
    covariance = scans.products(model.factor)[1] / model.n
    model.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    model.scans = scans.count
    return model


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)**2; none where a long cannot hold it."""
    apart = model.n * x - np.array(model.sums, np.int64)
    size = np.square(apart.astype(np.float64)).sum(axis=1)
    with np.errstate(over="ignore"):
        out: list[int | None] = np.square(apart).sum(axis=1).tolist()
    for k in np.flatnonzero(size > 9e18):
        total = sum(t * t for t in apart[k].tolist())
        out[k] = total if total < 1 << 63 else None
    return out


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    mean, factor, many = model.mean, model.factor, len(model.variances)
    explained = model.variances / model.trace
    for batch in batches:
        kept, x = whole(batch.column("vector"), model.size)
        each = np.repeat(np.arange(len(kept)), many)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(kept[each])), pa.array(np.tile(np.arange(1, many + 1), len(kept)), pa.int32()),
             pa.array(np.full(len(each), model.n)), pa.array(_deviations(x, model), pa.int64()).take(pa.array(each)),
             pa.array(((x - mean) @ factor).ravel()), pa.array(np.tile(explained, len(kept))),
             pa.array(np.full(len(each), model.identity_error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def transform(frame: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each remaining vector and component: its place along the component in deviations, and how far it lies from the mean."""
    rows = pick(frame, vec_id=key, vector=vector)
    schema = rows.select("vec_id").schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    if not len(model.variances):
        rows = rows.limit(0)
    return mapped(rows, partial(_whitened, model=model), schema)


def whitened(frame: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The query's rows."""
    return transform(frame, fit(frame, components=components))
