"""Whitening, fill-in-the-middle and SimHash tiles against plain versions, and on unusual tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import fill_middle, lanczos_whitening, simhash_tiles
from caseloom.llm.wavelet import WaveletMatrix
from tests.llm import brute
from tests.llm.test_operators import DOCS, ODD_TEXTS, edited, same_rows, words


@pytest.fixture(scope="module")
def texts():
    base = words(0, 400)
    rows = list(ODD_TEXTS) + [(600, "<P>"), (601, "a <S> b"), (602, "ab<M"), (603, "<S"), (604, "İ ſ K ß\r\n x" * 40), (605, "😀a😀" * 9)]
    rows += [(100 + k, edited(base, k, 1 + k % 9)) for k in range(60)] + [(300 + k, base) for k in range(5)]
    rows += [(700 + k, words(20 + k, 3 + k * 7)) for k in range(40)]
    rows += [(800, words(7, 40_000, 10**6)), (801, words(7, 40_000, 10**6) + " tail")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, None, None, 7, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS + ", fp long, form string, output string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
        wanted = np.flatnonzero(np.isin(symbols, (1, 4, 6)))
        zero, end = np.zeros(len(wanted) + 1, np.int64), np.full(len(wanted) + 1, n)
        assert matrix.select((1, 4, 6), np.arange(len(wanted) + 1), zero, end).tolist() == [*wanted.tolist(), n]


def test_fill_middle(docs, nothing, texts):
    same_rows(fill_middle.digests(docs), brute.fill_middle(texts))
    assert fill_middle.digests(nothing).collect() == []
    forms = Counter(r.form for r in fill_middle.transformed(docs).collect())
    assert min(forms["psm"], forms["spm"], forms["plain"]) > 0


def test_fill_middle_cuts_every_place():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 1.ü\n") for _ in range(n)) for n in range(30)]
    for text in texts:
        units = brute.re.findall("[A-Za-z]+|[^A-Za-z]", text)
        numbers = np.arange(len(units) + 1)
        n, first, later = fill_middle.cuts([text] * len(numbers), numbers, np.zeros(len(numbers), np.int64))
        assert set(n.tolist()) == {len(units)} and set(first.tolist()) == {0}
        assert later.tolist() == [len("".join(units[:k])) for k in numbers]


def test_simhash(docs, nothing, texts):
    want = brute.simhash_components(texts)
    same_rows(simhash_tiles.near_duplicates(docs), want)
    assert max(Counter(c for _, _, c in want).values()) > 20
    assert simhash_tiles.near_duplicates(nothing).collect() == []


def test_simhash_links_between_chunks(spark):
    """Chains of fingerprints that differ in few bits, in tiles of several chunks and across tiles."""
    rng = random.Random(9)
    marks = set()
    for _ in range(60):
        mark = rng.getrandbits(64)
        for _ in range(30):
            marks.add(mark)
            for bit in rng.sample(range(64), 3):
                mark ^= 1 << bit
    marks = [*marks, 0, 1, 2**64 - 1, 2**64 - 8, 2**63]
    nodes = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in marks], "fp long")
    for size in (3, 50, 5000):
        root = {m: m for m in marks}

        def find(m, root=root):
            while root[m] != m:
                m = root[m]
            return m

        for a, b in ((r.a % 2**64, r.b % 2**64) for r in simhash_tiles.links(nodes, size=size).collect()):
            root[find(a)] = find(b)
        want = {m: m for m in marks}
        for k, a in enumerate(marks):
            for b in marks[:k]:
                if (a ^ b).bit_count() <= 3:
                    want[find(a, want)] = find(b, want)
        groups = Counter(frozenset(x for x in marks if find(x) == r) for r in marks if find(r) == r)
        assert groups == Counter(frozenset(x for x in marks if find(x, want) == r) for r in marks if find(r, want) == r)


def test_links_within_a_dense_chunk():
    rng = np.random.default_rng(4)
    marks = np.unique(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 40, (3000, 2)), axis=1))
    a, b = simhash_tiles.compared(marks, marks, 3, True)
    assert len(a) <= 2 * len(marks) and len(set(np.concatenate([a, b]).tolist())) == len(marks)


def test_fingerprint_of_long_texts():
    text = words(11, 50_000, 10**6)
    assert simhash_tiles.fingerprint(text) == brute.simhash(text)


def spectrum(rows, count=8):
    """(n, exact deviations, components as columns, variances, trace) of the vectors that remain."""
    kept = [v for v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in kept], object)
    n, total = len(x), x.sum(axis=0)
    centred = ((n * x - total) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(int(t) ** 2 for t in n * row - total) for row in x], centred, vectors[:, ::-1][:, :count], values[::-1][:count], values.sum()


def check_whitening(frame, vectors, count=8, atol=1e-9):
    n, deviations, centred, components, variances, trace = spectrum(list(vectors.values()), count)
    kept = [k for k, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    rows = frame.collect()
    assert len(rows) == len(kept) * len(variances) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9
    got = np.zeros((len(kept), len(variances)))
    place = {k: i for i, k in enumerate(kept)}
    for r in rows:
        assert r.deviation == deviations[place[r.vec_id]]
        assert abs(r.explained - variances[r.component - 1] / trace) < 1e-9 * r.explained
        got[place[r.vec_id], r.component - 1] = r.whitened
    want = centred @ components / np.sqrt(variances)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < atol


@pytest.mark.parametrize("size, block", [(64, None), (64, 1), (20, 3), (200, None), (5, None)])
def test_whitening(spark, size, block):
    rng = np.random.default_rng(size)
    values = rng.standard_normal((400, size)) * np.linspace(1, 0.2, size) * (0.8 ** np.arange(size) + 0.05)
    vectors = {k: v.astype(np.float32).tolist() for k, v in enumerate(values)}
    vectors |= {1000: None, 1001: [None] * size, 1002: [*vectors[0][:-1], None], 1003: [*vectors[0][:-1], float("nan")], 1004: [float("-inf")] * size}
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in vectors.items()], "vec_id long, embedding array<float>, n string, whitened int").repartition(3)
    model = lanczos_whitening.fit(frame, block=block)
    assert model.scans <= -(-size // (block or min(8, size))) + 1
    check_whitening(lanczos_whitening.transform(frame, model), vectors, min(8, size))


def test_whitening_of_repeated_variances(spark):
    """A component of multiplicity: any basis of its space will do, and every variance is found."""
    vectors = [[s * float(j == k) for j in range(12)] for k in range(12) for s in (1, -1)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for block in (1, 4, None):
        model = lanczos_whitening.fit(frame, block=block)
        assert len(model.variances) == 8 and np.allclose(model.variances, model.variances[0], rtol=1e-9) and model.identity_error < 1e-9


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(1)
    flat = rng.standard_normal((60, 3)) @ rng.integers(-4, 5, (3, 16))
    vectors = {k: (np.floor(1024 * v) / 1024).tolist() for k, v in enumerate(flat)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    check_whitening(lanczos_whitening.whitened(frame, 3), vectors, 3)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in lanczos_whitening.whitened(line).collect()} == {1}


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0])] * 3, [(1, [float("nan")])]):
        assert lanczos_whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    vectors = {k: [0.1 * k * k, 1.0 * k] for k in range(6)}
    rows = [*vectors.items(), (None, [3.0, 3.5]), (7, [1.0, 2.0, 3.0]), (8, [])]
    found = lanczos_whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in found) == Counter({**dict.fromkeys(vectors, 2), None: 2}) and {r.n for r in found} == {7}
    huge = [(k, [1e300 * (k % 2), float(k), -1e30 * (k % 3 == 0)]) for k in range(6)]
    assert {r.deviation for r in lanczos_whitening.whitened(spark.createDataFrame(huge, schema)).collect()} == {None}
