"""Whitening against exact rational arithmetic and another eigen-solver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import eigen, queries, whitening

numbers = st.floats(-1e9, 1e9, allow_nan=False, allow_subnormal=False).filter(lambda x: x == 0 or abs(x) > 1e-9)


@settings(max_examples=200, deadline=None)
@given(numbers, numbers)
def test_transformations_lose_nothing(a, b):
    for f, exact in ((whitening.two_sum, Fraction(a) + Fraction(b)), (whitening.two_product, Fraction(a) * Fraction(b))):
        high, low = f(np.array([a]), np.array([b]))
        assert Fraction(float(high[0])) + Fraction(float(low[0])) == exact


def test_sums_of_products_keep_what_doubles_lose():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(301, 3)) * 10.0 ** rng.integers(-8, 9, size=(301, 3))
    high, low = whitening.products(x, np.zeros_like(x))
    for k, (i, j) in enumerate(zip(*np.triu_indices(3), strict=True)):
        exact = sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(x[:, i], x[:, j], strict=True))
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - exact) <= abs(exact) * Fraction(1, 2**90) + Fraction(1, 2**60)


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 17, 64, 150):
        x = rng.normal(size=(n + 5, n))
        yield x.T @ x
    yield from (np.eye(20), np.ones((30, 30)), np.zeros((4, 4)), np.kron(np.eye(6), np.array([[2, 1], [1, 2.0]])))
    x = rng.normal(size=(64, 5))
    yield x @ x.T
    yield np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    yield q @ np.diag(10.0 ** -np.arange(20)) @ q.T
    for _ in range(60):
        n = int(rng.integers(1, 30))
        x = rng.integers(-3, 4, size=(n, n)).astype(float)
        yield x + x.T


def test_divide_and_conquer():
    for a in matrices():
        n, size = len(a), max(np.abs(a).max(), 1.0)
        values, vectors = eigen.symmetric(a)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size * n
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size * n


def reference(rows, components=4):
    """{id: [(component, n, deviation, whitened up to sign, explained)]} of sound vectors of one length, by rational means."""
    x = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows]
    distinct = sorted({tuple(v) for _, v in x})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[j] for v in distinct) for j in range(d)]
    off = np.array([[n * v[j] - s[j] for j in range(d)] for v in distinct], dtype=object)
    cov = np.array([[float(Fraction(int((off[:, i] * off[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for k, v in x:
        c = np.array([float(Fraction(n * v[j] - s[j], n)) for j in range(d)])
        dev = sum((n * v[j] - s[j]) ** 2 for j in range(d))
        out += [(k, m + 1, n, dev, abs(float(c @ vectors[:, m])) / math.sqrt(values[m]), values[m] / values.sum()) for m in range(min(components, d))]
    return out


def same(got, want):
    got, want = sorted(((r[0], r[1], r[2], int(r[3]), abs(r[4]), r[5]) for r in got), key=lambda r: r[:4]), sorted(want, key=lambda r: r[:4])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-9) and np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_query_op12(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    same([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got], reference(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # one sign for all rows: whitened components do not hang together
    y = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(-1, 4)
    assert np.abs(np.cov(y.T, bias=True) - np.eye(4)).max() < 1e-6


def test_large_means_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 3)) * [1, 0.1, 3] + [1e6, -2e7, 0]
    rows = [(k % 100, base[k % 120].tolist(), "x") for k in range(600)] + [(None, base[0].tolist(), "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(7)
    got = whitening.whiten(df).collect()
    want = reference([(-1 if k is None else k, v) for k, v, _ in rows])
    same([(-1 if r[0] is None else r[0], *r[1:6]) for r in got], want)
    assert {r.n for r in got} == {120} and got[0].identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [-0.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0]), (9, [1.0]), (10, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(1, 1), (1, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2), (9, 1)]
    assert {r.n for r in got if r.vec_id < 9} == {3}
    alone = got[-1]
    assert (alone.n, int(alone.deviation), alone.whitened, alone.explained, alone.identity_error) == (1, 0, None, None, None)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 2")).count() == 0


def test_components_without_spread(spark):
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and len(got) == 27
    assert max(r.explained for r in got) == pytest.approx(1.0)


def test_deviations_beyond_a_long(spark):
    x = np.array([[2**40, -(2**40)], [0, 1]])
    sums = tuple(int(v) for v in x.sum(axis=0))
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 2, sums) == want and want[0] > 2**63
    df = spark.createDataFrame([(k, [float(v) / 256 for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()} == dict(enumerate(want))
