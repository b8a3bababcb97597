"""Whitening against NumPy's eigenvectors, and its exact steps against plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from logvars.llm import whitening as w
from logvars.llm.queries import op13_whitening


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions."""
    d = len(matrix)
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
    m, c = eye * 0, [Fraction(1)]
    for k in range(1, d + 1):
        m = matrix.dot(m) + eye * c[-1]
        c.append(-sum(matrix.dot(m)[i, i] for i in range(d)) / k)
    return [int(x) for x in reversed(c)]


def scatter(rng, d, n, size=50):
    x = rng.integers(-size, size, (n, d))
    return (x.T @ x).astype(object)


@pytest.mark.parametrize("d, n", [(1, 3), (2, 5), (3, 1), (6, 4), (9, 30), (16, 40)])
def test_polynomial_is_exact(spark, d, n):
    matrix = scatter(np.random.default_rng(d), d, n)
    assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_polynomial_of_sparse_matrices_needs_other_pivots(spark):
    matrix = np.zeros((7, 7), dtype=object)
    matrix[0, 6] = matrix[6, 0] = 3
    matrix += np.diag([9, 0, 4, 4, 1, 0, 8]).astype(object)
    assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_primes():
    assert [n for n in range(60) if w.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    found = w.primes_beyond(10**60)
    assert math.prod(found) > 10**60 and all(p % k for p in found for k in range(3, 47_000, 2))


def test_roots_and_vectors_of_repeated_eigenvalues():
    matrix = np.diag([5, 3, 5, 0, 5, 0]).astype(object)
    roots, s = w.largest_roots(exact_polynomial(matrix), 8)
    assert [r / (1 << s) for r in roots] == [5, 5, 5, 3]
    vectors = np.array([[int(v) / (1 << w.FIXED_BITS) for v in row] for row in w.null_vectors(matrix, roots, s)])
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-15)
    assert np.allclose(vectors @ matrix.astype(float), vectors * np.array([[5], [5], [5], [3]]), atol=1e-14)


def test_close_roots_are_told_apart():
    # Roots 10^9 and 10^9 + 1, far below what doubles tell apart after squaring.
    a, b = 10**9, 10**9 + 1
    roots, s = w.largest_roots([a * b, -(a + b), 1], 2)
    assert [abs(Fraction(r, 1 << s) - x) < Fraction(1, 1 << 80) for r, x in zip(roots, (b, a), strict=True)] == [True, True]


def check(rows, table, components=8):
    """``rows`` of the operator against floats of ``table`` (id, vector), all of them good."""
    x = np.array([[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for _, v in table])
    n = len(x)
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == n * components
    sums = x.sum(axis=0).astype(object)
    for k in range(components):
        got = np.array([by[i, k + 1].whitened for i, _ in table])
        want = (x - mean) @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(by[table[0][0], k + 1].explained - values[k] / values.sum()) < 1e-9
    for i, (vec_id, _) in enumerate(table):
        r = by[vec_id, 1]
        assert r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums, strict=True))
    assert max(r.identity_error for r in rows) < 1e-9


def test_whole_table(spark, sf):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op13_whitening(spark, sf).collect(), table)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, [0.5, 0.5, 0.5]), (41, [0.5, 0.5, 0.5])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [1.0, 2.0, float("-inf")]), (55, [1.0])]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as x")
    check(w.whiten(table).collect(), good, components=3)
    nothing = spark.createDataFrame(bad[:4], "vec_id long, embedding array<double>")
    assert w.whiten(nothing).count() == 0 and w.whiten(table.where("vec_id in (40, 41)")).count() == 0
    assert w.whiten(table.where("vec_id < 0")).columns == w.whiten(table).columns
    # A null id stays; two rows span one direction.
    pair = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 4.0])], "vec_id long, embedding array<float>")
    rows = w.whiten(pair).collect()
    assert [r.component for r in rows] == [1, 1] and sorted(round(r.whitened, 12) for r in rows) == [-1, 1]


def test_very_large_entries(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 5.0])], "vec_id long, embedding array<double>")
    rows = w.whiten(table).collect()
    assert len(rows) == 6 and {r.deviation for r in rows} == {None} and all(r.identity_error < 1e-4 for r in rows)
