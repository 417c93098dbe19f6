"""Whitening against numpy and exact arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import whitening
from quarry.llm.whitening import changes_above, characteristic_polynomial, cross_products, digits_of, largest_roots, null_vectors, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n int"


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 1, "c", 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def by_numpy(vectors):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], basis[:, ::-1]


def test_agrees_with_numpy(spark):
    vectors = np.random.default_rng(1).normal(0, 1, (300, 6)) * [1, 2, 3, 4, 5, 6]
    vectors[250:] = vectors[0]  # copies count once
    got = whiten(frame(spark, vectors), most=4).toPandas().sort_values(["vec_id", "component"])
    x, fit, values, basis = by_numpy(vectors)
    assert len(got) == 300 * 4 and set(got.n) == {len(fit)}
    expected = (x - fit.mean(axis=0)) @ basis[:, :4] / np.sqrt(values[:4])
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(300, 4)), np.abs(expected), atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:4], values[:4] / values.sum(), rtol=1e-12)
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1
    sums = fit.sum(axis=0).astype(int)
    exact = [int(((len(fit) * row.astype(int) - sums) ** 2).sum()) for row in x]
    assert got.deviation[got.component == 1].tolist() == exact


def test_rows_that_do_not_count(spark):
    good = [[0, 1], [1, 0], [2, 5], [4, 1]]
    bad = [None, [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], []]
    got = whiten(frame(spark, good + bad)).toPandas()
    assert set(got.vec_id) == {0, 1, 2, 3} and set(got.n) == {4}
    alone = whiten(frame(spark, good)).toPandas()
    assert np.allclose(got.sort_values(["vec_id", "component"]).whitened, alone.sort_values(["vec_id", "component"]).whitened)


def test_null_and_repeated_ids_are_rows(spark):
    got = whiten(frame(spark, [[0, 1], [1, 0], [2, 5], [2, 5]], ids=[None, 7, 7, None])).toPandas()
    assert len(got) == 8 and got.vec_id.isna().sum() == 4 and set(got.n) == {3}


@pytest.mark.parametrize("vectors", [[], [[1, 2]], [[1, 2]] * 5, [None], [[]]])
def test_no_variance_no_rows(spark, vectors):
    found = whiten(frame(spark, vectors))
    assert found.count() == 0 and found.columns[0] == "vec_id"


def test_constant_dimensions_have_no_component(spark):
    got = whiten(frame(spark, [[1, 0, 3], [1, 2, 3], [1, 5, 3]])).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)


def test_equal_eigenvalues_have_orthogonal_components(spark):
    vectors = [[s * (k == j) for j in range(3)] for k in range(3) for s in (-1, 1)]
    got = whiten(frame(spark, vectors)).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 1 / 3)


def test_deviation_beyond_a_long_is_null(spark):
    vectors = [[1e15, 0], [0, 1e15], [-1e15, 3], [1, 1]]
    got = whiten(frame(spark, vectors)).toPandas()
    assert got.deviation.isna().any() and got.identity_error.max() < 1e-4


def test_products_of_large_entries_are_exact():
    for bits in (3, 21, 45, 62):
        y = np.random.default_rng(bits).integers(-(1 << bits), 1 << bits, (50, 4))
        exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)]
        assert cross_products(y).tolist() == exact
    for value in (0, -1, 5, -(1 << 200), (1 << 190) + 7):
        assert sum(d << (40 * k) for k, d in enumerate(digits_of(value))) == value


def scatter_of(roots, seed=0):
    """A symmetric integer matrix with these eigenvalues times a square, turned by an integer reflection."""
    v = np.array(np.random.default_rng(seed).integers(1, 5, len(roots)), object)
    length = int((v * v).sum())
    turn = length * np.eye(len(roots), dtype=object).astype(int).astype(object) - 2 * np.multiply.outer(v, v)
    return turn @ np.diag(np.array(roots, object)) @ turn, length**2


def test_polynomial_and_roots_are_exact(spark):
    roots = [9, 9, 7, 2, 2, 2, 1, 0]
    a, square = scatter_of(roots)
    f = characteristic_polynomial(spark, a)
    product = [1]
    for r in roots:
        product = [x - r * square * y for x, y in zip([0, *product], [*product, 0])]
    assert f == product
    assert changes_above(f, Fraction(7 * square)) == 2 and changes_above(f, Fraction(7 * square) - Fraction(1, 3)) == 3
    found = largest_roots(f, 4)
    assert [r.times for r in found] == [2, 1, 3]
    assert all(r.low < v * square <= r.high and r.high - r.low < Fraction(1, 1 << 90) for r, v in zip(found, (9, 7, 2)))


def test_components_of_close_and_repeated_roots(spark):
    roots = [10**12 + 1, 10**12, 10**12, 5]
    a, square = scatter_of(roots, 3)
    for root in largest_roots(characteristic_polynomial(spark, a), 4):
        vectors = np.array(null_vectors(a.copy(), root))
        value = int(root.middle + Fraction(1, 2))
        assert np.allclose(vectors @ vectors.T, np.eye(root.times), atol=1e-14)
        exact = [[Fraction(c) for c in v] for v in vectors.tolist()]
        for v in exact:
            rest = [sum(int(a[i, j]) * v[j] for j in range(4)) - value * v[i] for i in range(4)]
            assert max(abs(float(r)) for r in rest) < 1e-14 * 10**12 * square


def test_hot_vector_is_one_row_of_the_fit_list(spark):
    vectors = [[1, 2]] * 1000 + [[0, 0], [3, 1]]
    got = whiten(frame(spark, vectors)).toPandas()
    assert set(got.n) == {3} and len(got) == 2 * 1002


def test_floats_are_read_as_doubles(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.7]), (2, [0.3, 0.2]), (3, [0.9, 0.4])], "vec_id string, embedding array<float>".replace("string", "long"))
    used = rows.select(whitening.quantised(F.col("embedding")).alias("x")).collect()
    assert used[0]["x"] == [1_000_000 + int(64 * np.float64(np.float32(0.1))), 1_000_000 + int(64 * np.float64(np.float32(0.7)))]
    assert whiten(rows).count() == 6
