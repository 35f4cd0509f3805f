"""Correlation matrices and principal components against numpy."""

import numpy as np
import pytest

from driftloom.operators import features
from driftloom.operators.matrices import correlation_matrix


@pytest.mark.parametrize("size", [3, 64, 130])
def test_correlations_with_missing_values(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(90, size)) @ rng.normal(size=(size, size)) + 1e6
    x[:, 0] = 3.25
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)] + [(90, None), (91, [float("nan")] * size), (92, [None] * size)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    found = {(r.a, r.b): (r.n, r.r) for r in correlation_matrix(df, "v", size).collect()}
    assert set(found) == {(a, b) for a in range(size) for b in range(a + 1, size)}
    for (a, b), (n, r) in found.items():
        both = np.isfinite(x[:, a]) & np.isfinite(x[:, b])
        assert n == both.sum()
        if a == 0:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-7)


def test_correlations_of_few_rows(spark):
    schema = "id int, v array<double>"
    one = correlation_matrix(spark.createDataFrame([(1, [1.0, 2.0])], schema), "v", 2).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1, None)]
    two = correlation_matrix(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], schema), "v", 2).collect()
    assert [tuple(r) for r in two] == [(0, 1, 2, -1.0)]
    assert correlation_matrix(spark.createDataFrame([], schema), "v", 2).count() == 0
    with pytest.raises(ValueError):
        correlation_matrix(spark.createDataFrame([(1, [1.0])], schema), "v", 2)


def test_components_equal_an_eigen_decomposition(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * [5.0, 3.0, 2.0, 1.0, 0.5] @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 4
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "v array<double>")
    mean, loadings, share, variances = features.fit_pca(df, "v", 5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors *= np.sign(vectors[np.arange(5), np.abs(vectors).argmax(axis=1)])[:, None]
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(loadings, vectors)
    assert np.allclose(variances, values) and np.allclose(share, values / values.sum())

    def table(**more):
        rows = features.loading_table(spark, loadings, variances, **more).collect()
        return np.array([r.loading for r in sorted(rows, key=lambda r: (r.component, r.feature))]).reshape(5, 5)

    assert np.allclose(table(), vectors) and np.allclose(table(power=0), np.abs(vectors))
    assert np.allclose(table(scaled=True), vectors * np.sqrt(values)[:, None])
    # Squares of scaled loadings add up to the variance of each feature.
    assert np.allclose(table(scaled=True, power=2).sum(axis=0), x.var(axis=0, ddof=1))
