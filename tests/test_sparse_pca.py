"""Sparse components against numpy on the dense, centred matrix."""

import numpy as np
import pytest

from ticketscope.operators.sparse_pca import SparsePca, apply_sparse_pca, fit_sparse_pca, sparse_rows


def matrix(n=120, size=40, seed=3):
    r = np.random.default_rng(seed)
    low = r.standard_normal((n, 5)) @ (r.standard_normal((5, size)) * np.array([5, 4, 3, 2, 1.5])[:, None])
    x = np.where(r.random((n, size)) < 0.5, low + 0.05 * r.standard_normal((n, size)) + 2.0, 0.0)
    x[7] = 0
    return x


def as_long(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "doc_id long, index int, tfidf double").repartition(4)


def test_components_variance_and_reconstruction(spark):
    x = matrix()
    rows = sparse_rows(as_long(spark, x)).persist()
    model = fit_sparse_pca(rows, size=40, k=6, n=len(x), tol=1e-12, max_passes=60)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(x) - 1))
    values, vectors = values[::-1][:6], vectors[:, ::-1][:, :6]
    assert np.allclose(model.variance, values, rtol=1e-6) and np.allclose(model.mean, x.mean(0))
    assert model.total_variance == pytest.approx(centred.var(0, ddof=1).sum())
    assert np.allclose(np.abs(model.components.T @ vectors), np.eye(6), atol=1e-3)
    got = {r.id: np.array(r.pca) for r in apply_sparse_pca(rows, model).collect()}
    assert len(got) == len(x) - 1  # the empty row has no entry
    z = np.stack([got[i] for i in sorted(got)])
    kept = np.array(sorted(got))
    assert np.allclose(z, centred[kept] @ model.components)
    # what the components leave is as small as the best rank-6 fit leaves
    left = ((centred[kept] - z @ model.components.T) ** 2).sum()
    best = ((centred - centred @ vectors @ vectors.T)[kept] ** 2).sum()
    assert left == pytest.approx(best, rel=1e-4)


def test_state_round_trip_and_small_inputs(spark, tmp_path):
    x = matrix(30, 12)
    rows = sparse_rows(as_long(spark, x))
    model = fit_sparse_pca(rows, size=12, k=100, n=30)
    assert model.components.shape == (12, 12)
    model.save(spark, str(tmp_path / "pca"))
    again = SparsePca.load(spark, str(tmp_path / "pca"))
    assert np.array_equal(again.components, model.components) and np.array_equal(again.variance, model.variance)
    empty = spark.createDataFrame([], "doc_id long, index int, tfidf double")
    assert fit_sparse_pca(sparse_rows(empty), size=5, k=2).variance.tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        fit_sparse_pca(rows, size=10 ** 6, k=100)


def test_slice_is_filled_over_its_own_terms():
    from ticketscope.operators.sparse_pca import filled
    own, x = filled(np.array([0, 0, 2]), np.array([7, 2, 2]), np.array([1.0, 2.0, 3.0]), 3, 1000)
    assert own.tolist() == [2, 7] and x.tolist() == [[2.0, 1.0], [0.0, 0.0], [3.0, 0.0]]
