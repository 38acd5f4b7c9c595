"""Least squares by stacked triangles against numpy, with dependent columns and few rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelspark.operators.tall_qr import least_squares


def frame(spark, X, y, parts=5):
    rows = [([float(v) for v in r], None if t is None else float(t)) for r, t in zip(X, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(parts).select(array_to_vector("x").alias("features"), "label")


def expected(Z, y):
    beta = np.linalg.lstsq(Z, y, rcond=None)[0]
    s2 = np.sum((y - Z @ beta) ** 2) / (len(y) - Z.shape[1])
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(Z.T @ Z)))


@pytest.mark.parametrize("intercept", [True, False])
def test_full_rank(spark, intercept):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(90, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 0]
    y = X @ [1.0, 2e-4, 3e3] + 5 + rng.normal(size=90)
    got = least_squares(frame(spark, X, y), fit_intercept=intercept)
    beta, error = expected(np.column_stack((X, np.ones(90))) if intercept else X, y)
    assert got.n == 90 and got.rank == 3 + intercept and got.degrees_of_freedom == 87 - intercept
    assert np.allclose(got.coefficients, beta, rtol=1e-7) and np.allclose(got.std_errors, error, rtol=1e-6)


def test_dependent_columns_are_reported(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 4, 200)
    x = rng.normal(size=200)
    X = np.column_stack([g == 0, g == 1, g == 2, g == 3, x, 2 * x - 1, np.zeros(200)]).astype(float)
    y = np.array([1.0, -2.0, 4.0, 0.5])[g] + 3 * x + rng.normal(size=200)
    got = least_squares(frame(spark, X, y))
    beta, error = expected(np.column_stack((X[:, [0, 1, 2, 4]], np.ones(200))), y)
    assert got.rank == 5 and np.isnan(got.coefficients[[3, 5, 6]]).all()
    assert np.allclose(got.coefficients[[0, 1, 2, 4, 7]], beta) and np.allclose(got.std_errors[[0, 1, 2, 4, 7]], error)


def test_fewer_rows_than_columns_null_labels_and_no_rows(spark):
    got = least_squares(frame(spark, [[1.0, 2.0, 3.0], [2.0, 1.0, 0.0], [5.0, 5.0, 5.0]], [1.0, 2.0, None], parts=2))
    assert got.n == 2 and got.rank == 2 and got.degrees_of_freedom == 0 and np.isnan(got.std_errors).all()
    with pytest.raises(ValueError):
        least_squares(frame(spark, [[1.0]], [None]).where(F.lit(False)))
