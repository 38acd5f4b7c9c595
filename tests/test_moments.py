"""Co-moment matrices, the search over moments, and the split into few and many distinct values, against numpy and pandas."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelspark.operators import linear_search, models as M, moments, profile, selection
from panelspark.operators.moments import Moments
from tests.test_plans import _cd


def _table(spark, frame):
    cols = list(frame.columns)
    rows = [[None if pd.isna(v) else float(v) for v in r] for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(5)


@pytest.mark.parametrize("block", [256, 3])
def test_correlations_pairwise_complete(spark, monkeypatch, block):
    monkeypatch.setattr(moments, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7)) + 1e6 * np.arange(7)  # means far beyond the spread
    x[:, 3] = x[:, 2] * -2 + rng.normal(size=300) * 0.1
    x[:, 5] = 4.0
    frame = pd.DataFrame(x, columns=[f"c {i}" for i in range(7)])
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    frame["none"] = np.nan
    want = frame.corr(min_periods=2)
    got = {(r["a"], r["b"]): r["corr"] for r in moments.correlations(_table(spark, frame), frame.columns).collect()}
    assert len(got) == 64
    for (a, b), v in got.items():
        if "c 5" in (a, b) or "none" in (a, b):
            assert v is None
        else:
            assert abs(v - want.loc[a, b]) < 1e-9


def test_correlations_of_nan_and_single_rows(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 1), (2.0, 1.0, 2), (4.0, 3.0, None)], "a double, b double, c int")
    got = {(r["a"], r["b"]): r["corr"] for r in moments.correlations(df, ["a", "b", "c"]).collect()}
    assert np.isnan(got["a", "b"]) and np.isnan(got["b", "b"]) and abs(got["a", "c"] - 1) < 1e-12
    assert moments.correlations(df.limit(0), ["a", "b"]).collect() == []


def test_correlation_of_many_columns_is_one_small_plan(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(400, 150)), columns=[f"x{i}" for i in range(150)])
    out = profile.corr_matrix(_table(spark, frame), list(frame.columns), digits=None).toPandas().pivot(index="a", columns="b", values="corr")
    want = frame.corr()
    assert np.abs(out.loc[want.index, want.columns].to_numpy() - want.to_numpy()).max() < 1e-9


def _folds(spark, rows=200, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(rows, 4)) * [1.0, 5.0, 0.2, 2.0] + [0, 100, 0, -3]
    y = 2.0 + X @ np.array([1.5, -0.3, 4.0, 0.0]) + rng.normal(size=rows) * 2
    fold = np.arange(rows) % 5
    df = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(X, y, fold)], "a double, b double, c double, d double, label double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df), X, y, fold


def _expected(algo, p, X, y):
    Xc, yc = X - X.mean(0), y - y.mean()
    if algo == "linear" and not p.get("fit_intercept", True):
        return np.linalg.lstsq(X, y, rcond=None)[0], 0.0
    if algo == "linear":
        w = np.linalg.lstsq(Xc, yc, rcond=None)[0]
    elif algo == "ridge":
        w = np.linalg.solve(Xc.T @ Xc + p["alpha"] * np.eye(X.shape[1]), Xc.T @ yc)
    else:
        w = _cd(X, y, p["alpha"], p.get("l1_ratio", 1.0))
    return w, y.mean() - w @ X.mean(0)


@pytest.mark.parametrize("algo, grid", [
    ("linear", {"fit_intercept": [True, False]}), ("ridge", {"alpha": [0.001, 1, 100]}),
    ("lasso", {"alpha": [0.01, 0.5], "max_iter": [5000]}), ("elasticnet", {"alpha": [0.1], "l1_ratio": [0.1, 0.7], "max_iter": [5000]})])
def test_search_equals_fits_of_each_fold(spark, algo, grid):
    d, X, y, fold = _folds(spark)
    for r in M.grid_search(spark, d.repartition(7), algo, grid, n_random=None).collect():
        p, tr, te = json.loads(r["params"]), [], []
        for k in range(5):
            w, b = _expected(algo, p, X[fold != k], y[fold != k])
            tr.append(-np.mean((y - X @ w - b)[fold != k] ** 2))
            te.append(-np.mean((y - X @ w - b)[fold == k] ** 2))
        assert abs(r["mean_train_score"] - np.mean(tr)) < 1e-6 and abs(r["mean_test_score"] - np.mean(te)) < 1e-6


def test_predefined_split_penalty_refers_to_the_training_rows(spark):
    d, X, y, fold = _folds(spark)
    d = d.withColumn("fold", F.when(F.col("fold") < 3, -1).otherwise(0))
    r = M.grid_search(spark, d, "ridge", {"alpha": [100.0]}, n_random=None).first()
    w, b = _expected("ridge", {"alpha": 100.0}, X[fold < 3], y[fold < 3])
    assert abs(r["mean_test_score"] + np.mean((y - X @ w - b)[fold >= 3] ** 2)) < 1e-9


def test_search_reads_the_rows_once_and_drops_null_folds(spark):
    d, X, y, fold = _folds(spark, rows=60)
    d = d.withColumn("fold", F.when(F.col("fold") == 4, None).otherwise(F.col("fold")))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    plain = d.select("label", "fold", F.to_json(F.array("a", "b", "c", "d")).alias("x"))
    counted = plain.coalesce(1).mapInArrow(count, plain.schema)
    counted = VectorAssembler(inputCols=["e0", "e1", "e2", "e3"], outputCol="features").transform(
        counted.select("label", "fold", *[F.from_json("x", "array<double>")[i].alias(f"e{i}") for i in range(4)]))
    got = M.grid_search(spark, counted, "ridge", M.GRIDS["ridge"], n_random=None)
    assert got.count() == 15
    assert reads.value <= 3 * 60  # the moments, and the first row of two reads


def test_moments_add_up():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(50, 3)) + 7
    of = lambda a: Moments(len(a), a.mean(0), (a - a.mean(0)).T @ (a - a.mean(0)))
    both, all_ = of(z[:20]) + of(z[20:]), of(z)
    assert both.n == 50 and np.allclose(both.mean, all_.mean) and np.allclose(both.c, all_.c)
    empty = Moments(0, np.zeros(0), np.zeros((0, 0)))
    assert (empty + all_) is all_ and (all_ + empty) is all_


def test_linear_with_dependent_columns():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    X = np.column_stack((x, x[:, 0] + x[:, 1], np.ones(80)))
    y = x @ [1.0, -2.0] + 3
    z = np.column_stack((X, y))
    m = Moments(80, z.mean(0), (z - z.mean(0)).T @ (z - z.mean(0)))
    w, b = linear_search.solve("linear", {}, m)
    assert np.abs(X @ w + b - y).max() < 1e-9 and linear_search.mse(m, w, b) < 1e-12


def test_few_and_many_distinct_values(spark):
    nan = float("nan")
    rows = [(float(i % 5), i % 4 if i % 3 else None, float(i % 5) if i % 7 else None, -0.0 if i % 2 else 0.0, nan if i % 2 else 1.0, None, i % 6) for i in range(200)]
    names = ["five", "four_null", "five_null", "zeros", "nan_one", "none", "six"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" if n != "four_null" and n != "six" else f"{n} int" for n in names)).repartition(6)
    few, many = selection.classify_numeric(df, names)
    assert few == ["five", "four_null", "zeros", "nan_one", "none"] and many == ["five_null", "six"]
    assert selection.classify_numeric(df.limit(0), names) == (names, [])
    assert selection.classify_numeric(df, []) == ([], [])


def test_classify_many_columns(spark):
    df = spark.range(2000).select(*[(F.xxhash64("id", F.lit(i)) % (3 + i)).cast("double").alias(f"w{i}") for i in range(150)])
    few, many = selection.classify_numeric(df, df.columns)
    assert few == ["w0"] and many == df.columns[1:]  # remainders from -2 to 2, and wider ones
