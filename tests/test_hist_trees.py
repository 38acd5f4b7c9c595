"""Histogram trees against brute-force splits, closed forms of the penalties, Spark's boosting and planted outliers."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelspark.operators import models as M
from panelspark.operators.hist_trees import HistTreeRegressor, TreeSpec

ONE = dict(n_estimators=1, learning_rate=1.0)


def frame(spark, X, y, parts=3):
    rows = [([float(v) for v in r], None if t is None else float(t)) for r, t in zip(X, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(parts).select(array_to_vector("x").alias("features"), "label")


def grown(X, y, depth, split_rows=2, child_rows=1):
    """Exact regression tree, as the list of predictions of its own rows."""
    out = np.full(len(y), y.mean())

    def go(rows, depth):
        out[rows] = y[rows].mean()
        if not depth or len(rows) < split_rows or np.ptp(y[rows]) == 0:
            return
        best = None
        for f in range(X.shape[1]):
            for c in np.unique(X[rows, f])[:-1]:
                a, b = rows[X[rows, f] <= c], rows[X[rows, f] > c]
                if min(len(a), len(b)) >= child_rows:
                    loss = ((y[a] - y[a].mean()) ** 2).sum() + ((y[b] - y[b].mean()) ** 2).sum()
                    if best is None or loss < best[0] - 1e-9:
                        best = loss, a, b
        if best:
            go(best[1], depth - 1)
            go(best[2], depth - 1)

    go(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("criterion,split_rows,child_rows", [("squared_error", 2, 1), ("friedman_mse", 12, 3)])
def test_tree_is_the_brute_force_tree(spark, criterion, split_rows, child_rows):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 12, (60, 3)).astype(float)
    y = np.round(X[:, 0] * 2 + (X[:, 1] > 5) * 7 + rng.normal(size=60), 3)
    spec = TreeSpec(**ONE, max_depth=3, criterion=criterion, min_split_rows=split_rows, min_child_rows=child_rows)
    data = frame(spark, X, y)
    rows = HistTreeRegressor(spec).fit(data).transform(data).select("features", "label", "prediction").collect()
    want = {(tuple(x), t): p for x, t, p in zip(X.tolist(), y.tolist(), grown(X, y, 3, split_rows, child_rows))}
    assert len(rows) == 60
    for r in rows:
        assert r["prediction"] == pytest.approx(want[tuple(r["features"].toArray().tolist()), r["label"]], abs=1e-9)


def test_penalties_on_one_split(spark):
    X, y = [[0.0]] * 4 + [[1.0]] * 6, np.array([0.0] * 4 + [10.0] * 6)  # mean 6: G is 24 on the left, -24 on the right
    data = frame(spark, X, y)

    def leaves(**kw):
        t = HistTreeRegressor(TreeSpec(**ONE, max_depth=2, **kw)).fit(data).tables()[0]
        return [t["value"][k] for k in (t["left"][0], t["right"][0])] if t["feature"][0] >= 0 else None

    assert leaves() == pytest.approx([-6.0, 4.0])
    assert leaves(reg_lambda=2.0) == pytest.approx([-4.0, 3.0])
    assert leaves(reg_alpha=4.0) == pytest.approx([-5.0, 20 / 6])
    assert leaves(reg_lambda=2.0, reg_alpha=4.0) == pytest.approx([-20 / 6, 2.5])
    assert leaves(gamma=239.9) is not None and leaves(gamma=240.1) is None  # gain 24^2/4 + 24^2/6
    assert leaves(min_child_rows=5) is None and leaves(min_child_weight=4.0) is not None
    assert leaves(min_split_rows=11) is None


def test_num_leaves_splits_the_best_leaf_first(spark):
    # the right half holds the two largest gains below the root, the left half small ones
    x = np.arange(8.0)
    y = np.array([0, 1, 2, 3, 100, 140, 300, 380], float)
    data = frame(spark, x[:, None], y)
    deep = TreeSpec(**ONE, max_depth=8, num_leaves=4)
    got = {r["features"][0]: r["prediction"] for r in HistTreeRegressor(deep).fit(data).transform(data).collect()}
    # root between 5 and 6 or 3 and 4 by gain; then the greatest gains of all leaves
    groups, want = [np.arange(8)], None
    while len(groups) < 4:
        best = max(((((y[g] - y[g].mean()) ** 2).sum() - ((y[g[:c]] - y[g[:c]].mean()) ** 2).sum() - ((y[g[c:]] - y[g[c:]].mean()) ** 2).sum()), k, c)
                   for k, g in enumerate(groups) for c in range(1, len(g)))
        g = groups.pop(best[1])
        groups += [g[:best[2]], g[best[2]:]]
    want = {float(x[i]): y[g].mean() for g in groups for i in g}
    assert got == pytest.approx(want)


def test_boosting_is_brute_force_boosting(spark):
    rng = np.random.default_rng(4)
    X = rng.integers(0, 15, (80, 2)).astype(float)
    y = X[:, 0] ** 2 / 9 - X[:, 1] + rng.normal(size=80)
    margin = np.full(80, y.mean())
    for _ in range(12):  # past the trees after which predictions are written
        margin = margin + 0.3 * grown(X, y - margin, 2)
    data = frame(spark, X, y)
    got = {r["label"]: r["prediction"] for r in HistTreeRegressor(TreeSpec(n_estimators=12, learning_rate=0.3, max_depth=2)).fit(data).transform(data).collect()}
    assert got == pytest.approx(dict(zip(y.tolist(), margin)), abs=1e-8)


def test_boosting_agrees_with_sparks_trees(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 4))
    y = np.sin(X[:, 0] * 2) * 3 + X[:, 1] * X[:, 2] + rng.normal(scale=0.2, size=600)
    data = frame(spark, X, y).cache()
    # Spark's squared loss follows twice the residual, so half the rate gives the same steps after its first, unshrunk tree
    ours = HistTreeRegressor(TreeSpec(n_estimators=8, learning_rate=0.8, max_depth=3, bins=32)).fit(data)
    theirs = GBTRegressor(featuresCol="features", labelCol="label", maxIter=8, stepSize=0.4, maxDepth=3, maxBins=32).fit(data)
    mse = [m.transform(data).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0] for m in (ours, theirs)]
    data.unpersist()
    assert mse[0] < 0.2 * y.var() and mse[0] == pytest.approx(mse[1], rel=0.2)


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, 400).astype(float)
    clean = x * 5
    y = clean + rng.normal(scale=0.1, size=400)
    y[::23] += 500
    data = frame(spark, x[:, None], y)

    def error(loss):
        spec = TreeSpec(n_estimators=8, learning_rate=0.5, max_depth=2, loss=loss)
        return max(abs(r["prediction"] - r["features"][0] * 5) for r in HistTreeRegressor(spec).fit(data).transform(data).collect())

    assert error("huber") < 1.0 < 10 < error("squared_error")


def test_forest_and_edges(spark, tmp_path):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 5))
    y = X[:, 0] * 4 + X[:, 3]
    data = frame(spark, X, y)
    spec = TreeSpec(n_estimators=6, max_depth=6, forest=True, bootstrap=True, max_features="sqrt", trees_per_pass=3, min_split_rows=5)
    model = HistTreeRegressor(spec).fit(data)
    assert len({str(t) for t in model.tables()}) == 6
    path = str(tmp_path / "m")
    PipelineModel(stages=[model]).write().save(path)
    again = PipelineModel.load(path)
    odd = data.unionByName(spark.createDataFrame([(None, 1.0)], "x array<double>, label double")
                           .select(F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(F.lit(0.0))))).alias("features"), "label"))
    out = again.transform(odd).collect()
    assert sum(r["prediction"] is None for r in out) == 1
    assert np.mean([(r["prediction"] - r["label"]) ** 2 for r in out if r["prediction"] is not None]) < 0.5 * y.var()
    same = HistTreeRegressor(TreeSpec(**ONE)).fit(frame(spark, X, [2.0] * 299 + [None]))
    assert same.tables()[0]["feature"] == [-1] and same.transform(data).first()["prediction"] == 2.0
    with pytest.raises(ValueError):
        HistTreeRegressor(TreeSpec()).fit(data.limit(0))


def test_blocks_keep_every_core_busy_and_leave_no_files(spark):
    import os

    from panelspark.operators import hist_trees
    from panelspark.session import ensure_checkpoint_dir
    rng = np.random.default_rng(8)
    X = rng.integers(0, 9, (500, 2)).astype(float)
    data = frame(spark, X, X[:, 0] * 3 + X[:, 1], parts=1)
    seen = []
    grow = hist_trees._grow
    try:
        hist_trees._grow = lambda rows, *a: (seen.append(len(rows.inputFiles())), grow(rows, *a))[1]
        HistTreeRegressor(TreeSpec(n_estimators=6, max_depth=2)).fit(data)
    finally:
        hist_trees._grow = grow
    assert len(seen) == 6 and min(seen) >= 1
    folder = os.path.join(ensure_checkpoint_dir(spark), "trees").removeprefix("file:")
    assert os.listdir(folder) == []


def test_best_cut_equals_all_cuts():
    from panelspark.operators.hist_trees import _best_cut
    rng = np.random.default_rng(9)
    n = rng.integers(0, 4, (3, 6)).astype(float)
    n[:, 0] += 30 - n.sum(axis=1)
    g = rng.normal(size=(3, 6)) * n
    g[:, 0] += 5 - g.sum(axis=1)
    spec = TreeSpec(min_child_rows=2, reg_lambda=1.0)
    want = max((gl**2 / (nl + 1) + (5 - gl)**2 / (31 - nl) - 25 / 31, -f, -b) for f in (0, 2) for b in range(5)
               for gl, nl in [(g[f, :b + 1].sum(), n[f, :b + 1].sum())] if 2 <= nl <= 28)
    total, cut = _best_cut(np.stack((n, g, n), axis=1), np.array([True, False, True]), spec)
    assert total == pytest.approx([30, 5, 30]) and cut[:3] == [-want[1], -want[2], pytest.approx(want[0])]


def test_leafwise_query_grows_the_profiles_trees(monkeypatch):
    """As many trees and leaves as the profile's grid has at least, on every row."""
    from panelspark import queries_ml
    got = []
    monkeypatch.setattr(queries_ml, "_fit_eval", lambda spark, root, algo, params: got.append((algo, params)))
    queries_ml.q_fit_gbt_leafwise(None, None)
    (algo, params), grid = got[0], M.GRIDS["gbt_lgbm_profile"]
    assert algo == "gbt_lgbm_profile" and all(params[k] >= min(grid[k]) for k in ("n_estimators", "num_leaves", "learning_rate"))
    assert params.get("subsample", 1.0) == 1.0 and set(params) <= set(grid)


def test_settings_reach_the_grower():
    lgbm = M.build_estimator("gbt_lgbm_profile", {"max_depth": -1, "learning_rate": 0.1, "num_leaves": 31, "min_child_samples": 10,
                                                  "reg_alpha": 0.1, "reg_lambda": 1, "subsample": 0.8, "n_estimators": 5})
    assert (lgbm.spec.num_leaves, lgbm.spec.reg_alpha, lgbm.spec.reg_lambda, lgbm.spec.min_child_rows, lgbm.spec.max_depth) == (31, 0.1, 1.0, 10, M.MAX_TREE_DEPTH)
    assert M.build_estimator("gbt", {"loss": "huber", "n_estimators": 3}).spec.loss == "huber"
    assert M.build_estimator("gbt_cat_profile", {"depth": 4, "iterations": 7, "l2_leaf_reg": 3}).spec.reg_lambda == 3
    tree = M.build_estimator("tree", {"criterion": "friedman_mse", "min_samples_split": 5, "max_depth": None}).spec
    assert (tree.n_estimators, tree.learning_rate, tree.min_split_rows, tree.criterion) == (1, 1.0, 5, "friedman_mse")
    forest = M.build_estimator("forest", {"min_samples_split": 10, "bootstrap": True, "max_features": "log2", "n_estimators": 9}).spec
    assert forest.forest and forest.bootstrap and forest.min_split_rows == 10
    for algo, grid in M.GRIDS.items():
        for p in M.settings(grid, 40):
            M.build_estimator(algo, p, M.LabelStats(10, 1.0, 1.0))
