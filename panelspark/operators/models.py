"""Regressors, hyperparameter search, selection and scoring.

Every fit is a distributed Spark ML job. Searches evaluate settings with
``RegressionEvaluator`` on held-out rows of the same DataFrame (a ``split`` or
``fold`` column), so nothing but result rows (one per setting) reaches the driver.
Penalties are mapped from the reference's parameterisation to Spark's:
Spark scales the L2 term by the label std, so n and sigma_y are aggregated first.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import linear_search
from panelspark.operators.hist_trees import HistTreeRegressor, TreeSpec
from panelspark.operators.moments import MAX_FEATURES, fold_moments

# Search grids under the reference's parameter names. Settings that Spark's trees lack (huber, min_samples_split over
# 2, friedman_mse, num_leaves, reg_alpha, reg_lambda, l2_leaf_reg) go to ``hist_trees``. There min_child_weight is the least sum of
# curvature, the row count under squared error, gamma the least gain, and colsample_bytree draws columns for each tree. Without such a
# setting Spark's own trees serve: gamma is then minInfoGain (label variance per row) and colsample_bytree draws columns for each node.
# Depth -1 or None is the deepest tree, ``MAX_TREE_DEPTH``.
GRIDS = {
    "linear": {"fit_intercept": [True, False]},
    "ridge": {"alpha": [0.001, 0.01, 0.1, 1, 10], "max_iter": [1000, 5000, 10000]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1, 10], "max_iter": [1000, 5000, 10000]},
    "elasticnet": {"alpha": [0.001, 0.01, 0.1, 1], "l1_ratio": [0.1, 0.5, 0.7, 1], "max_iter": [1000, 5000, 10000]},
    "tree": {"criterion": ["squared_error", "friedman_mse"], "max_depth": [None, 2, 3, 4, 5, 7, 9, 12, 15],
             "min_samples_leaf": [1, 2, 5, 10, 20], "min_samples_split": [2, 5, 10]},
    "forest": {"bootstrap": [True, False], "max_features": ["sqrt", "log2", None],
               "max_depth": [None, 2, 3, 5, 7, 9, 12, 15], "min_samples_leaf": [1, 2, 5, 10, 20], "min_samples_split": [2, 5, 10],
               "n_estimators": [100, 200, 500, 1000]},
    "gbt": {"loss": ["squared_error", "huber"], "learning_rate": [0.001, 0.01, 0.1, 0.2],
            "min_samples_leaf": [1, 2, 5, 10], "max_depth": [3, 4, 5, 7, 9], "n_estimators": [100, 200, 500]},
    # profiles of the boosting libraries
    "gbt_xgb_profile": {"max_depth": [3, 5, 7, 10], "learning_rate": [0.001, 0.01, 0.05, 0.1],
                        "n_estimators": [100, 200, 500], "min_child_weight": [1, 3, 5], "gamma": [0, 0.1, 0.5],
                        "reg_lambda": [0, 0.1, 1, 10]},
    "gbt_lgbm_profile": {"max_depth": [-1, 3, 5, 7], "learning_rate": [0.001, 0.01, 0.05, 0.1], "num_leaves": [31, 63, 127],
                         "min_child_samples": [10, 20, 30], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0],
                         "reg_alpha": [0.0, 0.1], "reg_lambda": [0.0, 0.1, 1], "n_estimators": [100, 200, 500]},
    "gbt_cat_profile": {"depth": [4, 6, 10], "learning_rate": [0.01, 0.05, 0.1], "iterations": [100, 200, 500],
                        "l2_leaf_reg": [1, 3, 5, 7, 9]},
}
MAX_TREE_DEPTH = 30  # Spark's limit; stands for "no limit"
GUARD = (0.7, 1.3)   # accepted train/test MSE ratio in the guarded choice


class UnsupportedSetting(ValueError):
    """A setting that has no Spark equivalent."""


@dataclass
class LabelStats:
    n: int
    std_pop: float
    std_samp: float


def label_stats(df: DataFrame, label: str) -> LabelStats:
    r = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("p"), F.stddev_samp(label).alias("s")).first()
    return LabelStats(int(r["n"]), float(r["p"] or 0.0), float(r["s"] or 0.0))


def _depth(d):
    if d is None or int(d) == -1:
        return MAX_TREE_DEPTH
    if int(d) > MAX_TREE_DEPTH:
        raise UnsupportedSetting(f"max_depth {d} is above Spark's limit of {MAX_TREE_DEPTH}")
    return int(d)


def _needs_histograms(p: dict) -> bool:
    """Whether a setting asks for what Spark's trees lack."""
    return (p.get("loss") == "huber" or p.get("criterion") == "friedman_mse" or int(p.get("min_samples_split", 2)) > 2
            or p.get("num_leaves") is not None or any(float(p.get(k, 0)) for k in ("reg_alpha", "reg_lambda", "l2_leaf_reg")))


def _histogram_spec(algo: str, p: dict, seed: int) -> TreeSpec:
    common = dict(max_depth=_depth(p.get("max_depth", p.get("depth", 3) if algo.startswith("gbt") else None)), seed=seed,
                  criterion=p.get("criterion", "squared_error"), min_split_rows=int(p.get("min_samples_split", 2)),
                  min_child_rows=int(p.get("min_samples_leaf", p.get("min_child_samples", 1))))
    if algo == "tree":
        return TreeSpec(n_estimators=1, learning_rate=1.0, **common)
    if algo == "forest":
        return TreeSpec(n_estimators=int(p.get("n_estimators", 100)), forest=True, bootstrap=bool(p.get("bootstrap", True)),
                        max_features=p.get("max_features"), **common)
    return TreeSpec(n_estimators=int(p.get("n_estimators", p.get("iterations", 100))), learning_rate=float(p.get("learning_rate", 0.1)),
                    loss=p.get("loss", "squared_error"), num_leaves=p.get("num_leaves"), gamma=float(p.get("gamma", 0.0)),
                    min_child_weight=float(p.get("min_child_weight", 0.0)), reg_alpha=float(p.get("reg_alpha", 0.0)),
                    reg_lambda=float(p.get("reg_lambda", p.get("l2_leaf_reg", 0.0))), subsample=float(p.get("subsample", 1.0)),
                    colsample=float(p.get("colsample_bytree", 1.0)), **common)


def build_estimator(algo: str, params: dict, stats: LabelStats | None = None,
                    features: str = "features", label: str = "label", seed: int = 42):
    """Spark estimator for a reference-style (algorithm, params) pair."""
    p = dict(params)
    common = dict(featuresCol=features, labelCol=label)
    if algo == "linear":
        # auto: normal equations up to 4,096 features, l-bfgs beyond
        return LinearRegression(regParam=0.0, solver="auto", fitIntercept=bool(p.get("fit_intercept", True)), **common)
    if algo == "ridge":
        a = float(p["alpha"])
        # sum-of-squares + alpha*|w|^2  ==  Spark's 1/(2n) loss + regParam/2 * |w|^2 with label scaling
        reg = a * stats.std_pop / stats.n
        return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="auto",
                                maxIter=int(p.get("max_iter", 100)), **common)
    if algo == "lasso":
        return LinearRegression(regParam=float(p["alpha"]), elasticNetParam=1.0, standardization=False,
                                solver="l-bfgs", maxIter=int(p.get("max_iter", 100)), tol=1e-10, **common)
    if algo == "elasticnet":
        a, l1 = float(p["alpha"]), float(p["l1_ratio"])
        reg = a * l1 + a * (1 - l1) * stats.std_samp
        return LinearRegression(regParam=reg, elasticNetParam=(a * l1 / reg) if reg else 0.0,
                                standardization=False, solver="l-bfgs", maxIter=int(p.get("max_iter", 100)),
                                tol=1e-10, **common)
    if (algo in ("tree", "forest") or algo.startswith("gbt")) and _needs_histograms(p):
        return HistTreeRegressor(_histogram_spec(algo, p, seed), features, label)
    if algo == "tree":
        return DecisionTreeRegressor(maxDepth=_depth(p.get("max_depth")),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=seed, **common)
    if algo == "forest":
        mf = p.get("max_features")
        return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), bootstrap=bool(p.get("bootstrap", True)),
                                     featureSubsetStrategy="all" if mf is None else mf,
                                     maxDepth=_depth(p.get("max_depth")),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=seed, **common)
    if algo.startswith("gbt"):
        loss = p.get("loss", "squared_error")
        if loss not in ("squared_error", "absolute_error"):
            raise UnsupportedSetting(f"loss {loss!r} has no Spark GBT equivalent")
        return GBTRegressor(
            lossType="squared" if loss == "squared_error" else "absolute",
            stepSize=float(p.get("learning_rate", 0.1)),
            maxDepth=_depth(p.get("max_depth", p.get("depth", 3))),
            maxIter=int(p.get("n_estimators", p.get("iterations", 100))),
            minInstancesPerNode=int(p.get("min_samples_leaf", p.get("min_child_samples", p.get("min_child_weight", 1)))),
            minInfoGain=float(p.get("gamma", 0.0)),
            subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy="all" if float(p.get("colsample_bytree", 1.0)) >= 1.0
            else str(p.get("colsample_bytree")),
            seed=seed, **common)
    raise ValueError(f"unknown algorithm {algo!r}")


def settings(grid: dict, n_random: int | None = None, seed: int = 42) -> list[dict]:
    """Full grid, or ``n_random`` settings drawn without replacement (seeded)."""
    keys = list(grid)
    full = [dict(zip(keys, v)) for v in itertools.product(*[grid[k] for k in keys])]
    if n_random is None or n_random >= len(full):
        return full
    return random.Random(seed).sample(full, n_random)


def _mse(pred: DataFrame, label: str) -> float:
    return RegressionEvaluator(metricName="mse", labelCol=label, predictionCol="prediction").evaluate(pred)


def grid_search(spark: SparkSession, data: DataFrame, algo: str, grid: dict, label: str = "label",
                features: str = "features", fold_col: str = "fold", n_random: int | None = 10,
                seed: int = 42, parallelism: int = 1) -> DataFrame:
    """M8 + X4/X5: evaluate settings on held-out folds; scores are -MSE.

    ``fold_col`` holds the fold id of each row. Value -1 marks rows that are
    always in training (X5 predefined split: train = -1, validation = 0); with
    folds 0..k-1 only, it is k-fold CV (X4). A setting without a Spark equivalent scores NaN.
    Returns one row per setting: params, mean_train_score, mean_test_score, rank.
    Linear algorithms with up to ``MAX_FEATURES`` features are solved from the folds' moments: the data
    are read once for all settings. Others are fitted setting by setting, ``parallelism`` of them
    concurrently (each fit is a distributed job; the driver threads only submit them).
    """
    items = list(enumerate(settings(grid, n_random, seed)))
    if algo in linear_search.ALGORITHMS:
        width = data.where(F.col(features).isNotNull()).select(F.size(vector_to_array(features))).first()
        if width is None or width[0] <= MAX_FEATURES:
            found = linear_search.search(algo, [p for _, p in items], fold_moments(data, features, label, fold_col))
            return _ranked(spark, [(i, json.dumps(p, sort_keys=True), tr, te) for (i, p), (tr, te) in zip(items, found)])
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect() if r[0] is not None and r[0] >= 0)
    # a penalty refers to the rows that are trained on
    stats = {k: label_stats(data.filter(F.col(fold_col) != k), label) for k in folds}

    def evaluate(item):
        i, p = item
        tr_scores, te_scores = [], []
        try:
            for k in folds:
                train = data.filter(F.col(fold_col) != k)
                test = data.filter(F.col(fold_col) == k)
                m = build_estimator(algo, p, stats[k], features, label, seed).fit(train)
                tr_scores.append(-_mse(m.transform(train), label))
                te_scores.append(-_mse(m.transform(test), label))
        except UnsupportedSetting:  # scores NaN and ranks last; every other failure is raised
            tr_scores, te_scores = [math.nan], [math.nan]
        return (i, json.dumps(p, sort_keys=True), float(sum(tr_scores) / len(tr_scores)),
                float(sum(te_scores) / len(te_scores)))

    if parallelism > 1:
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(evaluate, items))
    else:
        rows = [evaluate(it) for it in items]
    return _ranked(spark, rows)


def _ranked(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    # rank over the result rows (one per setting, already on the driver); NaN ranks last
    order = sorted(rows, key=lambda r: (math.isnan(r[3]), -r[3] if not math.isnan(r[3]) else 0.0, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(order)}
    ranked = [r + (rank[r[0]],) for r in rows]
    return spark.createDataFrame(
        ranked, "setting int, params string, mean_train_score double, mean_test_score double, rank_test_score int")


def guarded_choice(results: DataFrame, lo: float = GUARD[0], hi: float = GUARD[1]) -> DataFrame:
    """M9: best-ranked setting whose train/test score ratio is in [lo, hi], else the best."""
    r = results.withColumn("div", F.try_divide(F.col("mean_train_score"), F.col("mean_test_score")))
    r = r.withColumn("ok", F.coalesce((F.col("div") >= lo) & (F.col("div") <= hi), F.lit(False)).cast("int"))
    return (r.orderBy(F.col("ok").desc(), F.col("rank_test_score"), F.col("setting")).limit(1))


def fit_final(train: DataFrame, feature_model: PipelineModel, algo: str, params: dict, label: str = "label",
              seed: int = 42) -> PipelineModel:
    """Feature pipeline + model with the chosen params, fit on train+val rows."""
    stats = label_stats(train, label)
    est = build_estimator(algo, params, stats, "features", label, seed)
    model = est.fit(feature_model.transform(train))
    return PipelineModel(stages=list(feature_model.stages) + [model])


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def leaderboard(spark: SparkSession, scores: Sequence[tuple[str, float]]) -> DataFrame:
    """Algorithms by test MSE ascending, with the arg-min flagged."""
    df = spark.createDataFrame(list(scores), "algorithm string, mse double")
    best = df.select(F.min_by("algorithm", "mse")).scalar()
    return df.withColumn("is_best", F.col("algorithm") == best).orderBy("mse", "algorithm")


def score_all(model: PipelineModel, rows: DataFrame, report: Sequence[str],
              name: str = "predicted_points_next_game") -> DataFrame:
    """The prediction of every scoring row next to its ``report`` columns."""
    return model.transform(rows).select(*report, F.col("prediction").alias(name))


def score_topk(model: PipelineModel, rows: DataFrame, report: Sequence[str], k: int = 10,
               name: str = "predicted_points_next_game") -> DataFrame:
    """The top ``k`` of ``score_all`` by prediction (TakeOrdered)."""
    pred = score_all(model, rows, report, name)
    return pred.orderBy(F.col(name).desc(), *report).limit(k)
