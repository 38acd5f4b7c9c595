"""Registered queries: feature engineering, models, evaluation, end-to-end pipeline.

Regression input: lineitem joined to part (label ``l_extendedprice``), split by
a hash of the line key into train/test/val. Model outputs depend on solvers and
seeds, so most of these are rows-only; closed-form parts carry oracle SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import functions as F

from panelspark import oracle_sql as O
from panelspark.operators import evaluate as E
from panelspark.operators import features as FE
from panelspark.operators import models as M
from panelspark.operators.hist_trees import HistTreeRegressor, TreeSpec
from panelspark.operators import split as X
from panelspark.registry import query
from panelspark.session import cut_lineage, ensure_checkpoint_dir
from panelspark.sources import fixtures
from panelspark.sources.tables import read_table

NUM = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]
CAT = ["l_returnflag", "p_brand"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LABEL = "l_extendedprice"


def regression_input(spark, root):
    li = read_table(spark, root, "lineitem")
    p = read_table(spark, root, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(*KEY, *NUM, *CAT, F.col(LABEL).alias("label"),
                    X.split_column(KEY, 0.6, True, seed=42).alias("split"))


def _fitted(spark, root, groups=True):
    # materialised once in the shared checkpoint folder: the fits below make several passes
    data = cut_lineage(regression_input(spark, root))
    train = data.filter(F.col("split") == "train")
    pca = {"pca_all": (NUM, 3), "pca_price": (["l_quantity", "p_retailprice"], 2)} if groups else {}
    fm = FE.fit_feature_pipeline(train, FE.FeatureSpec(NUM, CAT, pca))
    return data, fm


@query("missing_indicator", O.with_(O.APPEARANCES) + """
select event_id, cast(maybe is null as integer) as missing_indicator_maybe from appearances""")
def q_missing_indicator(spark, root):
    a = fixtures.appearances(spark, root).select("event_id", "minutes", "points", "maybe")
    out = FE.missing_indicators(a, ["minutes", "points", "maybe"])
    return out.select("event_id", *[c for c in out.columns if c.startswith("missing_indicator_")])


@query("impute_median", O.with_(O.APPEARANCES) + """
select event_id, round(coalesce(maybe, (select median(maybe) from appearances)), 6) as maybe from appearances""")
def q_impute_median(spark, root):
    a = fixtures.appearances(spark, root).select("event_id", "maybe")
    return FE.impute_median(a, ["maybe"]).select("event_id", F.round("maybe", 6).alias("maybe"))


@query("standardize", O.with_(O.APPEARANCES) + """
select event_id, round((points - (select avg(points) from appearances)) /
                       (select case when stddev_pop(points) = 0 then 1 else stddev_pop(points) end from appearances), 6)
       as points_z from appearances""")
def q_standardize(spark, root):
    a = fixtures.appearances(spark, root).select("event_id", "points")
    z = FE.standardize(a, ["points"], suffix="_z")
    return z.select("event_id", F.round("points_z", 6).alias("points_z"))


SPLIT_SQL = """case when b < 6000 then 'train' when b < 8000 then 'test' else 'val' end"""
ONE_HOT_SQL = """
with d as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, p_brand,
         l_quantity, l_discount, l_tax, p_retailprice,
         """ + SPLIT_SQL + """ as split
  from (select l.*, p.p_brand, p.p_retailprice,
               cast(('0x' || substr(md5(concat_ws('|', '42', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
               cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 as b
        from lineitem l join part p on l.l_partkey = p.p_partkey) x),
c as (select list_sort(list_distinct(list(coalesce(l_returnflag, 'missing_data')))) as rf,
             list_sort(list_distinct(list(coalesce(p_brand, 'missing_data')))) as br
      from d where split = 'train')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, split,
       cast(list_transform(rf, lambda v: case when coalesce(l_returnflag, 'missing_data') = v then 1 else 0 end)
            as double[]) as l_returnflag_onehot,
       cast(list_transform(br, lambda v: case when coalesce(p_brand, 'missing_data') = v then 1 else 0 end)
            as double[]) as p_brand_onehot
from d, c"""


@query("one_hot", ONE_HOT_SQL)
def q_one_hot(spark, root):
    """fit on train rows; unseen categories in other rows encode as all zeros."""
    data, fm = _fitted(spark, root, groups=False)
    out = fm.transform(data)
    return out.select(*KEY, "split", *[vector_to_array(c + "__oh").alias(c + "_onehot") for c in CAT])


@query("pca_groups")
def q_pca_groups(spark, root):
    data, fm = _fitted(spark, root)
    out = fm.transform(data)
    return out.select(*KEY, vector_to_array("pca_all__pca").alias("pca_all"),
                      vector_to_array("pca_price__pca").alias("pca_price"))


@query("column_transformer")
def q_column_transformer(spark, root):
    data, fm = _fitted(spark, root)
    return fm.transform(data).select(*KEY, "split", vector_to_array("features").alias("features"))


FEATURE_NAMES_SQL = ONE_HOT_SQL.split("c as (")[0] + """n as (
  select 0 as part, v as k, 'l_returnflag_' || v as name
  from (select distinct coalesce(l_returnflag, 'missing_data') as v from d where split = 'train') a
  union all
  select 1, v, 'p_brand_' || v
  from (select distinct coalesce(p_brand, 'missing_data') as v from d where split = 'train') b
  union all
  select 2, k, name from (values ('0', 'l_quantity'), ('1', 'l_discount'), ('2', 'l_tax'), ('3', 'p_retailprice')) t(k, name)
  union all
  select 3, k, 'missing_indicator_' || name from (
    select '0' as k, 'l_quantity' as name from d where split = 'train' and l_quantity is null
    union select '1', 'l_discount' from d where split = 'train' and l_discount is null
    union select '2', 'l_tax' from d where split = 'train' and l_tax is null
    union select '3', 'p_retailprice' from d where split = 'train' and p_retailprice is null) m
  union all
  select 4, k, name from (values ('0', 'pca_all_pca_1'), ('1', 'pca_all_pca_2'), ('2', 'pca_all_pca_3'),
                                 ('3', 'pca_price_pca_1'), ('4', 'pca_price_pca_2')) t(k, name))
select cast(row_number() over (order by part, k) - 1 as integer) as idx, name from n"""


@query("feature_names", FEATURE_NAMES_SQL)
def q_feature_names(spark, root):
    _, fm = _fitted(spark, root)
    names = FE.feature_names(fm)
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


def _fit_eval(spark, root, algo, params):
    data, fm = _fitted(spark, root, groups=False)
    feats = fm.transform(data).select(*KEY, "features", "label", "split").cache()
    train = feats.filter(F.col("split") == "train")
    est = M.build_estimator(algo, params, M.label_stats(train, "label"))
    model = est.fit(train)
    return E.regression_metrics(model.transform(feats), "label", "prediction", "split")


@query("fit_linear")
def q_fit_linear(spark, root):
    return _fit_eval(spark, root, "linear", {"fit_intercept": True})


@query("fit_ridge")
def q_fit_ridge(spark, root):
    return _fit_eval(spark, root, "ridge", {"alpha": 1.0, "max_iter": 1000})


@query("fit_lasso")
def q_fit_lasso(spark, root):
    return _fit_eval(spark, root, "lasso", {"alpha": 0.1, "max_iter": 1000})


@query("fit_elasticnet")
def q_fit_elasticnet(spark, root):
    return _fit_eval(spark, root, "elasticnet", {"alpha": 0.1, "l1_ratio": 0.5, "max_iter": 1000})


@query("fit_tree")
def q_fit_tree(spark, root):
    return _fit_eval(spark, root, "tree", {"max_depth": 7, "min_samples_leaf": 5})


@query("fit_forest")
def q_fit_forest(spark, root):
    return _fit_eval(spark, root, "forest", {"n_estimators": 20, "max_depth": 7, "max_features": "sqrt",
                                              "bootstrap": True, "min_samples_leaf": 2})


@query("fit_gbt")
def q_fit_gbt(spark, root):
    return _fit_eval(spark, root, "gbt", {"loss": "squared_error", "learning_rate": 0.1, "max_depth": 4,
                                          "n_estimators": 20, "min_samples_leaf": 2})


@query("fit_tree_friedman")
def q_fit_tree_friedman(spark, root):
    return _fit_eval(spark, root, "tree", {"criterion": "friedman_mse", "max_depth": 5, "min_samples_leaf": 5, "min_samples_split": 10})


@query("fit_gbt_huber")
def q_fit_gbt_huber(spark, root):
    return _fit_eval(spark, root, "gbt", {"loss": "huber", "learning_rate": 0.2, "max_depth": 3, "n_estimators": 5, "min_samples_leaf": 2})


@query("fit_gbt_leafwise")
def q_fit_gbt_leafwise(spark, root):
    return _fit_eval(spark, root, "gbt_lgbm_profile", {"max_depth": -1, "num_leaves": 31, "learning_rate": 0.1, "min_child_samples": 10,
                                                       "reg_alpha": 0.1, "reg_lambda": 1, "n_estimators": 100})


# ---- models with one feature, where the optimum has a closed form ----

_STUMP_SQL = """
with d as (select l_quantity as x, l_extendedprice / 1000.0 as y from lineitem where l_quantity is not null and l_extendedprice is not null),
m as (select avg(y) as base from d),
v as (select x, sum(base - y) as g, cast(count(*) as double) as h from d, m group by x),
c as (select x, h as n, sum(g) over w as gl, sum(h) over w as hl, sum(g) over () as g, sum(h) over () as h from v window w as (order by x)),
t as (select x, n, hl, h, sign(gl) * greatest(abs(gl) - 5, 0) as tl, sign(g - gl) * greatest(abs(g - gl) - 5, 0) as tr,
        sign(g) * greatest(abs(g) - 5, 0) as tt from c),
s as (select x as cut, -tl / (hl + 50) as l, -tr / (h - hl + 50) as r from t where hl < h
      order by tl * tl / (hl + 50) + tr * tr / (h - hl + 50) - tt * tt / (h + 50) desc, x limit 1)
select x as quantity, cast(n as bigint) as n, round(base + case when x <= cut then l else r end, 4) as prediction from t, s, m"""


@query("stump_penalised", _STUMP_SQL)
def q_stump_penalised(spark, root):
    """M7: one split with both leaf penalties, against all cuts in SQL."""
    d = (read_table(spark, root, "lineitem").where(F.col("l_quantity").isNotNull() & F.col("l_extendedprice").isNotNull())
         .select(F.col("l_quantity").alias("quantity"), array_to_vector(F.array(F.col("l_quantity").cast("double"))).alias("features"),
                 (F.col("l_extendedprice") / 1000.0).alias("label")))
    model = HistTreeRegressor(TreeSpec(n_estimators=1, learning_rate=1.0, max_depth=1, reg_alpha=5.0, reg_lambda=50.0, bins=256)).fit(d)
    return (model.transform(d).groupBy("quantity")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.first("prediction"), 4).alias("prediction")))


ONE_SQL = """
with d as (select l_quantity as x, l_extendedprice / 1000.0 as y from lineitem where l_quantity is not null and l_extendedprice is not null),
m as (select avg(x) as mx, avg(y) as my, count(*) as n from d),
s as (select sum((x - mx) * (x - mx)) as sxx, sum((x - mx) * (y - my)) as sxy, sum((y - my) * (y - my)) as syy,
             any_value(mx) as mx, any_value(my) as my, any_value(n) as n from d, m),
w as (select {w} as w, * from s)
select round(w, 5) as coefficient, round(my - w * mx, 4) as intercept from w"""


def _one_feature(spark, root, algo, params):
    d = read_table(spark, root, "lineitem").select(array_to_vector(F.array("l_quantity")).alias("features"),
                                                   (F.col("l_extendedprice") / 1000.0).alias("label"))
    model = M.build_estimator(algo, params, M.label_stats(d, "label")).fit(d)
    return (spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "w double, b double")
            .select(F.round("w", 5).alias("coefficient"), F.round("b", 4).alias("intercept")))


@query("linear_closed_form", ONE_SQL.format(w="sxy / sxx"))
def q_linear_closed_form(spark, root):
    """M1 against least squares."""
    return _one_feature(spark, root, "linear", {"fit_intercept": True})


@query("ridge_closed_form", ONE_SQL.format(w="sxy / (sxx + 100000.0)"))
def q_ridge_closed_form(spark, root):
    """M2: the penalty adds to the feature's sum of squares."""
    return _one_feature(spark, root, "ridge", {"alpha": 100_000.0, "max_iter": 1000})


@query("lasso_closed_form", ONE_SQL.format(w="sign(sxy) * greatest(abs(sxy / n) - 50.0, 0) / (sxx / n)"))
def q_lasso_closed_form(spark, root):
    """M3: the mean cross product shrinks by the penalty."""
    return _one_feature(spark, root, "lasso", {"alpha": 50.0, "max_iter": 1000})


@query("elasticnet_closed_form", ONE_SQL.format(w="sign(sxy) * greatest(abs(sxy / n) - 20.0 * 0.25, 0) / (sxx / n + 20.0 * 0.75)"))
def q_elasticnet_closed_form(spark, root):
    """M4: both at once."""
    return _one_feature(spark, root, "elasticnet", {"alpha": 20.0, "l1_ratio": 0.25, "max_iter": 1000})


@query("coef_closed_form", ONE_SQL.split("w as (select")[0] + """
c as (select sxy / sxx as b, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) as se_b, my - sxy / sxx * mx as a,
             sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)) as se_a from s)
select 'l_quantity' as feature, round(b, 6) as coefficient, round(se_b, 6) as std_error, round(b / se_b, 3) as t from c
union all select 'Intercept', round(a, 6), round(se_a, 6), round(a / se_a, 3) from c""")
def q_coef_closed_form(spark, root):
    """E2 with one feature against the textbook formulas."""
    d = read_table(spark, root, "lineitem").select(array_to_vector(F.array("l_quantity")).alias("features"),
                                                   (F.col("l_extendedprice") / 1000.0).alias("label"))
    return E.coef_table(spark, d, ["l_quantity"]).select(
        "feature", F.round("coefficient", 6).alias("coefficient"), F.round("std_error", 6).alias("std_error"), F.round("t", 3).alias("t"))


@query("fold_column", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  cast(cast(('0x' || substr(md5(concat_ws('|', '43', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
  cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 % 5 as integer) as fold from lineitem""")
def q_fold_column(spark, root):
    """Five hash folds."""
    return read_table(spark, root, "lineitem").select(*KEY, X.fold_column(KEY, 5, seed=42).alias("fold"))


def _search_input(spark, root):
    data, fm = _fitted(spark, root, groups=False)
    return fm.transform(data).select(*KEY, "features", "label", "split")


@query("grid_search")
def q_grid_search(spark, root):
    """Random settings, predefined split (train = -1, val = 0), tuning sample."""
    d = _search_input(spark, root).filter(F.col("split").isin("train", "val"))
    d = d.withColumn("fold", F.when(F.col("split") == "train", -1).otherwise(0))
    d = X.sample_rows(d, 0.5, KEY, seed=42).cache()
    return M.grid_search(spark, d, "ridge", M.GRIDS["ridge"], n_random=4, fold_col="fold", parallelism=2)


@query("cv_search")
def q_cv_search(spark, root):
    """5 hash folds over train + val rows."""
    d = _search_input(spark, root).filter(F.col("split").isin("train", "val"))
    d = d.withColumn("fold", X.fold_column(KEY, 5, seed=42)).cache()
    return M.grid_search(spark, d, "linear", M.GRIDS["linear"], n_random=None, fold_col="fold")


# one feature: every fold's coefficient and squared error from sums over the other folds
_SEARCH_SQL = """
with d as (select l_quantity as x, l_extendedprice / 1000.0 as y,
    cast(('0x' || substr(md5(concat_ws('|', '43', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
    cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 % 5 as fold from lineitem where l_quantity is not null and l_extendedprice is not null),
k as (select distinct fold as k from d),
t as (select k, avg(x) as mx, avg(y) as my, regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, count(*) as n from d, k where fold <> k group by k),
g(algorithm, setting, alpha) as (values ('ridge', 0, 0.001), ('ridge', 1, 50000.0), ('ridge', 2, 5000000.0), ('lasso', 0, 0.01), ('lasso', 1, 40.0), ('linear', 0, 0.0)),
w as (select g.*, k, mx, my, case algorithm when 'lasso' then sign(sxy) * greatest(abs(sxy / n) - alpha, 0) / (sxx / n) else sxy / (sxx + alpha) end as w from t, g),
e as (select algorithm, setting, w.k, avg(pow(y - (my - w * mx) - w * x, 2)) filter (fold <> w.k) as tr, avg(pow(y - (my - w * mx) - w * x, 2)) filter (fold = w.k) as te
      from d, w group by algorithm, setting, w.k)
select algorithm, cast(setting as integer) as setting, round(avg(-tr), 5) as train_score, round(avg(-te), 5) as test_score from e group by algorithm, setting"""


@query("search_closed_form", _SEARCH_SQL)
def q_search_closed_form(spark, root):
    """M1-M3 inside the search (X4): scores of five hash folds against each fold's closed form."""
    d = read_table(spark, root, "lineitem").where("l_quantity is not null and l_extendedprice is not null").select(
        array_to_vector(F.array("l_quantity")).alias("features"), (F.col("l_extendedprice") / 1000.0).alias("label"),
        X.fold_column(KEY, 5, seed=42).alias("fold"))
    grids = {"ridge": {"alpha": [0.001, 50_000.0, 5_000_000.0]}, "lasso": {"alpha": [0.01, 40.0], "max_iter": [1000]}, "linear": {"fit_intercept": [True]}}
    out = None
    for algo, grid in grids.items():
        got = M.grid_search(spark, d, algo, grid, n_random=None).select(
            F.lit(algo).alias("algorithm"), "setting", F.round("mean_train_score", 5).alias("train_score"), F.round("mean_test_score", 5).alias("test_score"))
        out = got if out is None else out.unionByName(got)
    return out


@query("guarded_choice")
def q_guarded_choice(spark, root):
    d = _search_input(spark, root).filter(F.col("split").isin("train", "val"))
    d = d.withColumn("fold", F.when(F.col("split") == "train", -1).otherwise(0)).cache()
    res = M.grid_search(spark, d, "tree", {"max_depth": [2, 5, 9], "min_samples_leaf": [1, 20]}, n_random=None)
    return M.guarded_choice(res)


@query("final_fit")
def q_final_fit(spark, root):
    """Fit on train + val, save with the model writer, reload, evaluate on test."""
    data, fm = _fitted(spark, root, groups=False)
    tv = data.filter(F.col("split").isin("train", "val"))
    model = M.fit_final(tv, fm, "ridge", {"alpha": 1.0, "max_iter": 1000})
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    M.save_model(model, path)
    back = PipelineModel.load(path)
    return E.regression_metrics(back.transform(data.filter(F.col("split") == "test")), "label", "prediction", "split")


@query("leaderboard")
def q_leaderboard(spark, root):
    """Several models, test MSE ascending, arg-min flagged."""
    data, fm = _fitted(spark, root, groups=False)
    feats = fm.transform(data).select("features", "label", "split").cache()
    train, test = feats.filter(F.col("split") == "train"), feats.filter(F.col("split") == "test")
    stats = M.label_stats(train, "label")
    specs = {"linear": {"fit_intercept": True}, "ridge": {"alpha": 1.0},
             "tree": {"max_depth": 5, "min_samples_leaf": 5}}
    scores = []
    for algo, p in specs.items():
        m = M.build_estimator(algo, p, stats).fit(train)
        mse = E.regression_metrics(m.transform(test), "label", "prediction", None).select("MSE").first()[0]
        scores.append((algo, float(mse)))
    return M.leaderboard(spark, scores)


@query("coef_table")
def q_coef_table(spark, root):
    """E2 on the numeric features (a full one-hot block plus intercept is singular:
    the normal equations then have no unique covariance)."""
    data = regression_input(spark, root)
    train = data.filter(F.col("split") == "train")
    fm = FE.fit_feature_pipeline(train, FE.FeatureSpec(NUM, []))
    return E.coef_table(spark, fm.transform(train), FE.feature_names(fm))


@query("coef_table_one_hot", """
with d as (select coalesce(l_returnflag, 'none') as g, l_extendedprice / 1000.0 as y from lineitem where l_extendedprice is not null),
s as (select g, count(*) as n, avg(y) as m, var_pop(y) * count(*) as ss, row_number() over (order by g desc) as r from d group by g),
t as (select sum(ss) / (sum(n) - count(*)) as v, max(n) filter (r = 1) as n0, max(m) filter (r = 1) as m0 from s)
select g as feature, round(case when r > 1 then m - m0 end, 6) as coefficient, round(case when r > 1 then sqrt(v * (1.0 / n + 1.0 / n0)) end, 6) as std_error from s, t
union all select 'Intercept', round(m0, 6), round(sqrt(v / n0), 6) from t""")
def q_coef_table_one_hot(spark, root):
    """E2 on a full one-hot block plus intercept: the last level depends on the rest, the others are differences from it."""
    d = read_table(spark, root, "lineitem").where("l_extendedprice is not null").select(
        F.coalesce("l_returnflag", F.lit("none")).alias("g"), (F.col("l_extendedprice") / 1000.0).alias("label"))
    levels = [r["g"] for r in d.select("g").distinct().orderBy("g").collect()]
    d = d.select("label", array_to_vector(F.array(*[(F.col("g") == v).cast("double") for v in levels])).alias("features"))
    return E.coef_table(spark, d, levels).select("feature", F.round("coefficient", 6).alias("coefficient"), F.round("std_error", 6).alias("std_error"))


@query("tree_importance")
def q_tree_importance(spark, root):
    data, fm = _fitted(spark, root, groups=False)
    train = fm.transform(data.filter(F.col("split") == "train"))
    m = M.build_estimator("tree", {"max_depth": 6, "min_samples_leaf": 5}).fit(train)
    return E.tree_importance(spark, m, FE.feature_names(fm), k=20)


@query("permutation_importance")
def q_permutation_importance(spark, root):
    data, fm = _fitted(spark, root, groups=False)
    feats = fm.transform(data).select(*KEY, "features", "label", "split")
    m = M.build_estimator("linear", {"fit_intercept": True}).fit(feats.filter(F.col("split") == "train"))
    test = feats.filter(F.col("split") == "test")
    return E.permutation_importance(m, test, FE.feature_names(fm), key=KEY, n_repeats=5)


REG_SQL = """
with d as (select l_quantity, l_extendedprice,
  case when b < 6000 then 'train' when b < 8000 then 'test' else 'val' end as split from (
  select *, cast(('0x' || substr(md5(concat_ws('|', '42', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
         cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 8)) as bigint) % 10000 as b
  from lineitem) x),
f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a
      from d where split = 'train'),
p as (select d.*, f.a + f.b * d.l_quantity as prediction from d, f)
"""


@query("regression_metrics", REG_SQL + """
select split, count(*) as n, round(1 - avg((l_extendedprice - prediction) * (l_extendedprice - prediction)) /
       var_pop(l_extendedprice), 6) as R2,
       round(avg(abs(l_extendedprice - prediction)), 4) as MAE,
       round(avg((l_extendedprice - prediction) * (l_extendedprice - prediction)), 1) as MSE,
       round(sqrt(avg((l_extendedprice - prediction) * (l_extendedprice - prediction))), 4) as RMSE
from p group by split""")
def q_regression_metrics(spark, root):
    li = read_table(spark, root, "lineitem")
    d = li.select("l_quantity", "l_extendedprice", X.split_column(KEY, 0.6, True, 42).alias("split"))
    p = E.closed_form_prediction(d, "l_quantity", "l_extendedprice", F.col("split") == "train")
    m = E.regression_metrics(p, "l_extendedprice", "prediction", "split")
    return m.select("split", "n", F.round("R2", 6).alias("R2"), F.round("MAE", 4).alias("MAE"),
                    F.round("MSE", 1).alias("MSE"), F.round("RMSE", 4).alias("RMSE"))


@query("residuals", REG_SQL.replace("select l_quantity, l_extendedprice,", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,") + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, split, l_extendedprice,
       round(prediction, 6) as prediction, round(l_extendedprice - prediction, 6) as residual from p""")
def q_residuals(spark, root):
    li = read_table(spark, root, "lineitem")
    d = li.select(*KEY, "l_quantity", "l_extendedprice", X.split_column(KEY, 0.6, True, 42).alias("split"))
    p = E.residuals(E.closed_form_prediction(d, "l_quantity", "l_extendedprice", F.col("split") == "train"),
                    "l_extendedprice", "prediction")
    return p.select(*KEY, "split", "l_extendedprice", F.round("prediction", 6).alias("prediction"),
                    F.round("residual", 6).alias("residual"))


def _panel_model(spark, root):
    from panelspark.plans.panel import feature_columns, feature_table_from
    # the panel is materialised once (reliable checkpoint in the shared folder):
    # statistics, encoders, PCA and the model fit each read it again
    ft = cut_lineage(feature_table_from(spark, root).withColumn("label", F.col("target").cast("double")))
    numeric, categorical = feature_columns(ft, exclude=["target", "label", "kickoff_time", "player_id", "playername", "next_kickoff_time",
                                                        "data", "value", "selected", "element", "fixture", "season"])
    train = ft.filter(F.col("data") == "train")
    fm = FE.fit_feature_pipeline(train, FE.FeatureSpec(numeric, categorical))
    return ft, train, fm


@query("score_topk")
def q_score_topk(spark, root):
    """Fit on train rows of the panel, score the 'score' rows, top 10."""
    ft, train, fm = _panel_model(spark, root)
    m = M.fit_final(train, fm, "linear", {"fit_intercept": True})
    report = ["next_kickoff_time", "element", "playername", "team", "next_game_home", "next_opponent", "player_position", "starts",
              "starts_rolling_avg", "value"]
    return M.score_topk(m, ft.filter(F.col("data") == "score"), report, k=10)


@query("model_end_to_end")
def q_model_end_to_end(spark, root):
    """The whole flow: feature_table -> split -> significance selection (F11) -> column
    groups (P18) -> feature pipeline -> search of the whole grids + guarded choice for two algorithms ->
    refit -> leaderboard; returns the best model's metrics per split."""
    from panelspark.plans import modelling as P
    from panelspark.plans.panel import feature_table_from
    ft = cut_lineage(feature_table_from(spark, root))
    rows, numeric, categorical = P.prepare(ft)
    numeric, categorical, _ = P.select(rows.filter(F.col("split") == "train"), numeric, categorical, all_if_none=True)
    trained = P.train_models(spark, rows, numeric, categorical,
                             P.TrainSpec(algorithms=("linear", "ridge"), search="full"))
    return E.regression_metrics(trained.models[trained.best].transform(rows), "label", "prediction", "split")
