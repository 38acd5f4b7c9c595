"""Model evaluation (E1-E5): metrics, coefficient table, importances, residuals.

Metrics are one grouped aggregate over a predictions frame (split column as the
key). Permutation importance scores all (feature, repeat) copies of the test
rows in one DataFrame; each copy's column is permuted inside random blocks of
rows (window per block), so no step needs a global row order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.distributions import t_pvalue
from panelspark.operators.tall_qr import least_squares

ROWS_PER_TASK = 25_000  # rows whose copies one task sorts


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       split: str | None = "split") -> DataFrame:
    """R2, MAE, MSE, RMSE per split (R2 = 1 - SSE/SST within the split;
    null where the label is constant)."""
    err = F.col(label) - F.col(prediction)
    keys = [split] if split else []
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("MAE"),
        F.avg(err * err).alias("MSE"),
        F.var_pop(label).alias("__var"))
    return agg.select(*keys, "n", (1 - F.try_divide(F.col("MSE"), F.col("__var"))).alias("R2"), "MAE", "MSE",
                      F.sqrt("MSE").alias("RMSE"))


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E5: (y, y_hat, y - y_hat) next to the input columns."""
    return pred.withColumn("residual", F.col(label) - F.col(prediction))


def coef_table(spark: SparkSession, data: DataFrame, names: Sequence[str], features: str = "features",
               label: str = "label", fit_intercept: bool = True) -> DataFrame:
    """OLS coefficients, standard errors, t and two-sided p-values.

    Features that depend on the ones before them (the last level of a full one-hot block next to the intercept)
    are listed with null values; the others are those of the design without them.
    """
    found = least_squares(data, features, label, fit_intercept)
    feats = [*names, "Intercept"] if fit_intercept else list(names)
    rows = [(f, *(None if math.isnan(v) else float(v) for v in (b, e, b / e if e else math.nan)))
            for f, b, e in zip(feats, found.coefficients, found.std_errors, strict=True)]
    df = spark.createDataFrame(rows, "feature string, coefficient double, std_error double, t double")
    dof = float(max(found.degrees_of_freedom, 1))
    return df.withColumn("p_value", F.when(F.col("t").isNotNull(), t_pvalue("t", F.lit(dof)))).orderBy(F.col("p_value").asc_nulls_last(), "feature")


def tree_importance(spark: SparkSession, model, names: Sequence[str], k: int | None = None) -> DataFrame:
    """Impurity importances with feature names, descending (top ``k``)."""
    imp = model.featureImportances.toArray()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, feature_importance double")
    df = df.orderBy(F.col("feature_importance").desc(), "feature")
    return df.limit(k) if k else df


def permutation_importance(model, test: DataFrame, names: Sequence[str], features: str = "features",
                           label: str = "label", key: Sequence[str] = (), n_repeats: int = 5, seed: int = 42,
                           block_rows: int = 1024, feature_batch: int = 8) -> DataFrame:
    """Mean drop in R2 when one feature slot is permuted, per feature.

    ``model`` maps ``features`` -> prediction (a fitted regressor). ``key``
    identifies rows (for seeded hashing). Rows are put into random blocks of
    ~``block_rows`` rows, and for every (feature, repeat) copy the slot value is
    rotated by one position inside the block in a random order of that copy: a random
    permutation built with windows over many small partitions. Only the rows are
    shuffled, by block; a task makes the copies of its own blocks, ``feature_batch``
    features at a time. For a linear model a copy holds one
    slot value and the prediction, which moves by weight x change of the slot;
    other models need the whole vector in each copy.
    """
    weights = [float(v) for v in model.coefficients.toArray()] if isinstance(model, LinearRegressionModel) else None
    n = test.count()
    n_blocks = max(1, n // block_rows)
    base_pred = model.transform(test)
    rid = F.xxhash64(*[F.col(k) for k in key]) if key else F.monotonically_increasing_id()
    base = base_pred.select(
        label, vector_to_array(features).alias("__x"), F.col("prediction").alias("__p"), rid.alias("__id"))
    base = (base.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(n_blocks)))
            .repartition(max(n // ROWS_PER_TASK, test.sparkSession.sparkContext.defaultParallelism), "__b"))
    parts = []
    for lo in range(0, len(names), feature_batch):
        hi = min(lo + feature_batch, len(names))
        parts.append(_permuted_r2(model, base, features, label, seed, lo, hi, n_repeats, weights))
    copy_r2 = parts[0]
    for p in parts[1:]:
        copy_r2 = copy_r2.unionByName(p)
    base_r2 = F.lit(regression_metrics(base_pred, label, "prediction", None).select("R2").first()[0])
    names_df = test.sparkSession.createDataFrame([(i, nm) for i, nm in enumerate(names)], "__f int, feature string")
    out = copy_r2.groupBy("__f").agg(F.avg(base_r2 - F.col("r2")).alias("permutation_importance"),
                                     F.stddev_samp(base_r2 - F.col("r2")).alias("std"))
    return out.join(names_df, "__f").select("feature", "permutation_importance", "std").orderBy(
        F.col("permutation_importance").desc(), "feature")


def _permuted_r2(model, base: DataFrame, features: str, label: str, seed: int,
                 lo: int, hi: int, n_repeats: int, weights: Sequence[float] | None = None) -> DataFrame:
    """R2 of every (feature, repeat) copy for features lo..hi-1: (__f, __r, r2)."""
    # the rows were dealt out by block: the copies are made and permuted where the rows are
    copies = base.select("*", F.explode(F.sequence(F.lit(lo * n_repeats), F.lit(hi * n_repeats - 1))).alias("__c"))
    copies = copies.withColumn("__f", (F.col("__c") / n_repeats).cast("int"))
    copies = copies.withColumn("__o", F.xxhash64(F.lit(seed + 1), "__c", "__id"))
    w = Window.partitionBy("__c", "__b").orderBy("__o", "__id")
    copies = copies.withColumn("__s", F.element_at("__x", F.col("__f") + 1))
    if weights is not None:
        copies = copies.drop("__x")
    slot = F.col("__s")
    rotated = F.coalesce(F.lead(slot).over(w), F.first(slot).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    permuted = copies.withColumn("__v", rotated)
    if weights is not None:
        weight = F.element_at(F.array(*map(F.lit, weights[lo:hi])), F.col("__f") - lo + 1)
        scored = permuted.withColumn("prediction", F.col("__p") + weight * (F.col("__v") - F.col("__s")))
    else:
        newx = F.transform("__x", lambda v, i: F.when(i == F.col("__f"), F.col("__v")).otherwise(v))
        scored = model.transform(permuted.withColumn(features, array_to_vector(newx)))
    err = F.col(label) - F.col("prediction")
    r2 = scored.groupBy("__c").agg((1 - F.try_divide(F.avg(err * err), F.var_pop(label))).alias("r2"))
    return r2.select((F.col("__c") / n_repeats).cast("int").alias("__f"), (F.col("__c") % n_repeats).alias("__r"), "r2")


def closed_form_prediction(df: DataFrame, x: str, y: str, fit_rows=None) -> DataFrame:
    """One-feature least squares fit (regr_slope/regr_intercept) on ``fit_rows``
    (a filter; default all rows), applied to every row as ``prediction``.

    The two coefficients are scalar subqueries: one aggregate job, no join."""
    fit = df.filter(fit_rows) if fit_rows is not None else df
    fit = fit.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    b, a = fit.select("b").scalar(), fit.select("a").scalar()
    return df.withColumn("prediction", a + b * F.col(x))
