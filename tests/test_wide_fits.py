"""Wide tables: statistics of many columns in a pass without an expression for each."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import features as FE
from panelspark.operators import quantiles


def test_imputed_moments_equal_numpy(spark):
    rng = np.random.default_rng(11)
    n = 900
    cols = {"far": 1e9 + rng.normal(size=n), "one": np.full(n, 0.1), "holes": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n))}
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], None) for r in zip(*cols.values())],
                               ", ".join(f"{c} double" for c in cols) + ", empty double").repartition(4)
    fill = {"far": float(np.median(cols["far"])), "one": 0.1, "holes": 0.25, "empty": None}
    stats, nulls = FE.imputed_moments(df, [*cols, "empty"], fill)
    for c, v in cols.items():
        w = np.where(np.isnan(v), fill[c], v)
        assert stats[c] == pytest.approx((w.mean(), w.std() or 1.0), rel=1e-9), c
    p = np.isnan(cols["holes"]).mean()
    assert nulls["holes"] == pytest.approx((p, math.sqrt(p * (1 - p)))) and nulls["far"] == (0.0, 1.0)
    assert stats["one"] == (0.1, 1.0) and stats["empty"] == (0.0, 1.0) and nulls["empty"] == (1.0, 1.0)
    assert FE.imputed_moments(df.limit(0), ["far"], {"far": None})[0] == {"far": (0.0, 1.0)}


def test_fit_takes_no_expression_for_each_column(spark, monkeypatch):
    def fail(*a, **k):
        pytest.fail("an aggregate for each column")

    df = spark.range(50).select(*[(F.col("id") * k % 17).alias(f"c{k}") for k in range(1, 9)])
    monkeypatch.setattr(F, "stddev_pop", fail)
    monkeypatch.setattr(F, "percentile_approx", fail)
    fm = FE.fit_feature_pipeline(df, FE.FeatureSpec(df.columns, []))
    v = np.array([r["features"].toArray() for r in fm.transform(df).select("features").collect()])
    assert v.mean(axis=0) == pytest.approx(np.zeros(8), abs=1e-12) and v.std(axis=0) == pytest.approx(np.ones(8))


def test_sketch_of_many_batches_brackets_the_quantiles(spark):
    # more rows than a task keeps points of, in an order that puts all small values into one task
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * F.col("id") / 7.0).alias("x"), (-F.col("id")).cast("double").alias("y"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = quantiles.column_quantiles(df, ["x", "y"], [0.0, 0.5, 0.9], accuracy=2_000, brackets=[(0.0, 0.01), (0.495, 0.505), (0.89, 0.91)],
                                         exact=lambda *a, **k: pytest.fail("long form"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = np.arange(200_000.0)
    assert got["x"] == pytest.approx(np.quantile(ids * ids / 7, [0.0, 0.5, 0.9])) and got["y"] == pytest.approx(np.quantile(-ids, [0.0, 0.5, 0.9]))


def test_whole_flow_searches_every_setting(spark, monkeypatch):
    from panelspark import queries_ml
    from panelspark.operators import models as M
    from panelspark.plans import modelling, panel

    class Seen(Exception):
        pass

    def see(spark, rows, numeric, categorical, spec):
        raise Seen([len(M.settings(spec.grids[a], None if spec.search == "full" else spec.n_random, spec.seed)) for a in spec.algorithms])

    frame = spark.createDataFrame([("train", 1, 1, 1, 1, 2.0)], "data string, season int, element int, fixture int, target int, x double")
    monkeypatch.setattr(panel, "feature_table_from", lambda spark, root: frame)
    monkeypatch.setattr(modelling, "select", lambda train, numeric, categorical, **k: (numeric, categorical, None))
    monkeypatch.setattr(modelling, "train_models", see)
    with pytest.raises(Seen) as seen:
        queries_ml.q_model_end_to_end(spark, "")
    assert seen.value.args[0] == [len(M.settings(M.GRIDS[a])) for a in ("linear", "ridge")]
