"""Medians of many columns from two passes over them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import features as FE


def test_medians_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cols = {"even": rng.normal(size=1000), "odd": np.append(rng.integers(0, 3, 999).astype(float), np.nan), "one": np.full(1000, 7.0),
            "split": np.repeat([1.0, 2.0], 500), "infinite": np.append(np.full(501, -np.inf), np.arange(499.0))}
    rows = [(*[None if np.isnan(v) else float(v) for v in r], None, i) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols) + ", empty double, `a.b` long")
    want = {c: float(np.nanmedian(v)) for c, v in cols.items()}
    # the long form, with a row for each value, is only for columns that the brackets cannot settle
    monkeypatch.setattr(FE, "exact_quantiles", lambda *a, **k: pytest.fail("long form"))
    assert FE.medians(df, [*cols, "empty"]) == pytest.approx({**want, "empty": None})


def test_medians_without_rows_and_with_nan(spark):
    df = spark.range(5).select(F.when(F.col("id") < 3, F.lit(math.nan)).otherwise(F.col("id").cast("double")).alias("x"), F.col("id").alias("y"))
    got = FE.medians(df, ["x", "y"])
    assert math.isnan(got["x"]) and got["y"] == 2.0
    assert FE.medians(df.limit(0), ["x", "y"]) == {"x": None, "y": None}


def test_a_median_outside_its_bracket(spark, monkeypatch):
    monkeypatch.setattr(FE, "BRACKET", [0.9, 0.95])
    assert FE.medians(spark.range(101), ["id"]) == {"id": 50.0}
