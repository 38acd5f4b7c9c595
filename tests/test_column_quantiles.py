"""Quantiles of many columns from two passes, and the tests that read their groups once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import profile, quantiles, selection

QS = [0.0, 0.2, 0.5, 0.8, 1.0]


def _frame(spark):
    rng = np.random.default_rng(7)
    cols = {"few": rng.integers(0, 9, 3000).astype(float), "many": rng.normal(size=3000), "one": np.full(3000, 2.0),
            "holes": np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000)), "infinite": np.append(np.full(100, np.inf), np.arange(2900.0))}
    rows = [(*[None if np.isnan(v) else float(v) for v in r], None) for r in zip(*cols.values())]
    return cols, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", empty double").repartition(5)


def test_column_quantiles_equal_numpy(spark):
    cols, df = _frame(spark)
    # the long form, with a row for each value and quantile, is only for what the brackets cannot settle
    got = quantiles.column_quantiles(df, [*cols, "empty"], QS, exact=lambda *a, **k: pytest.fail("long form"))
    assert got.pop("empty") is None
    assert got["infinite"].pop() == math.inf  # numpy: not a number
    assert got.pop("infinite") == pytest.approx([float(x) for x in np.quantile(cols.pop("infinite"), QS[:-1])])
    for c, v in cols.items():
        assert got[c] == pytest.approx([float(x) for x in np.nanquantile(v, QS)]), c


def test_column_quantiles_outside_their_brackets_and_nan(spark):
    d = spark.range(101).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 90, F.col("id")).otherwise(F.lit(math.nan)).alias("y"))
    got = quantiles.column_quantiles(d, ["x", "y"], [0.1, 0.5, 0.9], [(0.7, 0.8)] * 3)
    assert got["x"] == [10.0, 50.0, 90.0] and got["y"][:2] == [10.0, 50.0] and math.isnan(got["y"][2])


def test_bin_edges_take_no_row_for_each_value(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "exact_quantiles", lambda *a, **k: pytest.fail("long form"))
    cols, df = _frame(spark)
    got = {r["feature"]: r["edges"] for r in profile.bin_edges(df, ["many", "empty"]).collect()}
    want = np.quantile(cols["many"], profile.BIN_PERCENTILES)
    assert got == {"many": pytest.approx([want[0] - 0.1, *want[1:-1], want[-1] + 0.1])}


def test_anova_reads_the_rows_once(spark):
    d = spark.range(300).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.sqrt("id").alias("x"), (F.col("id") % 7).alias("y"))
    for out in (selection.anova_categorical(d, ["g"], "y"), selection.anova_binned(d, ["x"], "y")):
        assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 1
