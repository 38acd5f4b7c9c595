"""Permutation importance: linear models are scored without copying vectors."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

from panelspark.operators import evaluate as E

NAMES = ["a", "b", "c"]


class AnyModel:
    """Hides the kind of a model, so that the general way is taken."""

    def __init__(self, model):
        self.transform = model.transform


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for k in range(400):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        data.append((k, a, b, c, 3 * a - b + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "k long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).select("k", "features", "label")


def importance(model, rows, **options):
    out = E.permutation_importance(model, rows, NAMES, key=["k"], n_repeats=3, block_rows=64, **options).collect()
    return {r["feature"]: (r["permutation_importance"], r["std"]) for r in out}


@pytest.mark.parametrize("feature_batch", [8, 2])
def test_linear_importance_equals_the_general_way(rows, feature_batch):
    model = LinearRegression().fit(rows)
    got, want = (importance(m, rows, feature_batch=feature_batch) for m in (model, AnyModel(model)))
    assert got.keys() == want.keys() == set(NAMES)
    for f in NAMES:
        assert got[f] == pytest.approx(want[f], abs=1e-9)
    assert got["a"][0] > 1 > got["b"][0] > 0.05 > abs(got["c"][0])


def test_linear_copies_hold_no_vectors(rows, capsys):
    model = LinearRegression().fit(rows)
    E.permutation_importance(model, rows, NAMES, key=["k"], n_repeats=2).explain("simple")
    window = next(x for x in capsys.readouterr().out.split("\n") if "Exchange hashpartitioning(__c" in x)
    assert "__x" not in window


def test_tree_importance_by_permutation(rows):
    got = importance(DecisionTreeRegressor(maxDepth=4, seed=1).fit(rows), rows)
    assert got["a"][0] > got["b"][0] and abs(got["c"][0]) < 0.05
