"""What the wide plans move: raw columns instead of derived ones, rows instead of their copies."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelspark.operators import evaluate as E
from panelspark.operators import models as M
from panelspark.plans import entity
from panelspark.sources import fixtures

ROOT = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan()


def _exchanged(node, found):
    """Output columns of every exchange of a physical plan."""
    if "AdaptiveSparkPlan" in node.nodeName():
        return _exchanged(node.executedPlan(), found)
    if node.nodeName().startswith("Exchange"):
        found.append([node.output().apply(i).name() for i in range(node.output().size())])
    for i in range(node.children().size()):
        _exchanged(node.children().apply(i), found)
    return found


def test_entity_windows_shuffle_raw_columns(spark):
    args = fixtures.appearance_log(spark, ROOT), fixtures.games(spark, ROOT), fixtures.entity_info(spark, ROOT)
    for unit in (None, "month"):
        moved = _exchanged(_plan(entity.entity_features(*args, entity.EntitySpec(segment=unit))), [])
        assert moved and not any(c.endswith("_per_minute") for columns in moved for c in columns)


def test_permutation_copies_are_not_shuffled(spark):
    d = spark.range(3000).select("id", array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"), F.rand(3).alias("noise"))
    d = d.withColumn("label", F.col("noise") / 10 + F.col("id") % 7)
    for algo, p in (("linear", {}), ("tree", {"max_depth": 2})):
        m = M.build_estimator(algo, p).fit(d)
        out = E.permutation_importance(m, d, ["a", "b"], key=["id"], n_repeats=2)
        moved = _exchanged(_plan(out), [])
        assert any("__b" in columns for columns in moved) and not any("__o" in columns for columns in moved)
        assert out.count() == 2
