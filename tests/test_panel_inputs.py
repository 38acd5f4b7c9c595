"""The panel join reads one stored game list and sorts no entity rows for the joins."""

from panelspark.operators.joins import sized_hash_side
from panelspark.queries_core import q_panel_join
from panelspark.sources import fixtures

ROOT = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_join_joins_the_customers_once(spark):
    # as if the customers were too many to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(q_panel_join(spark, ROOT))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "c_custkey" not in plan
    assert "ShuffledHashJoin [season#" in plan and "ShuffledHashJoin [team#" in plan


def test_stored_games_give_the_same_inputs(spark):
    got = fixtures.panel_inputs(spark, ROOT)
    want = fixtures.appearance_log(spark, ROOT), fixtures.games(spark, ROOT), fixtures.entity_info(spark, ROOT)
    for a, b in zip(got, want):
        assert a.schema == b.schema and a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_only_a_small_side_is_hashed(spark):
    d = spark.range(10)
    assert sized_hash_side(d, 10) is not d and sized_hash_side(d, 10**12) is d
