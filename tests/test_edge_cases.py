"""Null keys and times, ties, repeated pairings, constant columns and stable samples."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import functions as F

from panelspark.operators.hist_trees import HistTreeRegressor
from panelspark.operators import evaluate as E
from panelspark.operators import features as FE
from panelspark.operators import models as M
from panelspark.operators import selection
from panelspark.operators import split as X
from panelspark.operators.joins import asof_join
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.segmented import choose_segment, halo_window, running_totals
from panelspark.plans import standings


def key_rows(spark):
    """Keys 1, 2 and null; times over three months, null times, ties in time (told apart by id)."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice([1, 2, None]), rnd.choice([None, *[f"2024-0{m}-{d:02d} 10:00:00" for m in (1, 2, 3) for d in (1, 2, 15)]]),
             rnd.randint(0, 9)) for i in range(120)]
    return spark.createDataFrame(rows, "id long, k int, ts string, x int").withColumn("t", F.col("ts").cast("timestamp_ntz")).drop("ts")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("unit", ["month", "day", "microsecond"])
def test_segmented_windows_equal_plain_ones(spark, unit):
    df = key_rows(spark)
    seg = F.date_trunc(unit, F.col("t"))

    def stage(w):
        return [F.lag("x", 3).over(w).alias("l3"), F.lead("x", 1).over(w).alias("n1"), F.avg("x").over(w.rowsBetween(-3, 0)).alias("m")]

    cols = ["id", "k", "x", "l3", "n1", "m"]
    assert rows_of(halo_window(df, ["k"], ["t", "id"], seg, 3, 1, stage), *cols) == rows_of(halo_window(df, ["k"], ["t", "id"], None, 3, 1, stage), *cols)
    sums = {"s": F.col("x"), "n": F.lit(1)}
    cols = ["id", "k", "s", "n", "rn"]
    plain = running_totals(df, ["k"], ["t", "id"], None, sums, "rn")
    assert rows_of(running_totals(df, ["k"], ["t", "id"], seg, sums, "rn"), *cols) == rows_of(plain, *cols) and plain.count() == 120


@pytest.mark.parametrize("strict", [True, False])
def test_segmented_asof_equals_plain(spark, strict):
    df = key_rows(spark)
    left = df.filter("id % 2 = 0").select("k", "t", F.col("id").alias("lid"))
    right = df.filter("id % 2 = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"), "x")

    def run(segment):
        j = asof_join(left, right, ["k"], "t", "rt", strict=strict, how="left", right_order=["rid"], segment=segment)
        return rows_of(j, "lid", "k", "rid", "x")

    assert run("month") == run(None) == run("day") and len(run(None)) == 60


def test_choose_segment_with_hot_null_key(spark):
    df = key_rows(spark).withColumn("k", F.lit(None).cast("int"))
    assert choose_segment(df, ["k"], "t", max_rows=200) is None
    assert choose_segment(df, ["k"], "t", max_rows=60) in ("month", "week", "day")
    assert choose_segment(df, ["k"], "t", max_rows=1) == "microsecond"


def test_quantiles_with_ties_and_null_groups(spark):
    rnd = random.Random(2)
    data = {"a": [5.0] * 1800 + [rnd.random() for _ in range(200)], "b": [float(rnd.randint(0, 3)) for _ in range(1500)],
            None: [rnd.gauss(0, 1) for _ in range(1000)], "c": [7.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("d", None)]
    rnd.shuffle(rows)
    qs = [0, 0.1, 0.25, 0.5, 0.899, 0.9, 1]
    got = {(r.g, r.q): r.value for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, max_candidates=100).collect()}
    assert set(got) == {(g, float(q)) for g in data for q in qs}
    for g, vs in data.items():
        for q in qs:
            assert math.isclose(got[g, float(q)], float(np.quantile(vs, q)), rel_tol=1e-12, abs_tol=1e-12), (g, q)


def test_opponent_standing_on_repeated_pairings(spark):
    rows = [(1, "2024-01-01", 1, 2, 3, 0), (2, "2024-01-01", 3, 4, 1, 1), (3, "2024-01-08", 1, 2, 0, 0), (4, "2024-01-08", 2, 1, 2, 0),
            (5, "2024-01-15", 2, 3, 1, 0), (6, "2024-01-15", 1, 4, None, None)]
    games = (spark.createDataFrame(rows, "game_id long, d string, home int, away int, team_h_score int, team_a_score int")
             .withColumn("kickoff", F.col("d").cast("timestamp_ntz")).withColumn("season", F.lit(2024)).drop("d"))
    tf = standings.team_features(games)
    table = {(r.next_kickoff_time, r.team): r.position for r in standings.league_table(games).collect()}
    got = tf.select("kickoff_time", "team", "opponent", "position", "opponent_position").collect()
    assert len(got) == 12
    for r in got:
        assert r.position == table.get((r.kickoff_time, r.team)) and r.opponent_position == table.get((r.kickoff_time, r.opponent))


def test_grid_measure_sees_the_kickoffs(spark):
    """Ten teams play two games each, but the as-of grid has every kickoff of the season per team."""
    rows = [(i, f"2024-{1 + i // 20:02d}-{1 + i % 20:02d}", 2 * (i % 50), 2 * (i % 50) + 1, 1, 0) for i in range(100)]
    games = (spark.createDataFrame(rows, "game_id long, d string, home int, away int, team_h_score int, team_a_score int")
             .withColumn("kickoff", F.col("d").cast("timestamp_ntz")).withColumn("season", F.lit(2024)).drop("d"))
    spec = standings.TableSpec(max_rows_per_task=100)
    assert standings.resolve_table_segment(games, None, spec).segment is not None
    plain = standings.league_table(games, t=standings.TableSpec(segment=None))
    assert rows_of(standings.league_table(games, t=spec), "season", "team", "next_kickoff_time", "position") == rows_of(
        plain, "season", "team", "next_kickoff_time", "position")


def test_constant_columns_do_not_crash(spark):
    df = spark.createDataFrame([(float(i % 7), 1.0, "a", float(i)) for i in range(60)], "x double, one double, c string, y double")
    sig = {r.feature: r for r in selection.significance(df, ["x", "one"], ["c"], "y").collect()}
    assert sig["one"].f is None and sig["c"].f is None and sig["x"].f is not None
    pred = df.select(F.lit("s").alias("split"), F.lit(3.0).alias("label"), F.col("x").alias("prediction"))
    r = E.regression_metrics(pred).first()
    assert r.R2 is None and r.MSE > 0
    res = spark.createDataFrame([(0, "{}", 0.0, 0.0, 1), (1, "{}", -1.0, -1.0, 2)],
                                "setting int, params string, mean_train_score double, mean_test_score double, rank_test_score int")
    assert M.guarded_choice(res).first().setting == 1


def test_settings_map_or_raise():
    xgb = M.GRIDS["gbt_xgb_profile"]
    kinds = {e.spec if isinstance(e, HistTreeRegressor) else
             (e.getMaxDepth(), e.getStepSize(), e.getMaxIter(), e.getMinInstancesPerNode(), e.getMinInfoGain())
             for e in (M.build_estimator("gbt_xgb_profile", p) for p in M.settings(xgb))}
    assert len(kinds) == len(M.settings(xgb))
    assert M.build_estimator("gbt_xgb_profile", {"gamma": 0.5}).getMinInfoGain() == 0.5
    assert M.build_estimator("gbt_lgbm_profile", {"max_depth": -1}).getMaxDepth() == M.MAX_TREE_DEPTH
    with pytest.raises(M.UnsupportedSetting):
        M.build_estimator("tree", {"max_depth": 31})
    with pytest.raises(M.UnsupportedSetting):
        M.build_estimator("gbt", {"loss": "quantile"})


def test_search_raises_what_is_not_a_setting(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, -1)], "label double, fold int")
    with pytest.raises(Exception):
        M.grid_search(spark, df, "linear", M.GRIDS["linear"])  # no features column


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(5000).select("id")
    a = {r.id for r in X.sample_rows(df.repartition(3), 0.3, ["id"]).collect()}
    b = {r.id for r in X.sample_rows(df.repartition(17), 0.3, ["id"]).collect()}
    assert a == b and 1300 < len(a) < 1700


def test_feature_names_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(float(i), None if i % 5 == 0 else float(i % 7), "ab"[i % 2], float(i * 2)) for i in range(40)],
                               "x double, z double, c string, label double")
    fm = FE.fit_feature_pipeline(df, FE.FeatureSpec(["x", "z"], ["c"], {"pca_all": (["x", "z"], 2)}))
    names = ["c_a", "c_b", "x", "z", "missing_indicator_z", "pca_all_pca_1", "pca_all_pca_2"]
    final = M.fit_final(df, fm, "linear", {})
    final.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert FE.feature_names(fm) == FE.feature_names(final) == FE.feature_names(back) == names
    assert len(back.transform(df).first().features) == len(names)
    with pytest.raises(ValueError):
        FE.fit_feature_pipeline(df, FE.FeatureSpec(["x"], [], {"pca_all": (["x"], 3)}))


def test_groups_assign_each_column_once():
    g = FE.pca_groups(["home", "expected_goals_rolling_avg", "minutes_rolling_avg", "value"], ["home"])
    assert g["pca_team"][0] == ["home"] and g["pca_expected"][0] == ["expected_goals_rolling_avg"]
    assert g["pca_rolling_avg"][0] == ["minutes_rolling_avg"] and g["other_pca"][0] == ["value"] and len(g["pca_all"][0]) == 4
    good, out = FE.fitting_groups(g)
    assert good == {} and set(out) == set(g)


def test_upsert_ties_are_settled_by_the_rows_themselves(spark):
    from panelspark.sources.ingest import upsert_keep_last
    rows = [(1, 5, v, {"k": str(i)}) for i, v in enumerate("dbacbd")] + [(2, 5, "x", None)]
    new = spark.createDataFrame(rows, "id int, at int, v string, m map<string,string>")
    prev = new.limit(0)
    got = {upsert_keep_last(prev, new.repartition(n, "v"), ["id"], ["at"]).where("id = 1").first()["v"] for n in (1, 2, 3, 5, 7)}
    assert len(got) == 1
    assert upsert_keep_last(prev, new, ["id"], ["at"]).count() == 2
