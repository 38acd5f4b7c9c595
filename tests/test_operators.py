"""Unit and property checks on small literal frames (edge cases of each operator)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import expr as X
from panelspark.functions.distributions import betainc, f_sf, t_sf2
from panelspark.operators import profile, selection
from panelspark.operators import windows as W
from panelspark.operators.joins import asof_join, keep_members, sized_broadcast
from panelspark.sources import ingest


def ts(d):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=d)


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 2)], "x int, m int")
    got = [r[0] for r in df.orderBy("x").select(X.per_unit("x", "m")).collect()]
    assert got == [None, None, 1.5]


def test_gated_and_orient_null_flag(spark):
    df = spark.createDataFrame([(None, 5.0, None), (0, 5.0, True), (3, 5.0, False)], "m int, v double, h boolean")
    rows = df.select(X.gated("v", "m").alias("g"), X.orient("h", F.lit("A"), F.lit("B")).alias("o")).collect()
    assert [(r.g, r.o) for r in rows] == [(0.0, "B"), (0.0, "A"), (5.0, "B")]


def test_decode_null_goes_to_default(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "c int")
    got = [r[0] for r in df.select(X.decode("c", {1: "a", 2: "b"}, "z")).collect()]
    assert got == ["a", "z", "z"]


def test_outcome_flags_null_scores(spark):
    df = spark.createDataFrame([(2, 1), (1, 1), (0, 3), (None, 1)], "s int, c int")
    fl = X.outcome_flags("s", "c")
    got = [tuple(r) for r in df.select(fl["win"], fl["draw"], fl["loss"]).collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_full_name_null_propagates(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "f string, l string")
    assert [r[0] for r in df.select(X.full_name("f", "l")).collect()] == ["a b", None]


def test_lag_fallback_skips_zero(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 10), (1, 3, 20)], "e int, t int, x int")
    got = [r[0] for r in df.select(W.lag_fallback_ratio("x", ["e"], ["t"]).alias("r")).orderBy("r").collect()]
    # t0: no lags -> 1; t1: 0/5 = 0; t2: lag2=5 -> 2; t3: lag3=5 -> 4
    assert sorted(got) == [0.0, 1.0, 2.0, 4.0]


def test_rolling_avg_window_one_is_identity(spark):
    df = spark.createDataFrame([(1, i, float(i) if i % 3 else None) for i in range(10)], "e int, t int, x double")
    r = W.rolling_avg(df, ["e"], ["t"], 1, ["x"]).collect()
    assert all((a.x == a.x_rolling_avg) or (a.x is None and a.x_rolling_avg is None) for a in r)


def test_rolling_avg_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 4.0)], "e int, t int, x double")
    got = [r.x_rolling_avg for r in W.rolling_avg(df, ["e"], ["t"], 2, ["x"]).orderBy("t").collect()]
    assert got == [2.0, 2.0, 4.0]



def naive_asof(left, right, strict):
    out = []
    for k, t in left:
        cands = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
        if cands:
            out.append((k, t, max(cands)[1]))
    return sorted(out)


@pytest.mark.parametrize("strict", [True, False])
def test_asof_matches_naive_range_join(spark, strict):
    left = [(k, ts(d)) for k in (1, 2) for d in (0, 2, 3, 5, 9)]
    right = [(1, ts(1), "a"), (1, ts(3), "b"), (2, ts(0), "c"), (2, ts(5), "d"), (3, ts(1), "z")]
    L = spark.createDataFrame(left, "k int, t timestamp")
    R = spark.createDataFrame(right, "k int, rt timestamp, v string")
    got = asof_join(L, R, ["k"], "t", "rt", strict=strict).select("k", "t", "v").collect()
    assert sorted(tuple(r) for r in got) == naive_asof(left, right, strict)


def test_asof_left_keeps_unmatched(spark):
    L = spark.createDataFrame([(1, ts(0)), (1, ts(5))], "k int, t timestamp")
    R = spark.createDataFrame([(1, ts(1), 7)], "k int, rt timestamp, v int")
    got = sorted((r.t, r.v) for r in asof_join(L, R, ["k"], "t", "rt", how="left").collect())
    assert got == [(ts(0), None), (ts(5), 7)]


def test_upsert_new_batch_wins_and_is_idempotent(spark):
    prev = spark.createDataFrame([(1, "old", True), (2, "old", True), (3, "old", False)], "k int, v string, done boolean")
    new = spark.createDataFrame([(2, "n1", 1), (2, "n2", 2), (4, "n", 1)], "k int, v string, seq int")
    up = ingest.upsert_keep_last(prev, new, ["k"], order=["seq"], prev_filter=F.col("done"))
    got = sorted((r.k, r.v) for r in up.collect())
    assert got == [(1, "old"), (2, "n2"), (4, "n")]
    again = ingest.upsert_keep_last(up, new, ["k"], order=["seq"])
    assert sorted((r.k, r.v) for r in again.collect()) == got


def test_union_seasons_fills_missing_and_drops_index(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(0, 2)], "`Unnamed: 0` int, id int")
    u = ingest.union_seasons({24: a, 23: b, 22: None})
    assert set(u.columns) == {"id", "name", "season_start_year"}
    assert sorted((r.id, r.name, r.season_start_year) for r in u.collect()) == [(1, "x", 24), (2, None, 23)]


def test_membership_both_is_error(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        keep_members(df, "a", values=[1], table=df)


def test_sized_broadcast_falls_back(spark):
    df = spark.range(100)
    assert sized_broadcast(df, 10) is df           # over the bound: no hint, planner decides
    assert sized_broadcast(df, 1000) is not df     # under the bound: broadcast hint added
    assert sized_broadcast(df, 1000).count() == 100
    wide = spark.createDataFrame([(k, "x" * 1_000, None if k else bytearray(b"y"), [k], {k: "z"}) for k in range(20)],
                                 "`a.b` long, t string, b binary, l array<long>, m map<long,string>")
    assert sized_broadcast(wide, 1000, 10_000) is wide  # few rows, many bytes
    assert sized_broadcast(wide, 1000, 100_000) is not wide
    assert sized_broadcast(wide.limit(0), 0, 0) is not wide


def test_percentile_edges_duplicates_and_two_edge_fix(spark):
    # 70 % zeros: percentiles 0,0,0,0,x,y -> after dedupe more than two edges
    df = spark.createDataFrame([(0.0,)] * 8 + [(1.0,), (2.0,)], "x double")
    e = profile.percentile_edges(df, "x").first().edges
    assert e[0] == pytest.approx(-0.1) and e[-1] == pytest.approx(2.1)
    # only two distinct values, 60th percentile equals the low one
    df2 = spark.createDataFrame([(0.0,)] * 9 + [(5.0,)], "x double")
    e2 = profile.percentile_edges(df2, "x").first().edges
    assert e2 == pytest.approx([-0.1, 0.1, 5.1])
    b = profile.assign_bins(df2, "x", profile.percentile_edges(df2, "x"))
    assert sorted(set(r.bin for r in b.collect())) == [1, 2]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = profile.histogram_density(df, "x", bins=5).collect()
    assert sum(r.n for r in h) == 11 and max(r.bin for r in h) == 4
    assert sum(r.density * (r.upper - r.lower) for r in h) == pytest.approx(1.0)


def test_duplicate_count(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "a int")
    r = profile.duplicate_count(df).first()
    assert (r.n_duplicated, r.n_distinct_rows) == (2, 2)


def test_anova_matches_textbook(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    r = selection.anova_categorical(df, ["g"], "y").first()
    # SSB = 13.5, SSW = 4 -> F = 13.5 / (4/4) = 13.5
    assert r.f == pytest.approx(13.5) and (r.df1, r.df2) == (1.0, 4.0)


def test_regression_f_equals_squared_t(spark):
    rows = [(float(x), 2.0 * x + (1 if x % 2 else -1)) for x in range(10)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = selection.regression_f(df, ["x"], "y").first()
    n = 10
    xs, ys = zip(*rows)
    mx, my = sum(xs) / n, sum(ys) / n
    sxy = sum((a - mx) * (b - my) for a, b in rows)
    sxx = sum((a - mx) ** 2 for a in xs)
    syy = sum((b - my) ** 2 for b in ys)
    r2 = sxy * sxy / (sxx * syy)
    assert r.f == pytest.approx(r2 * (n - 2) / (1 - r2))


def test_distribution_tails():
    assert betainc(2.0, 3.0, 0.0) == 0.0 and betainc(2.0, 3.0, 1.0) == 1.0
    assert betainc(1.0, 1.0, 0.3) == pytest.approx(0.3)
    assert f_sf(3.0, 2, 100) == pytest.approx(0.0542883, rel=1e-5)
    assert t_sf2(1.0, 10) == pytest.approx(0.3408931, rel=1e-5)
    assert t_sf2(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert math.isnan(f_sf(float("nan"), 1, 2))


@pytest.mark.parametrize("max_candidates", [50, 10**6])
def test_exact_quantiles_match_numpy(spark, max_candidates):
    import numpy as np

    from panelspark.operators.quantiles import exact_quantiles
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    long = li.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    qs = [0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 0.99, 1.0]
    got = {(r.g, r.qi): r.value for r in exact_quantiles(long, ["g"], "v", qs, max_candidates=max_candidates).collect()}
    pdf = long.toPandas()
    for g, part in pdf.groupby("g"):
        ref = np.quantile(part["v"].to_numpy(), qs)
        assert [got[(g, i)] for i in range(len(qs))] == pytest.approx(list(ref), rel=1e-12)
    overall = {r.qi: r.value for r in exact_quantiles(long, [], "v", qs, max_candidates=max_candidates).collect()}
    assert [overall[i] for i in range(len(qs))] == pytest.approx(list(np.quantile(pdf["v"].to_numpy(), qs)), rel=1e-12)


def test_rolling_avg_segmented_equals_plain(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "value")
    plain = W.rolling_avg(e, ["user_id"], ["ts", "event_id"], 3, ["value"])
    seg = W.rolling_avg(e, ["user_id"], ["ts", "event_id"], 3, ["value"], segment=F.date_trunc("day", "ts"))
    assert plain.exceptAll(seg).count() == 0 and seg.exceptAll(plain).count() == 0
