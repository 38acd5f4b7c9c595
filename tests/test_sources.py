"""Sources, sinks and ingest operators on small frames."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelspark.functions.distributions import f_pvalue, f_sf, t_pvalue, t_sf2
from panelspark.sources import ingest
from panelspark.sources.tables import list_tables, read_table, read_tables, scan_view, write_tables


def test_flatten_array_keeps_parent_and_outer(spark):
    df = spark.createDataFrame([(1, '[{"k": 1}, {"k": 2}]'), (2, "[]"), (3, None)], "id int, payload string")
    inner = ingest.flatten_array(df, "payload", ["id"], "array<struct<k:int>>")
    assert sorted((r.id, r.k) for r in inner.collect()) == [(1, 1), (1, 2)]
    outer = ingest.flatten_array(df, "payload", ["id"], "array<struct<k:int>>", outer=True)
    assert sorted((r.id, r.k if r.k is not None else -1) for r in outer.collect()) == [(1, 1), (1, 2), (2, -1), (3, -1)]


def test_csv_sink_and_folder_reader_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="panelspark-test-")
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    b = spark.createDataFrame([(3.5,)], "v double")
    write_tables({"a": a, "b": b}, root, fmt="csv")
    assert list_tables(root, "csv") == ["a", "b"]
    with pytest.raises(ValueError):
        read_table(spark, root, "a", fmt="csv")          # csv needs an explicit schema
    tabs = read_tables(spark, root, fmt="csv", schemas={"a": "id int, name string", "b": "v double"})
    assert sorted(tuple(r) for r in tabs["a"].collect()) == [(1, "x"), (2, None)]
    v = scan_view(spark, root, "b", fmt="csv", schema="v double", view="b_view")
    assert v.count() == 1 and spark.sql("select v from b_view").first().v == 3.5
    write_tables({"a": a.limit(1)}, root, fmt="csv")      # overwrite replaces the table
    assert read_table(spark, root, "a", fmt="csv", schema="id int, name string").count() == 1
    assert os.path.isdir(os.path.join(root, "a.csv"))


def test_season_bounds_from_min_two_digit_year(spark):
    df = spark.createDataFrame([("2023-08-01 10:00:00",), ("2024-01-01 00:00:00",), (None,)], "t string") \
        .select(F.to_timestamp("t").alias("t"))
    got = sorted((r.season, r.is_current) for r in ingest.season_bounds(df, "t", 4).collect())
    assert got == [(19, False), (20, False), (21, False), (22, False), (23, True)]


def test_pvalue_udfs_match_scalar_functions(spark):
    df = spark.createDataFrame([(3.0, 2.0, 100.0, 1.0), (0.5, 4.0, 30.0, -2.5), (None, 1.0, 1.0, None)],
                               "f double, d1 double, d2 double, t double")
    rows = df.select(f_pvalue("f", "d1", "d2").alias("p"), t_pvalue("t", "d2").alias("pt")).collect()
    assert rows[0].p == pytest.approx(f_sf(3.0, 2, 100)) and rows[0].pt == pytest.approx(t_sf2(1.0, 100))
    assert rows[1].p == pytest.approx(f_sf(0.5, 4, 30)) and rows[1].pt == pytest.approx(t_sf2(-2.5, 30))
    assert rows[2].p is None and rows[2].pt is None   # undefined p-value -> SQL null (Arrow maps NaN to null)
