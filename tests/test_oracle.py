"""Every query with oracle SQL equals DuckDB on the sf0.001 tables (rows, columns, values)."""

import pytest

from panelspark import registry
from tests.oracle_harness import compare, duck

ROOT = "/root/testdata/sf0.001"
registry.load_all()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_duckdb(spark, con, name):
    r = compare(spark, name, registry.QUERIES[name], registry.ORACLE[name], ROOT, con)
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["types_match"], r
    assert r["status"] in ("exact", "close"), r


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
