"""Side-by-side check of a registered Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of the values (columns sorted by name). Floats are compared exactly
and, separately, with a relative tolerance so last-bit differences are visible.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.sources.tables import TABLES  # noqa: E402


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT", "array<double>": "DOUBLE[]"}


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(root, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, v)
    if hasattr(v, "isoformat"):
        return (2, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (3, repr(v))
    if isinstance(v, bool):
        return (4, int(v))
    if isinstance(v, int):
        return (1, float(v)) if abs(v) < 2**53 else (5, v)
    return (6, str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=lambda t: tuple((k, str(x)) for k, x in t))
    return [cols[i] for i in order], out


def _close(a, b, rel=1e-9):
    if a[0] != b[0]:
        return False
    if a[0] == 1:
        return a[1] == b[1] or abs(a[1] - b[1]) <= rel * max(1.0, abs(a[1]), abs(b[1]))
    return a[1] == b[1]


def compare(spark, name: str, fn, sql: str | None, root: str, con=None) -> dict:
    df = fn(spark, root)
    scols = df.columns
    srecs = [tuple(r) for r in df.collect()]
    res = {"query": name, "spark_rows": len(srecs)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(root)
    rel = con.sql(sql)
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drecs = rel.fetchall()
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    res["types_match"] = all(stypes.get(c) == t for c, t in zip(dcols, dtypes))
    if not res["types_match"]:
        res["types_diff"] = [(c, stypes.get(c), t) for c, t in zip(dcols, dtypes) if stypes.get(c) != t]
    res["oracle_rows"] = len(drecs)
    sc, sr = rows_of(scols, srecs)
    dc, dr = rows_of(dcols, drecs)
    res["cols_match"] = sc == dc
    if not res["cols_match"]:
        res["cols_diff"] = (sorted(set(sc) - set(dc)), sorted(set(dc) - set(sc)))
    res["rows_match"] = len(sr) == len(dr)
    res["exact"] = res["cols_match"] and sr == dr
    close = res["cols_match"] and res["rows_match"] and all(
        all(_close(a, b) for a, b in zip(x, y)) for x, y in zip(sr, dr))
    res["close"] = close
    if res["cols_match"] and res["rows_match"] and not res["exact"]:
        for x, y in zip(sr, dr):
            if x != y:
                res["first_diff"] = [(sc[i], x[i], y[i]) for i in range(len(x)) if x[i] != y[i]][:4]
                break
    res["status"] = ("exact" if res["exact"] else ("close" if close else "MISMATCH"))
    if not res["types_match"]:
        res["status"] += "+TYPES"
    return res


if __name__ == "__main__":
    import time

    from panelspark import registry
    from panelspark.session import local_session

    root = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    registry.load_all()
    spark = local_session(8)
    con = duck(root)
    for n in names or list(registry.QUERIES):
        t0 = time.time()
        try:
            r = compare(spark, n, registry.QUERIES[n], registry.ORACLE.get(n), root, con)
        except Exception as e:  # report and go on
            r = {"query": n, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        r["sec"] = round(time.time() - t0, 1)
        print(r, flush=True)
