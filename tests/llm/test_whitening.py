"""Embedding whitening: exact sums and polynomials against Fractions, eigenvectors against numpy, close and repeated roots, edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from panelspark.llm import queries, whitening as W  # noqa: F401
from panelspark.registry import QUERIES

ROOT = "/root/testdata/sf0.001"


def exact_polynomial(m):
    """Faddeev-LeVerrier, in integers."""
    d, a = len(m), np.array(m, object)
    out, b = [1], np.eye(d, dtype=int).astype(object)
    for k in range(1, d + 1):
        ab = a.dot(b)
        c = -sum(ab[i, i] for i in range(d))
        assert c % k == 0
        out.append(c // k)
        b = ab + np.eye(d, dtype=int).astype(object) * out[-1]
    return out[::-1]


def random_psd(rng, d, rank, size=50):
    x = rng.integers(-size, size, (rank, d)).astype(object)
    return x.T.dot(x)


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (5, 5), (7, 3), (12, 12)])
def test_polynomial(spark, d, rank):
    m = random_psd(np.random.default_rng(d), d, rank)
    assert W.polynomial(spark, m, group=2) == exact_polynomial(m)


def test_polynomial_of_zero_and_diagonal(spark):
    assert W.polynomial(spark, np.zeros((3, 3), object)) == [0, 0, 0, 1]
    assert W.polynomial(spark, np.diag([2, 0, 5]).astype(object)) == exact_polynomial(np.diag([2, 0, 5]).astype(object))


def poly_of_roots(roots):
    out = [1]
    for r in roots:
        out = [(out[i - 1] if i else 0) - r * (out[i] if i < len(out) else 0) for i in range(len(out) + 1)]
    return out


def test_roots_repeated_close_and_exact():
    roots = [10**12 + 1, 10**12, 7, 7, 7, 3, 0, 0]
    got = W.largest_roots(poly_of_roots(roots), 8)
    assert [(round(r), m) for r, m in got] == [(10**12 + 1, 1), (10**12, 1), (7, 3), (3, 1)]
    assert all(abs(r - round(r)) < Fraction(1, 10**30) for r, _ in got)
    assert [m for _, m in W.largest_roots(poly_of_roots(roots), 3)] == [1, 1, 3]
    assert W.largest_roots([0, 0, 1], 4) == []


def test_gram_of_large_and_negative_entries():
    rng = np.random.default_rng(3)
    for high in (1, 1 << 10, 1 << 30, 1 << 46):
        z = rng.integers(-high, high + 1, (300, 4))
        assert (W._gram(z) == z.astype(object).T.dot(z.astype(object))).all()
    assert (W._gram(np.full((5, 2), -1)) == 5).all()


def test_vectors_of_nearly_equal_eigenvalues():
    # Two eigenvalues that differ by 1 in 10^24: double precision would mix their vectors.
    big = 10**24
    m = np.array([[2 * big + 1, 1, 0], [1, 2 * big + 1, 0], [0, 0, 5]], object)  # 2 big + 2 (1, 1), 2 big (1, -1), 5
    h = math.sqrt(0.5)
    for root, want in ((2 * big + 2, [h, h, 0]), (2 * big, [h, -h, 0]), (5, [0, 0, 1])):
        v = W.null_space(m, Fraction(root), 1)[:, 0]
        assert np.abs(np.abs(v @ want) - 1) < 1e-15 and np.abs(np.abs(v) - np.abs(want)).max() < 1e-15


def brute(vectors, k=16):
    """{id: deviation}, eigenvalues and whitened coordinates by Fractions and numpy."""
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in vectors}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    c = np.array([[a * n - b for a, b in zip(v, s)] for v in fit], float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    white = {i: (np.array([a * n - b for a, b in zip(v, s)], float) / n) @ u / np.sqrt(e) for i, v in x.items()}
    return n, dev, e, e / np.trace(c.T @ c / n), white


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = W.whiten(df, components_wanted=16).collect()
    n, dev, e, share, white = brute(rows)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n} and n == 400
    sign = {}
    for r in got:
        k = r["component"] - 1
        assert int(r["deviation"]) == dev[r["vec_id"]]
        assert abs(r["explained"] - share[k]) < 1e-9
        want = white[r["vec_id"]][k]
        sign.setdefault(k, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-3 else None
    for r in got:
        k = r["component"] - 1
        assert abs(r["whitened"] - sign[k] * white[r["vec_id"]][k]) < 1e-7
    assert {r["identity_error"] < 1e-10 for r in got} == {True}


def test_repeated_eigenvalues_and_low_rank(spark):
    # the corners of a cube in four dimensions: one eigenvalue three times, one zero
    rows = [(i, [float(bool(i & 1)), float(bool(i & 2)), float(bool(i & 4)), 1.0]) for i in range(8)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted({r["component"] for r in got}) == [1, 2, 3] and len(got) == 24
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    assert all(abs(sum(r["whitened"] ** 2 for r in got if r["vec_id"] == i) - 3) < 1e-12 for i in range(8))


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, z string, id int"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    bad = [(1, None, "a", 1), (2, [], "a", 1), (3, [1.0, None], "a", 1), (4, [float("nan"), 1.0], "a", 1), (5, [float("inf"), 1.0], "a", 1)]
    assert W.whiten(spark.createDataFrame(bad, schema)).collect() == []
    same = [(i, [0.5, 0.25], "a", 1) for i in range(4)]
    assert W.whiten(spark.createDataFrame(same, schema)).collect() == []
    two = [(1, [0.0, 0.0], "a", 1), (1, [0.0, 0.0], "a", 1), (None, [1.0, 0.0], "a", 1), (7, [1.0, 2.0, 3.0], "a", 1), (8, [-1e300, 0.0], "a", 1)]
    got = W.whiten(spark.createDataFrame(bad + two, schema)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 8), (True, 0)]
    assert {r["n"] for r in got} == {3} and all(math.isfinite(r["whitened"]) for r in got)


def test_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    n, dev, e, share, white = brute(rows)
    got = QUERIES["op12_whitening"](spark, ROOT).collect()
    assert len(got) == 16 * len(rows)
    for r in got:
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]] and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-4
        assert abs(abs(r["whitened"]) - abs(white[r["vec_id"]][r["component"] - 1])) < 1e-6
