"""Exact quantiles with bounded memory (linear interpolation between order statistics).

Spark's exact ``percentile``/``median`` keep a map of every distinct value and
merge it in one task per group: unbounded for high-cardinality columns. Here
the order statistics are found by narrowing brackets instead:

1. per (group, quantile) the target ranks floor/ceil of q*(n-1) are known;
2. while a bracket holds more than ``max_candidates`` rows and more than one value, a sketch
   (``percentile_approx`` over a grid of fractions, memory O(accuracy)) of the
   values inside it gives a narrower bracket around the target rank; the new
   bracket is kept only after exact counts confirm it still contains the
   target (so the sketch's error never affects the result);
3. the values left in each bracket are counted per distinct value, and the
   order statistics follow from running counts over the distinct values.

Each round shrinks a bracket by about ``grid / 4``; the rounds end when no bracket
can be narrowed any more: it is small, holds one value, or a few values hold almost all of its rows. Repeated values
cost one row each, however often they occur. Every step is a distributed scan + aggregate; the
bracket table (one row per group and quantile) stays distributed and is broadcast only behind a size check.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import sized_broadcast
from panelspark.session import cut_lineage

MAX_CANDIDATES = 1_000_000
GRID = 1000
ACCURACY = 20_000
BROADCAST_BRACKETS = 100_000  # bracket rows that may be broadcast
MARGIN, SKETCH = 0.001, 10_000  # of the brackets of ``column_quantiles``: half their width, ten times the sketch's error


def _inside() -> Column:
    return (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))


def exact_quantiles(long: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float],
                    max_candidates: int = MAX_CANDIDATES, grid: int = GRID, accuracy: int = ACCURACY) -> DataFrame:
    """(groups..., qi, q, value): the q-quantiles of ``value`` per group, nulls ignored.

    Same definition as numpy/pandas 'linear' and SQL ``quantile_cont``. A null group is a group.
    """
    out_groups = list(groups)
    if out_groups:
        x = long.select(*groups, F.col(value).cast("double").alias("__x"))
    else:
        # one group: its key comes from an unpivot (a literal key would be folded away
        # by the optimizer, turning the equi-joins below into nested-loop joins)
        groups = ["__all"]
        x = long.select(F.col(value).cast("double").alias("__x")).unpivot([], ["__x"], "__all", "__v") \
                .select("__all", F.col("__v").alias("__x"))
    x = x.filter(F.col("__x").isNotNull())
    n = x.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    pos = F.col("__q") * (F.col("__n") - 1)
    state = (n.select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("__qi", "__q"))
              .select(*groups, "__qi", "__q", F.floor(pos).cast("long").alias("__klo"),
                      F.ceil(pos).cast("long").alias("__khi"), (pos - F.floor(pos)).alias("__frac"), "__lo", "__hi",
                      F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__size")))
    keys = [*groups, "__qi"]
    state = cut_lineage(state)
    is_open = (F.col("__size") > max_candidates) & (F.col("__lo") < F.col("__hi"))
    stuck = F.lit(False)
    while True:
        wanted = state.filter(is_open & ~stuck)
        if wanted.isEmpty():
            break
        inside = null_safe_groups(x, sized_broadcast(wanted.drop("__n"), BROADCAST_BRACKETS), groups).filter(_inside())
        fr = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
        sk = inside.groupBy(*keys, "__klo", "__khi", "__below", "__size", "__lo", "__hi").agg(F.percentile_approx("__x", fr, accuracy).alias("__sk"))
        # sketch positions around the targets' relative ranks, widened by two grid steps
        rel_lo = (F.col("__klo") - F.col("__below")) / F.col("__size")
        rel_hi = (F.col("__khi") - F.col("__below")) / F.col("__size")
        i_lo = F.greatest(F.floor(rel_lo * grid) - 2, F.lit(0)).cast("int")
        i_hi = F.least(F.ceil(rel_hi * grid) + 2, F.lit(grid)).cast("int")
        prop = cut_lineage(sk.select(*keys, "__lo", "__hi", F.element_at("__sk", i_lo + 1).alias("__nlo"), F.element_at("__sk", i_hi + 1).alias("__nhi")))
        # exact counts for the proposals: below the new low, and inside the new bracket
        cnt = (null_safe_groups(x, sized_broadcast(prop, BROADCAST_BRACKETS), groups).filter(_inside())
                .groupBy(*keys, "__nlo", "__nhi").agg(
                    F.count_if(F.col("__x") < F.col("__nlo")).alias("__cb"),
                    F.count_if((F.col("__x") >= F.col("__nlo")) & (F.col("__x") <= F.col("__nhi"))).alias("__ci")))
        p2 = null_safe_groups(state, cnt, keys, "left")
        nb = F.col("__below") + F.col("__cb")
        ok = F.coalesce((nb <= F.col("__klo")) & (nb + F.col("__ci") - 1 >= F.col("__khi")) & (F.col("__ci") < F.col("__size")), F.lit(False))
        kept = ["__lo", "__hi", "__below", "__size"]
        state = cut_lineage(p2.select(
            *keys, "__q", "__klo", "__khi", "__frac",
            *[F.when(ok, c).otherwise(F.col(k)).alias(k) for k, c in zip(kept, (F.col("__nlo"), F.col("__nhi"), nb, F.col("__ci")))],
            # a bracket that did not shrink is counted as it is
            (F.col("__cb").isNotNull() & ~ok | (F.col("__stuck") if "__stuck" in state.columns else F.lit(False))).alias("__stuck")))
        stuck = F.col("__stuck")
    # quantiles sharing a bracket share one ranking of its distinct values
    bkeys = [*groups, "__lo", "__hi"]
    br = state.select(*bkeys, "__below").distinct()
    counts = (null_safe_groups(x, sized_broadcast(br, BROADCAST_BRACKETS), groups).filter(_inside())
              .groupBy(*bkeys, "__below", "__x").agg(F.count(F.lit(1)).alias("__c")))
    w = Window.partitionBy(*bkeys).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("__below") + F.sum("__c").over(w) - 1
    ranked = counts.select(*bkeys, "__x", (last - F.col("__c") + 1).alias("__first"), last.alias("__last"))
    targets = state.select(*keys, "__lo", "__hi", "__q", "__frac", "__klo", "__khi")

    def here(rank: str) -> Column:
        return (F.col(rank) >= F.col("__first")) & (F.col(rank) <= F.col("__last"))

    # part of the join condition: two rows per target leave the join
    hit = null_safe_groups(ranked, sized_broadcast(targets, BROADCAST_BRACKETS), bkeys).filter(here("__klo") | here("__khi"))

    def at(rank: str) -> Column:
        return F.max(F.when(here(rank), F.col("__x")))

    agg = hit.groupBy(*keys, "__q", "__frac").agg(at("__klo").alias("__vlo"), at("__khi").alias("__vhi"))
    val = F.when(F.col("__frac") == 0, F.col("__vlo")).otherwise(
        F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo")))
    return agg.select(*out_groups, F.col("__qi").alias("qi"), F.col("__q").alias("q"), val.alias("value"))


def null_safe_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` (null equals null); right columns that ``left`` has too are dropped from the right."""
    from panelspark.operators.joins import null_safe_join
    return null_safe_join(left, right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, how)


def quantile_array(long: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float], **kw) -> DataFrame:
    """(groups..., quantiles: array<double> in the order of ``qs``)."""
    q = exact_quantiles(long, groups, value, qs, **kw)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("qi", "value"))), lambda s: s["value"])
    return q.groupBy(*groups).agg(arr.alias("quantiles"))


def _evenly(values: np.ndarray, points: int) -> tuple[np.ndarray, float]:
    """At most ``points`` of the sorted ``values`` at even distances, and the number of values that each stands for."""
    k = min(len(values), points)
    return values[((np.arange(k) + 0.5) * len(values) / k).astype(np.int64)], len(values) / k


def _sketched(x: DataFrame, ends: Sequence[float], accuracy: int) -> dict[int, dict]:
    """{column number: n, nan, e}: values and NaNs of every column, and about its ``ends`` quantiles (minus and plus infinity at 0 and 1).

    A batch leaves ``accuracy`` / 10 of its sorted values, a task the points that it gathered, thinned as soon as there are eight times
    as many; ranks are off by some 10 / ``accuracy`` of the rows at most. One row per column reaches the driver.
    """
    width, points = len(x.columns), max(2, accuracy // 10)
    names = ["i", "n", "nan", "v", "w"]

    def thin(held: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        v, w = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(v, kind="stable")
        v, upto = v[order], np.cumsum(w[order])
        at = np.searchsorted(upto, (np.arange(k) + 0.5) * upto[-1] / k)
        return [(v[np.minimum(at, len(v) - 1)], np.full(k, upto[-1] / k))]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nan = np.zeros(width, np.int64), np.zeros(width, np.int64)
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        for batch in batches:
            for i in range(width):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                n[i] += len(v)
                odd = np.isnan(v)
                if odd.any():
                    nan[i] += np.count_nonzero(odd)
                    v = v[~odd]
                if len(v):
                    v, each = _evenly(np.sort(v), points)
                    held[i].append((v, np.full(len(v), each)))
                    if sum(len(h[0]) for h in held[i]) > 8 * points:
                        held[i] = thin(held[i], 4 * points)
        for i in np.flatnonzero(n):
            v, w = (np.concatenate(c) for c in zip(*held[i])) if held[i] else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n[i]], pa.int64()), pa.array([nan[i]], pa.int64()),
                                              pa.array([v], pa.list_(pa.float64())), pa.array([w], pa.list_(pa.float64()))], names=names)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        held: dict[int, list] = {}
        for batch in batches:
            for k, i in enumerate(batch.column(0).to_pylist()):
                n[i] = n.get(i, 0) + np.array([batch.column(c)[k].as_py() for c in (1, 2)])
                held.setdefault(i, []).append(tuple(batch.column(c)[k].values.to_numpy() for c in (3, 4)))
        for i, parts in held.items():
            v, w = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(v, kind="stable")
            v, upto = v[order], np.cumsum(w[order])
            e = []
            for k, end in enumerate(ends):
                if not len(v) or end <= 0 or end >= 1:
                    e.append(-np.inf if end <= 0 else np.inf)
                else:  # one point further out
                    at = int(np.searchsorted(upto, end * upto[-1] * (1 - 1e-12))) + (1 if k % 2 else -1)
                    e.append(v[min(max(at, 0), len(v) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([c], pa.int64()) for c in n[i]],
                                              pa.array([e], pa.list_(pa.float64()))], names=["i", "n", "nan", "e"])

    parts = max(1, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (x.mapInArrow(sketch, "i int, n long, nan long, v array<double>, w array<double>")
             .repartition(parts, "i").mapInArrow(ranked, "i int, n long, nan long, e array<double>").collect())
    none = {"n": 0, "nan": 0, "e": None}
    return {i: none for i in range(width)} | {r["i"]: r.asDict() for r in found}


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], brackets: Sequence[tuple[float, float]] | None = None,
                     accuracy: int = SKETCH, exact: Callable[..., DataFrame] = exact_quantiles) -> dict[str, list[float] | None]:
    """Exact quantiles (linear interpolation) of several columns with bounded memory, nulls ignored; None for a column without values.

    Two passes over the columns as they are, without a row for each value: a sketch of a column gives narrow ``brackets`` around all its
    quantiles, then the rows below each bracket are counted and the values inside counted each. A column with a quantile outside its
    bracket or with NaN goes through ``exact``.
    """
    cols, qs = list(dict.fromkeys(cols)), [float(q) for q in qs]
    if not cols:
        return {}
    brackets = [(max(0.0, q - MARGIN), min(1.0, q + MARGIN)) for q in qs] if brackets is None else [tuple(b) for b in brackets]
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ends = [e for b in brackets for e in b]
    row = _sketched(x, ends, accuracy)
    sought = [i for i in range(len(cols)) if row[i]["n"] and not row[i]["nan"]]
    # a key for each column and quantile: column number * len(qs) + quantile number
    lows, highs = [[row[i]["e"][k::2] for i in sought] for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(sought) * len(qs), np.int64)
        for batch in batches:
            for k in range(len(sought)):
                values = batch.column(k).drop_null().to_numpy(zero_copy_only=False) + 0.0
                for j, (low, high) in enumerate(zip(lows[k], highs[k])):
                    at = k * len(qs) + j
                    low_ones = values < low
                    below[at] += np.count_nonzero(low_ones)
                    held, n = np.unique(values[~low_ones & (values <= high)], return_counts=True)
                    if len(held):
                        yield _counted(np.full(len(held), at), held, n)
        yield _counted(np.arange(len(below)), None, below)

    def _counted(at, held, n) -> pa.RecordBatch:
        values = pa.nulls(len(at), pa.float64()) if held is None else pa.array(held)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), values, pa.array(n.astype(np.int64))], names=["k", "v", "n"])

    found: dict[int, dict[int, float]] = {i: {} for i in sought}
    if sought:
        counts = (x.select(*[f"c{i}" for i in sought]).mapInArrow(run, "k int, v double, n long")
                  .groupBy("k", "v").agg(F.sum("n").alias("n")))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first())) - 1
        ranks = [q * (row[i]["n"] - 1) for i in sought for q in qs]

        def rank(f) -> Column:
            return F.element_at(F.array(*[F.lit(f(r)).cast("long") for r in ranks]), F.col("k") + 1)

        ranked = counts.select("k", "v", "n", upto.alias("last"), rank(math.floor).alias("lo"), rank(math.ceil).alias("hi"))

        def at(rank: str) -> Column:
            return F.max(F.when(F.col("v").isNotNull() & (F.col("last") >= F.col(rank)) & (F.col("last") - F.col("n") < F.col(rank)), F.col("v")))

        for r in ranked.groupBy("k").agg(at("lo").alias("a"), at("hi").alias("b")).collect():
            if r["a"] is not None and r["b"] is not None:
                part = ranks[r["k"]] - math.floor(ranks[r["k"]])
                found[sought[r["k"] // len(qs)]][r["k"] % len(qs)] = r["a"] if r["a"] == r["b"] or not part else r["a"] + part * (r["b"] - r["a"])
    out = {c: [found[i][j] for j in range(len(qs))] if len(found.get(i, ())) == len(qs) else None for i, c in enumerate(cols)}
    rest = [c for i, c in enumerate(cols) if row[i]["n"] and out[c] is None]
    if rest:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in rest]).unpivot([], rest, "column", "value")
        for r in exact(long, ["column"], "value", qs).collect():
            out[r["column"]] = (out[r["column"]] or [None] * len(qs))[:r["qi"]] + [r["value"]] + (out[r["column"]] or [None] * len(qs))[r["qi"] + 1:]
    return out
