"""Aggregations and data profiling.

Profiles over many columns are computed in ONE pass: the columns are unpivoted
(``stack``) into (column, value) rows and grouped once, or aggregated in a single
``agg`` with one expression per column. Only result-sized tables (one row per
column, bin or group) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expr import safe_corr
from panelspark.operators import moments
from panelspark.operators.quantiles import column_quantiles, quantile_array

QUARTILES = (0.25, 0.5, 0.75)
# Percentile cut points and the widening of the outer edges used
# to bin numeric features.
BIN_PERCENTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
EDGE_PAD = 0.1


def threshold_pivot(df: DataFrame, keys: Sequence[str], rank_col: str, value_col: str,
                    thresholds: dict[str, int]) -> DataFrame:
    """A1: per key, the value at each rank in ``thresholds`` (0 when the rank is absent)."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(rank_col) == k, F.col(value_col)).otherwise(0)).alias(f"{name}_points")
        for name, k in thresholds.items()])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "column",
         val: str = "value", cast: str = "string") -> DataFrame:
    """Wide -> long over ``cols`` (values cast to one type)."""
    return df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in cols]).unpivot(
        list(ids), list(cols), var, val)


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: (column, value, n) for every categorical column, in one grouped pass."""
    long = melt(df, [], cols)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def target_by_category(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """A5: mean and size of ``target`` per value of each feature (one grouped pass)."""
    long = melt(df, [target], cols)
    return long.groupBy("column", "value").agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, n_non_null) from one aggregate row, unpivoted."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n__{i}") for i, c in enumerate(cols)],
                 *[F.count(F.col(c)).alias(f"nn__{i}") for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n__{i}").alias("n_null"), F.col(f"nn__{i}").alias("n_non_null"))
        for i, c in enumerate(cols)])))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row (first occurrences not counted).

    Aggregates per distinct row (map-side combine), then sums ``n - 1``: no
    global distinct collected anywhere.
    """
    cols = list(cols or df.columns)
    per_row = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return per_row.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicated"),
                       F.count(F.lit(1)).alias("n_distinct_rows"))


def distinct_profile(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact counts are computed per column from the unpivoted (column, value)
    pairs grouped once (partial aggregation before the shuffle), so no single
    task holds a set of all values. ``approx=True`` uses HyperLogLog++.
    """
    if approx:  # one sketch per group: a sketch per column would be thousands of slots in one plan
        return melt(df, [], cols).groupBy("column").agg(F.approx_count_distinct("value").alias("n_distinct"))
    long = melt(df, [], cols).filter(F.col("value").isNotNull())
    pairs = long.select("column", "value").distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def describe_numeric(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """A10: count, mean, sample std, min, 25/50/75 % (linear interpolation), max.

    One aggregate over the unpivoted (column, value) rows grouped by column;
    percentiles are exact. ``digits`` rounds the floating statistics.
    """
    long = melt(df, [], cols, cast="double").filter(F.col("value").isNotNull())
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    agg = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    # exact quartiles with bounded memory (one row per column joined back)
    q = quantile_array(long, ["column"], "value", QUARTILES)
    out = agg.join(q, "column")
    return out.select("column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                      "min", r(F.col("quantiles")[0]).alias("p25"), r(F.col("quantiles")[1]).alias("p50"),
                      r(F.col("quantiles")[2]).alias("p75"), "max")


def bin_edges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A11 (edges) for several numeric features at once: (feature, edges).

    Percentiles 0/20/40/60/80/100 with linear interpolation; duplicates removed
    keeping order; with exactly two edges left, a middle edge is added 0.1
    inside the edge equal to the 60th percentile; outer edges widened by 0.1.
    """
    found = column_quantiles(df, features, BIN_PERCENTILES)
    # a feature without values has no edges
    q = df.sparkSession.createDataFrame([(c, v) for c, v in found.items() if v is not None], "feature string, quantiles array<double>")
    e = q.select("feature", F.array_distinct("quantiles").alias("e"), F.col("quantiles")[3].alias("mid"))
    two = F.size("e") == 2
    fixed = (F.when(two & (F.col("e")[0] == F.col("mid")),
                    F.array(F.col("e")[0], F.col("e")[0] + EDGE_PAD, F.col("e")[1]))
              .when(two & (F.col("e")[1] == F.col("mid")),
                    F.array(F.col("e")[0], F.col("e")[1] - EDGE_PAD, F.col("e")[1]))
              .otherwise(F.col("e")))
    widened = F.transform(fixed, lambda x, i: F.when(i == 0, x - EDGE_PAD)
                          .when(i == F.size(fixed) - 1, x + EDGE_PAD).otherwise(x))
    return e.select("feature", widened.alias("edges"))


def percentile_edges(df: DataFrame, c: str) -> DataFrame:
    """A11 (edges): one row with the bin edges of ``c`` as an array."""
    return bin_edges(df, [c]).select("edges")


def assign_bins(df: DataFrame, c: str, edges: DataFrame, out: str = "bin") -> DataFrame:
    """A11 (binning): right-closed bins ``(e[i-1], e[i]]``, the lowest edge included.

    The one-row edges frame is joined as a scalar subquery (no cross join). The
    bin index is the number of inner edges below the value; values outside all
    edges (impossible after widening) get null.
    """
    e = edges.select("edges").scalar()
    return df.withColumn(out, bin_index(F.col(c).cast("double"), e))


MAX_EDGES = len(BIN_PERCENTILES)  # at most 6 edges -> at most 4 inner edges


def bin_index(x: Column, e: Column) -> Column:
    """1-based right-closed bin of ``x`` for edges ``e`` (lowest edge included),
    null outside the edges. Unrolled over the (at most 4) inner edges, so ``e``
    may be a scalar subquery."""
    idx = F.lit(1)
    for i in range(1, MAX_EDGES - 1):
        idx = idx + F.when((F.size(e) > i + 1) & (x > e[i]), 1).otherwise(0)
    inside = (x >= e[0]) & (x <= F.element_at(e, -1))
    return F.when(x.isNotNull() & inside, idx)


def target_by_bin(df: DataFrame, c: str, target: str) -> DataFrame:
    """Mean and size of ``target`` per percentile bin of ``c`` (bins with rows only)."""
    edges = percentile_edges(df, c)
    b = assign_bins(df.select(c, target), c, edges)
    e = edges.select("edges").scalar()
    return (b.filter(F.col("bin").isNotNull()).groupBy("bin")
             .agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))
             .select(F.lit(c).alias("column"), "bin", e[F.col("bin") - 1].alias("lower"), e[F.col("bin")].alias("upper"),
                     "mean", "n"))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Pearson correlation of every column pair (pairwise-complete rows) from co-moment matrices.

    Null where a column is constant."""
    r = F.round("corr", digits) if digits is not None else F.col("corr")
    return moments.correlations(df, cols).select("a", "b", r.alias("corr"))


def corr_topk(df: DataFrame, cols: Sequence[str], target: str, k: int = 20, digits: int | None = 6) -> DataFrame:
    """The ``k`` features most correlated with ``target`` (descending)."""
    agg = df.agg(*[safe_corr(c, target).alias(f"c__{i}") for i, c in enumerate(cols)])
    r = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    long = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), r(F.col(f"c__{i}")).alias("corr"))
                                         for i, c in enumerate(cols)])))
    return long.orderBy(F.col("corr").desc_nulls_last(), "feature").limit(k)


def histogram_density(df: DataFrame, c: str, bins: int = 30, group: Column | None = None,
                      digits: int | None = 9) -> DataFrame:
    """Equal-width histogram between min and max, density = n / (N * width).

    The maximum falls in the last bin. With ``group``, bins are shared and the
    density is normalised per group (as an overlaid density plot).
    """
    g = group if group is not None else F.lit("all")
    base = df.select(g.cast("string").alias("group"), F.col(c).cast("double").alias("x")).filter(F.col("x").isNotNull())
    mm = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = base.withColumn("bin", b).groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = base.groupBy("group").agg(F.count(F.lit(1)).alias("__total"))
    r = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return counts.join(totals, "group").select(
        "group", "bin", r(lo + F.col("bin") * width).alias("lower"), r(lo + (F.col("bin") + 1) * width).alias("upper"),
        "n", r(F.col("n") / (F.col("__total") * width)).alias("density"))


def zero_share(df: DataFrame, target: str, flag: Column | None = None) -> DataFrame:
    """Share of rows with ``target`` = 0 and the sum of a 0/1 flag."""
    aggs = [F.avg(F.when(F.col(target) == 0, 1.0).otherwise(0.0)).alias("zero_share"),
            F.count(F.lit(1)).alias("n")]
    if flag is not None:
        aggs.append(F.sum(flag).alias("flag_sum"))
    return df.agg(*aggs)
