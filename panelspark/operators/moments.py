"""Co-moment matrices: one array pass instead of one expression per column pair (A12, sufficient statistics of M1-M4).

Every task multiplies its Arrow batches as matrices and leaves one row per column; the rows are added up by column. Values
are taken less a shift near their centre, so the sums keep their digits. A matrix depends on the number of columns
alone; column pairs beyond ``BLOCK`` columns are taken block by block, each reading its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256  # columns of a block of pairs
MAX_FEATURES = 4096  # of a moment matrix on the driver: 128 MB of doubles
_LIST = pa.list_(pa.float64())


def rows_added(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sums of the array column ``v`` by ``keys`` (integers)."""
    names = [*keys, "v"]
    parts = max(1, int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))]))
            for r, key in enumerate(ids):
                v = batch.column(len(keys))[r].values.to_numpy()
                total[key] = total[key] + v if key in total else v.copy()
        if total:
            cols = [pa.array([k[i] for k in total], pa.int32()) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(total.values()), _LIST)], names=names)

    return partial.repartition(parts, *keys).mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", v array<double>")


# ---- pairwise-complete correlation (A12) -----------------------------------------------------------------------


def _block_moments(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, nan) of every pair of a ``left`` and a ``right`` column over the rows where both are set."""
    cols = list(dict.fromkeys([*left, *right]))
    at = {c: k for k, c in enumerate(cols)}
    li, ri = [at[c] for c in left], [at[c] for c in right]
    num = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    centre = num.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in num.columns]).first()
    shift = np.array([c if c is not None and np.isfinite(c) else 0.0 for c in centre])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            m = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(float)
            nan = np.isnan(x) & (m > 0)
            x = np.where(np.isnan(x), 0.0, x - shift) * m
            a, b, p, q = x[:, li], x[:, ri], m[:, li], m[:, ri]
            got = np.stack([p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b,
                            nan[:, li].T.astype(float) @ q + p.T @ nan[:, ri].astype(float)])
            total = got if total is None else total + got
        if total is not None:
            rows = np.moveaxis(total, 1, 0).reshape(len(li), -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(li)), pa.int32()), pa.array(list(rows), _LIST)], names=["i", "v"])

    added = rows_added(num.mapInArrow(run, "i int, v array<double>"), ["i"])
    w = len(ri)
    part = [F.element_at("v", F.col("j") + (1 + k * w)).alias(name) for k, name in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy", "nan"))]
    return added.select("i", "v", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("j")).select("i", "j", *part)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every ordered pair: Pearson's correlation over the rows where both are set; null where one of them is constant there,
    NaN where one holds a NaN."""
    cols = list(cols)
    blocks = [cols[i:i + BLOCK] for i in range(0, len(cols), BLOCK)]
    out = None
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            p = _block_moments(df, left, right)
            n = F.col("n")
            cxx, cyy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
            cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
            # what rounding leaves of a constant's spread counts as none
            flat = (n < 2) | (cxx <= F.col("sxx") * 1e-14) | (cyy <= F.col("syy") * 1e-14)
            r = F.when(n > 0, F.when(F.col("nan") > 0, F.lit(float("nan"))).when(~flat, F.greatest(F.least(cxy / F.sqrt(cxx * cyy), F.lit(1.0)), F.lit(-1.0))))
            a, b = (F.element_at(F.array(*[F.lit(c) for c in names]), F.col(i) + 1) for names, i in ((left, "i"), (right, "j")))
            pairs = p.select(a.alias("a"), b.alias("b"), r.alias("corr"))
            if left is not right:
                pairs = pairs.select(F.inline(F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))))
            out = pairs if out is None else out.unionByName(pairs)
    return out


# ---- sufficient statistics per fold ------------------------------------------------------------------------------


@dataclass
class Moments:
    """Row count, means and centred co-moments of the features and, last, the label."""
    n: int
    mean: np.ndarray
    c: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.mean) - 1

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.c + other.c + np.outer(d, d) * (self.n * other.n / n))


def fold_moments(data: DataFrame, features: str = "features", label: str = "label", fold_col: str = "fold") -> dict[int, Moments]:
    """Moments of every fold in one pass over the rows; rows with a null fold, label or feature vector are left out.

    Folds x features^2 numbers reach the driver, however many rows there are."""
    rows = data.where(F.col(fold_col).isNotNull() & F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(fold_col).cast("int").alias("fold"),
        F.concat(vector_to_array(features), F.array(F.col(label).cast("double"))).alias("z"))
    first = rows.select("z").first()
    if first is None:
        return {}
    shift = np.array(first["z"])
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            z = batch.column(1).flatten().to_numpy().reshape(-1, d) - shift
            z = np.concatenate((np.ones((len(z), 1)), z), axis=1)
            for k in np.unique(fold):
                part = z[fold == k]
                total[int(k)] = total.get(int(k), 0.0) + part.T @ part
        for k, gram in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array(list(gram), _LIST)],
                                             names=["fold", "i", "v"])

    grams: dict[int, np.ndarray] = {}
    for k, i, v in rows_added(rows.mapInArrow(run, "fold int, i int, v array<double>"), ["fold", "i"]).collect():
        grams.setdefault(k, np.zeros((d + 1, d + 1)))[i] = v
    out = {}
    for k, g in grams.items():
        n, s = int(round(g[0, 0])), g[0, 1:]
        out[k] = Moments(n, shift + s / n, g[1:, 1:] - np.outer(s, s) / n)
    return out
