"""Rank-revealing least squares by a tall-skinny QR.

Every task reduces its rows of (1, features, label) to a triangle, triangles are stacked and reduced again in groups, and the last
one reaches the driver: features^2 numbers, however many rows there are. Orthogonal steps keep the digits that normal equations
square away. Columns that depend on the ones before them (the intercept first) are found on the triangle and reported, not solved for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 16  # triangles stacked by one task
DEPENDENT = 1e-9  # share of a column's length that the columns before it leave


@dataclass
class LeastSquares:
    n: int
    rank: int
    coefficients: np.ndarray  # features, then the intercept if there is one; NaN: depends on the columns before it
    std_errors: np.ndarray

    @property
    def degrees_of_freedom(self) -> int:
        return self.n - self.rank


def _reduced(rows: DataFrame) -> DataFrame:
    """(n, v): the rows of one triangle per task; the first carries the number of rows behind them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, None
        for batch in batches:
            if batch.num_rows:
                z = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                n += int(batch.column(0).to_numpy().sum())
                r = np.linalg.qr(z if r is None else np.vstack((r, z)), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n] + [0] * (len(r) - 1), pa.int64()), pa.array(list(r), pa.list_(pa.float64()))], names=["n", "v"])

    return rows.mapInArrow(run, "n long, v array<double>")


def least_squares(data: DataFrame, features: str = "features", label: str = "label", fit_intercept: bool = True) -> LeastSquares:
    """Ordinary least squares over the rows without a null label or feature vector."""
    one = [F.array(F.lit(1.0))] if fit_intercept else []
    rows = data.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.lit(1).cast("long").alias("n"), F.concat(*one, vector_to_array(features), F.array(F.col(label).cast("double"))).alias("v"))
    parts, part = max(1, rows.sparkSession.sparkContext.defaultParallelism), _reduced(rows)
    while parts > 1:  # the rows of a triangle may be dealt anywhere: what is stacked is the rows
        parts = -(-parts // GROUP)
        part = _reduced(part.repartition(parts, F.xxhash64("v")))
    got = part.collect()
    if not got:
        raise ValueError("least squares needs rows")
    n, r = sum(x["n"] for x in got), np.array([x["v"] for x in got])
    d = r.shape[1] - 1
    basis, kept = np.zeros((len(r), 0)), []
    for j in range(d):
        c = r[:, j].copy()
        for _ in range(2):
            c -= basis @ (basis.T @ c)
        length = np.linalg.norm(c)
        if length > DEPENDENT * np.linalg.norm(r[:, j]):
            kept.append(j)
            basis = np.column_stack((basis, c / length))
    y = r[:, d]
    upper = basis.T @ r[:, kept]
    inverse = np.linalg.inv(upper) if kept else np.zeros((0, 0))
    free = n - len(kept)
    rss = float(np.sum((y - basis @ (basis.T @ y)) ** 2))
    beta, error = np.full(d, np.nan), np.full(d, np.nan)
    beta[kept] = inverse @ (basis.T @ y)
    if free > 0:
        error[kept] = np.sqrt(rss / free * np.sum(inverse ** 2, axis=1))
    order = [*range(1, d), 0] if fit_intercept else list(range(d))
    return LeastSquares(n, len(kept), beta[order], error[order])
