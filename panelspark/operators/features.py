"""Feature engineering (F1-F8) as Spark ML stages.

``fit_feature_pipeline`` computes every statistic it needs with two aggregate
passes (medians and null counts; then means and population stds of the imputed
columns), bakes the constants into a ``SQLTransformer`` and fits the encoders
and PCAs with Spark ML. The result is one ``PipelineModel``: it transforms any
frame with the same columns, and saves/loads with Spark's model writer.

Semantics kept from the reference's column transformer:
* numeric: median impute (exact), missing indicators for columns with nulls
  at fit time, standardised with the POPULATION std (constant column -> 1);
* categorical: constant impute ('missing_data'), one-hot, unseen -> all zeros;
* PCA groups: impute + standardise + PCA(k) on the group's columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (PCA, OneHotEncoder, PCAModel, SQLTransformer, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.moments import rows_added
from panelspark.operators.quantiles import column_quantiles, exact_quantiles

MISSING = "missing_data"
BRACKET, SKETCH = [0.495, 0.505], 2_000  # around the median, ten times as wide as the sketch's error


def impute_constant(df: DataFrame, cols: Sequence[str], value: str = MISSING) -> DataFrame:
    """nulls of string columns -> a constant."""
    return df.na.fill(value, subset=list(cols))


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that hold at least one null (one aggregate, one flag per column)."""
    if not cols:
        return []
    row = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if (row[f"n{i}"] or 0) > 0]


def missing_indicators(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None,
                       prefix: str = "missing_indicator_") -> DataFrame:
    """0/1 indicator columns, only for columns that had nulls in ``fit_df``."""
    flagged = columns_with_nulls(fit_df if fit_df is not None else df, cols)
    return df.select("*", *[F.col(c).isNull().cast("int").alias(prefix + c) for c in flagged])


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians (linear interpolation) of several columns with bounded memory, from two passes over them (``column_quantiles``);
    None for a column without values."""
    found = column_quantiles(df, cols, [0.5], [BRACKET], SKETCH, exact_quantiles)
    return {c: v and v[0] for c, v in found.items()}


def impute_median(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None) -> DataFrame:
    """nulls -> the exact median of the fit frame."""
    m = medians(fit_df if fit_df is not None else df, cols)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m[c])).alias(c) if c in m else F.col(c)
                       for c in df.columns])


def standardize(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """``(x - mean) / std_pop`` with the fit frame's statistics; std 0 -> 1."""
    fit = fit_df if fit_df is not None else df
    row = fit.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        mu, sd = row[f"a{i}"], row[f"s{i}"]
        sd = 1.0 if not sd else sd
        out.append(((F.col(c) - F.lit(mu)) / F.lit(sd)).alias(c + suffix))
    keep = [c for c in df.columns if c not in cols or suffix]
    return df.select(*keep, *out)


def imputed_moments(df: DataFrame, cols: Sequence[str], fill: dict[str, float | None]) -> tuple[dict, dict]:
    """Two tables, column -> (mean, population std; 1 for a constant): of the columns with nulls as their ``fill`` (None: 0), and of
    their nulls as 0/1.

    One pass in which a task adds up its Arrow batches: an expression per column is too long a program for Spark to compile. Values are
    taken less the fill, so a median keeps the sums small: it lies within a standard deviation of the mean.
    """
    cols = list(cols)
    if not cols:
        return {}, {}
    given = np.array([0.0 if fill[c] is None else fill[c] for c in cols])
    shift = np.where(np.isfinite(given), given, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(cols)))  # rows, nulls, sums, sums of squares
        for batch in batches:
            for i in range(len(cols)):
                held = batch.column(i)
                v = (held.drop_null().to_numpy(zero_copy_only=False) if held.null_count else held.to_numpy()) - shift[i]
                total[:, i] += len(held), held.null_count, v.sum(), v @ v
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["i", "v"])

    plain = df.select(*[F.col(_q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    found = rows_added(plain.mapInArrow(run, "i int, v array<double>"), ["i"]).collect()
    n, nulls, s, ss = np.array(found[0]["v"]).reshape(4, -1) if found else np.zeros((4, len(cols)))
    with np.errstate(invalid="ignore"):
        off = np.where(nulls > 0, given - shift, 0.0)  # of the filled rows
        s, ss = s + nulls * off, ss + nulls * off * off

        def moments(s, ss, at):
            mean = s / np.maximum(n, 1)
            var = ss / np.maximum(n, 1) - mean * mean
            std = np.sqrt(np.where(var < 0, 0.0, var))
            return {c: (float(m), float(d) or 1.0) for c, m, d in zip(cols, mean + at, std)}

        return (moments(s, ss, shift) if n[0] else dict.fromkeys(cols, (0.0, 1.0))), moments(nulls, nulls, 0.0)


@dataclass
class FeatureSpec:
    numeric: list[str]
    categorical: list[str]
    # name -> (columns, n_components)
    pca_groups: dict[str, tuple[list[str], int]] = field(default_factory=dict)
    output: str = "features"


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def fit_feature_pipeline(train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """fit the column transformer on ``train`` -> PipelineModel producing ``spec.output``."""
    num, cat = list(spec.numeric), list(spec.categorical)
    groups = {n: ([c for c in cols if c in num or c in train.columns], k)
              for n, (cols, k) in spec.pca_groups.items()}
    for n, (cols, k) in groups.items():
        if k > len(cols):
            raise ValueError(f"group {n!r} has {len(cols)} columns, fewer than its {k} components (see fitting_groups)")
    all_num = list(dict.fromkeys(num + [c for cols, _ in groups.values() for c in cols]))
    # pass 1: medians
    med = medians(train, all_num)
    # pass 2: nulls, mean / population std of the imputed columns and indicators
    stats, nulls = imputed_moments(train, all_num, med)
    null_num = [c for c in num if nulls[c][0]]
    null_cat = columns_with_nulls(train, cat)
    stats |= {f"missing_indicator_{c}": nulls[c] for c in null_num}

    sel = ["*"]
    for c in all_num:
        m = med[c] if med[c] is not None else 0.0
        mu, sd = stats[c]
        sel.append(f"(coalesce(cast({_q(c)} as double), {m!r}) - {mu!r}) / {sd!r} AS {_q(c + '__z')}")
    for c in null_num:
        mu, sd = stats[f"missing_indicator_{c}"]
        sel.append(f"(cast({_q(c)} is null as double) - {mu!r}) / {sd!r} AS {_q('missing_indicator_' + c)}")
    for c in cat:
        sel.append(f"coalesce(cast({_q(c)} as string), '{MISSING}') AS {_q(c + '__s')}")
    for c in null_cat:
        sel.append(f"cast({_q(c)} is null as double) AS {_q('missing_indicator_' + c)}")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    if cat:
        stages.append(StringIndexer(inputCols=[c + "__s" for c in cat], outputCols=[c + "__i" for c in cat],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[c + "__i" for c in cat], outputCols=[c + "__oh" for c in cat],
                                    dropLast=True))  # drops the unseen slot: unseen -> all zeros
    for n, (cols, k) in groups.items():
        stages.append(VectorAssembler(inputCols=[c + "__z" for c in cols], outputCol=f"{n}__in"))
        stages.append(PCA(k=k, inputCol=f"{n}__in", outputCol=f"{n}__pca"))
    parts = ([c + "__oh" for c in cat] + [c + "__z" for c in num] + [f"missing_indicator_{c}" for c in null_num]
             + [f"missing_indicator_{c}" for c in null_cat] + [f"{n}__pca" for n in groups])
    stages.append(VectorAssembler(inputCols=parts, outputCol=spec.output, handleInvalid="error"))
    return Pipeline(stages=stages).fit(train)


def feature_names(model: PipelineModel, output: str = "features") -> list[str]:
    """F8: output feature names in vector order (one-hot, numeric, indicators, PCA).

    Read from the stages themselves, so it works on fitted, extended (``fit_final``)
    and reloaded models alike.
    """
    assembled = next(s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == output)
    labels, components = {}, {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            labels.update(zip(s.getOutputCols(), s.labelsArray))
        elif isinstance(s, PCAModel):
            components[s.getOutputCol()] = s.getK()
    names: list[str] = []
    for c in assembled.getInputCols():
        if c.endswith("__oh"):  # unseen slot dropped (dropLast)
            names += [f"{c[:-4]}_{v}" for v in labels[c[:-4] + "__i"]]
        elif c in components:
            names += [f"{c[:-5]}_pca_{i + 1}" for i in range(components[c])]
        else:
            names.append(c.removesuffix("__z"))
    return names


# Which PCA group a column belongs to: the first rule that holds. Group names and sizes are fixed values.
GROUP_COMPONENTS = {"pca_all": 5, "pca_team": 3, "pca_expected": 3, "pca_rolling_avg": 5, "other_pca": 3}


def column_group(c: str, team_cols: frozenset[str]) -> str:
    if c in team_cols:
        return "pca_team"
    for mark, group in (("expected_", "pca_expected"), ("_rolling_avg", "pca_rolling_avg")):
        if mark in c:
            return group
    return "other_pca"


def pca_groups(numeric: Sequence[str], team_cols: Sequence[str]) -> dict[str, tuple[list[str], int]]:
    """Every numeric column in one of four groups, and all of them in a fifth."""
    team = frozenset(team_cols)
    members: dict[str, list[str]] = {g: [] for g in GROUP_COMPONENTS}
    for c in numeric:
        members["pca_all"].append(c)
        members[column_group(c, team)].append(c)
    return {g: (cols, GROUP_COMPONENTS[g]) for g, cols in members.items()}


def fitting_groups(groups: dict[str, tuple[list[str], int]]) -> tuple[dict[str, tuple[list[str], int]], list[str]]:
    """The groups with enough columns for their components, and the names of the others."""
    good = {n: (cols, k) for n, (cols, k) in groups.items() if len(cols) >= k}
    return good, [n for n in groups if n not in good]
