"""Scalar column expressions.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
Division goes through ``try_divide``: Spark 4 runs in ANSI mode, where ``/``
raises on a zero denominator; the reference (non-ANSI) got a null instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str


def col(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def orient(flag: ColLike, if_true: ColLike, otherwise: ColLike) -> Column:
    """Pick a side by a boolean flag; a false or null flag takes ``otherwise``."""
    return F.when(col(flag), col(if_true)).otherwise(col(otherwise))


def decode(code: ColLike, mapping: Mapping, default) -> Column:
    """Code -> label; unmapped and null codes both map to ``default``."""
    items = list(mapping.items())
    if not items:
        return F.lit(default)
    expr = F.when(col(code) == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col(code) == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def safe_ratio(num: ColLike, den: ColLike) -> Column:
    """``num / den`` as double, null when ``den`` is 0 or null."""
    return F.try_divide(col(num), col(den))


def per_unit(num: ColLike, exposure: ColLike) -> Column:
    """Ratio to an exposure whose null counts as 0 (so the ratio is null)."""
    return F.try_divide(col(num), F.coalesce(col(exposure), F.lit(0)))


def gated(value: ColLike, gate: ColLike) -> Column:
    """The value where ``gate > 0``, else 0 (a null gate gives 0)."""
    return F.when(col(gate) > 0, col(value)).otherwise(F.lit(0))


def outcome_flags(scored: ColLike, conceded: ColLike) -> dict[str, Column]:
    """win/draw/loss as 0/1 ints; a null score gives 0 for all three."""
    s, c = col(scored), col(conceded)
    return {
        "win": F.when(s > c, 1).otherwise(0),
        "draw": F.when(s == c, 1).otherwise(0),
        "loss": F.when(s < c, 1).otherwise(0),
    }


def outcome_points(win: ColLike, draw: ColLike, win_points: int = 3, draw_points: int = 1) -> Column:
    """Points from a game (3 / 1 / 0 by default)."""
    return (F.when(col(win) == 1, win_points).when(col(draw) == 1, draw_points).otherwise(0))


def role_label(is_last_period: Column, label: ColLike, period_index: ColLike,
               min_index: int = 1) -> Column:
    """P10: 'score' for unlabelled rows of the last period past ``min_index``,
    'delete' for other unlabelled rows, else 'train'."""
    unlabelled = col(label).isNull()
    return (F.when(is_last_period & unlabelled & (col(period_index) > min_index), F.lit("score"))
             .when(unlabelled, F.lit("delete"))
             .otherwise(F.lit("train")))


def full_name(first: ColLike, last: ColLike, sep: str = " ") -> Column:
    """``first || sep || last``; null if either part is null (unlike concat_ws)."""
    return F.concat(col(first), F.lit(sep), col(last))


def safe_corr(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation of the rows where both are known; null where one is constant
    (``corr`` divides by zero there under ANSI rules)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def relevance(conditions: Iterable[Column]) -> Column:
    """Disjunction of conditions; a null result drops the row in ``filter``."""
    conds = list(conditions)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
