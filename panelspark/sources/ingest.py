"""Ingest operators: nested-JSON flatten, multi-period union, keyed upsert,
season bounds (S4-S8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def flatten_array(df: DataFrame, field: Column | str, parent: Sequence[str] = (),
                  element_schema: DataType | str | None = None, outer: bool = False) -> DataFrame:
    """Array-of-objects field -> one row per element, parent attributes attached.

    ``field`` is an ``array<struct>`` column, or a JSON string parsed with
    ``element_schema`` (the schema of the array). The explode is a generator
    inside the scan's stage: no shuffle.
    """
    c = F.col(field) if isinstance(field, str) else field
    if element_schema is not None:
        c = F.from_json(c, element_schema)
    gen = F.explode_outer(c) if outer else F.explode(c)
    return df.select(*parent, gen.alias("__e")).select(*parent, "__e.*")


def union_seasons(frames: dict[int, DataFrame], season_col: str = "season_start_year",
                  drop: Sequence[str] = ("Unnamed: 0",)) -> DataFrame:
    """Stamp each period's frame with its season and union by column name.

    Missing columns are null-filled; stray index columns in ``drop`` are removed;
    absent periods (None) are skipped. Union is a plan concatenation, no shuffle.
    """
    out = None
    for season, df in sorted(frames.items()):
        if df is None:
            continue
        df = df.drop(*[c for c in drop if c in df.columns]).withColumn(season_col, F.lit(int(season)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames to union")
    return out


def upsert_keep_last(prev: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
                     prev_filter: Column | None = None) -> DataFrame:
    """``concat(prev, new).drop_duplicates(keys, keep='last')`` made deterministic.

    The new batch wins over the previous table; within a batch the row that is
    last in ``order`` wins, and of rows equal there the one whose other columns have the largest hash, so that
    every run keeps the same one (map columns cannot be hashed and do not count). ``prev_filter`` (S7) keeps only settled previous
    rows. One shuffle on ``keys``; ``row_number() = 1`` is planned with a
    partial top-1 (WindowGroupLimit) before the exchange, so a hot key sends
    one row per map task, not all of its copies.
    """
    if prev_filter is not None:
        prev = prev.filter(prev_filter)
    cols = list(dict.fromkeys(list(prev.columns) + [c for c in new.columns if c not in prev.columns]))
    u = (prev.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)),
                                                         allowMissingColumns=True))
    rest = [F.col(f.name) for f in u.schema if f.name in cols and f.name not in (*keys, *order) and "map<" not in f.dataType.simpleString()]
    ties = [F.xxhash64(*rest).desc()] if rest else []
    w = Window.partitionBy(*keys).orderBy(F.col("__batch").desc(), *[F.col(c).desc() for c in order], *ties)
    return u.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).select(*cols)


def season_bounds(df: DataFrame, ts: str, n_previous: int = 4) -> DataFrame:
    """S8 (+P14): current season = min two-digit year of the non-null timestamps;
    rows for it and the ``n_previous`` seasons before it."""
    cur = df.filter(F.col(ts).isNotNull()).agg(
        F.min(F.date_format(ts, "yy").cast("int")).alias("current"))
    return cur.select(F.explode(F.sequence(F.col("current") - n_previous, F.col("current"))).alias("season"),
                      F.col("current")).select("season", (F.col("season") == F.col("current")).alias("is_current"))
