"""Windows over hot partitions, split into ordered segments.

A window partitioned by a low-cardinality key (a team in a season, one busy
entity) sends all of that key's rows to one task. These helpers add a segment
column that is a monotone function of the order column (for example the month
of the kickoff) and partition the windows by (key, segment), so one key's rows
spread over many tasks. Results are exactly those of the unsegmented window:

* bounded frames (lead, lag, rolling means) see "halo" rows: copies of the
  last ``back`` rows before and the first ``fwd`` rows after each segment,
  taken from small per-segment edge tables (``row_number() <= n`` is planned as
  a partial top-n before the shuffle, so only edge candidates are exchanged);
  each frame then holds the same rows in the same order as before;
* unbounded running sums and row numbers add the totals of earlier segments
  (a prefix over one row per segment); use them for exact (integer) sums;
* the as-of fill (``joins.asof_join(segment=...)``) carries the last right row
  of earlier segments.

The order keys must be unique within a key (callers add a tie-break column),
and the segment must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.operators.joins import null_safe_join, sized_broadcast

SEG = "__seg"
HALO = "__halo"


def _ord(order: Sequence, desc: bool = False) -> list[Column]:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return [c.desc() for c in cols] if desc else cols


def _edge_rows(d: DataFrame, part: Sequence[str], order: Sequence, n: int, last: bool) -> DataFrame:
    """The first (or last) ``n`` rows of every (key, segment), numbered in key order."""
    w = Window.partitionBy(*part, SEG).orderBy(*_ord(order, desc=last))
    e = d.withColumn("__e", F.row_number().over(w)).filter(F.col("__e") <= n).drop("__e")
    # small table: at most n rows per segment
    return e.withColumn("__s", F.row_number().over(Window.partitionBy(*part).orderBy(SEG, *_ord(order))))


def with_halo(d: DataFrame, part: Sequence[str], order: Sequence, back: int, fwd: int) -> DataFrame:
    """Rows of ``d`` (which has the segment column) plus halo copies flagged ``HALO``.

    Segment s receives the last ``back`` rows of the segments before it and the
    first ``fwd`` rows of the segments after it (as many as exist).
    """
    out = d.withColumn(HALO, F.lit(False))
    cols = out.columns
    for n, last in ((back, True), (fwd, False)):
        if n <= 0:
            continue
        edges = _edge_rows(d, part, order, n, last)
        per_seg = edges.groupBy(*part, SEG).agg(F.count(F.lit(1)).alias("__c"))
        cw = Window.partitionBy(*part).orderBy(SEG)
        if last:   # targets: the n edge rows just before the segment
            upto = F.coalesce(F.sum("__c").over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            lo, hi = F.greatest(F.lit(1), upto - n + 1), upto
        else:      # targets: the n edge rows just after the segment
            upto = F.sum("__c").over(cw.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            lo, hi = upto + 1, upto + n
        targets = (per_seg.select(*part, F.col(SEG).alias("__to"), lo.alias("__lo"), hi.alias("__hi"))
                          .filter(F.col("__hi") >= F.col("__lo"))
                          .select(*part, "__to", F.explode(F.sequence("__lo", "__hi")).alias("__s")))
        halo = (null_safe_join(edges.drop(SEG), targets, [*part, "__s"])
                     .withColumnRenamed("__to", SEG).withColumn(HALO, F.lit(True)).select(*cols))
        out = out.unionByName(halo)
    return out


def halo_window(df: DataFrame, part: Sequence[str], order: Sequence, segment: Column | None,
                back: int, fwd: int, *stages: Callable[[WindowSpec], list[Column]],
                prepare: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """Add window columns with bounded frames, computed per (key, segment).

    Each stage ``f(w)`` builds aliased window expressions from the spec ``w``
    (partition + order set; add frames with ``w.rowsBetween``); later stages may
    read columns of earlier ones. The frames of all stages together must reach
    at most ``back`` rows back and ``fwd`` rows ahead (nested reaches add up).
    With ``segment=None`` the plain key partitioning is used.
    ``prepare(rows, kept)`` makes columns that follow from a row alone; it runs after the rows were dealt out, so they
    are not shuffled. It must leave the keys, the order columns and ``kept`` in place.
    """
    if segment is None:
        w = Window.partitionBy(*part).orderBy(*_ord(order))
        out = df if prepare is None else prepare(df.repartition(*part), [])
        for f in stages:
            out = out.select("*", *f(w))
        return out
    d = df.withColumn(SEG, segment)
    out = with_halo(d, part, order, back, fwd)
    w = Window.partitionBy(*part, SEG).orderBy(*_ord(order))
    if prepare is not None:
        out = prepare(out.repartition(*part, SEG), [SEG, HALO])
    for f in stages:
        out = out.select("*", *f(w))
    return out.filter(~F.col(HALO)).drop(HALO, SEG)


def running_totals(df: DataFrame, part: Sequence[str], order: Sequence, segment: Column | None,
                   sums: dict[str, Column], row_number: str | None = None) -> DataFrame:
    """Running sums with the default RANGE frame (ties summed together) and an
    optional row number, per key in ``order``; exact for integer sums.

    With a segment: per (key, segment) window + the totals of earlier segments
    (one row per segment, joined back on (key, segment)).
    """
    if segment is None:
        w = Window.partitionBy(*part).orderBy(*_ord(order))
        extra = [F.row_number().over(w).alias(row_number)] if row_number else []
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()], *extra)
    d = df.withColumn(SEG, segment)
    w = Window.partitionBy(*part, SEG).orderBy(*_ord(order))
    extra = [F.row_number().over(w).alias(row_number)] if row_number else []
    within = d.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()], *extra)
    tot = d.groupBy(*part, SEG).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
                                   F.count(F.lit(1)).alias("__t_rn"))
    pw = Window.partitionBy(*part).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums) + (["rn"] if row_number else [])
    pre = tot.select(*part, SEG, *[F.coalesce(F.sum(f"__t_{n}").over(pw), F.lit(0)).alias(f"__p_{n}") for n in names])
    j = null_safe_join(within, pre, [*part, SEG])
    out_cols = [c for c in within.columns if c not in sums and c != row_number and c != SEG]
    adds = [(F.col(n) + F.col(f"__p_{n}")).alias(n) for n in sums]
    if row_number:
        adds.append((F.col(row_number) + F.col("__p_rn")).cast("int").alias(row_number))
    return j.select(*out_cols, *adds)


def time_segment(c: str, unit: str | None) -> Column | None:
    """Segment = ``date_trunc(unit, c)`` (monotone in time); None keeps one partition per key."""
    return None if unit is None else F.date_trunc(unit, F.col(c))


UNITS = ("month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")
HOT_KEYS_BROADCAST = 100_000  # rows of the hot-key list that may be broadcast
MAX_ROWS_PER_TASK = 2_000_000


def choose_segment(df: DataFrame, keys: Sequence[str], time_col: str, max_rows: int = MAX_ROWS_PER_TASK,
                   units: Sequence[str] = UNITS) -> str | None:
    """Pick the segment unit for windows partitioned by ``keys``.

    Phase 1: rows per key (one aggregate, partial aggregation before the
    shuffle). If no key holds more than ``max_rows`` rows, returns None: plain
    windows, one shuffle. Phase 2 only looks at the hot keys (at most total rows /
    ``max_rows``): rows per (key, unit) from the coarsest unit on, until the
    largest group fits. Beyond the finest unit only rows at one instant are left
    together; their order comes from tie-break columns, which no time can split.
    Null keys and null times are groups like any other.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = per_key.filter(F.col("__n") > max_rows).select(*keys)
    if hot.limit(1).count() == 0:
        return None
    sub = null_safe_join(df.select(*keys, time_col), sized_broadcast(hot, HOT_KEYS_BROADCAST), list(keys), "left_semi")
    for u in units:
        largest = (sub.groupBy(*keys, F.date_trunc(u, F.col(time_col)).alias("__u")).agg(F.count(F.lit(1)).alias("__n"))
                   .agg(F.max("__n")).first()[0])
        if largest <= max_rows:
            return u
    return units[-1]


def resolve_segment(segment: str | None, df: DataFrame, keys: Sequence[str], time_col: str,
                    max_rows: int = MAX_ROWS_PER_TASK) -> str | None:
    """'auto' -> ``choose_segment``; a unit name or None is used as given."""
    return choose_segment(df, keys, time_col, max_rows) if segment == "auto" else segment
