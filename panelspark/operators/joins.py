"""Join operators (J1-J8), including the backward as-of join.

Broadcasts are only forced behind a size check (``sized_broadcast``); beyond
the bound the plain join is returned and Catalyst/AQE picks a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 per column, plus the content of strings, binaries and nested values."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        col = F.col(f"`{f.name.replace('`', '``')}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.octet_length(F.to_json(F.struct(col)))
    return total


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the row count and the bytes are proven to be at most ``max_rows`` and ``max_bytes``.

    Otherwise the frame is returned unchanged and the planner chooses (AQE can
    still broadcast it at run time if its measured size is small).
    """
    rows, size = df.select(_row_bytes(df).alias("__bytes")).limit(max_rows + 1).agg(
        F.count("*"), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


HASH_SIDE_BYTES = 64 << 20  # of one partition of a hashed side


def sized_hash_side(df: DataFrame, rows: int, max_bytes: int = HASH_SIDE_BYTES) -> DataFrame:
    """Hash join hint for ``df`` of ``rows`` rows, so that the larger side needs no sort, when a shuffle partition of
    ``df`` holds at most ``max_bytes`` on average; otherwise the frame is returned unchanged.

    For keys that repeat little in ``df``: the rows of one key stay together.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if rows * 8 * (len(df.columns) + 4) <= max_bytes * partitions else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the left keys are kept."""
    r = right.select(*[F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__rk{i}"))
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__rk{i}" for i in range(len(keys))])


def lookup(df: DataFrame, dim: DataFrame, dim_key: str, value: str,
           roles: dict[str, str], max_dim_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Map id -> label for several id columns (``roles``: id column -> output name).

    A miss gives null. The dimension is broadcast once (size-checked) and joined
    per role.
    """
    d = sized_broadcast(dim.select(F.col(dim_key).alias("__k"), F.col(value).alias("__v")), max_dim_rows)
    out = df
    for src, dst in roles.items():
        out = (out.join(d, out[src] == d["__k"], "left")
                  .withColumnRenamed("__v", dst).drop("__k"))
    return out


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              strict: bool = True, how: str = "inner", right_order: Sequence[str] = (),
              prefix: str = "", segment: Callable[[Column], Column] | str | None = None) -> DataFrame:
    """For each left row the latest right row with the same ``by`` keys and
    ``right_on < left_on`` (``<=`` when ``strict`` is False).

    Built as union + forward fill, not a range join: both sides are tagged and
    unioned, then ``last(payload, ignorenulls)`` runs over one sort per ``by``
    partition. Cost is O(n log n) in the combined size, with no pair
    enumeration. Left rows sort before right rows at equal times for the strict
    form, after them for ``<=``. ``right_order`` breaks ties between right rows
    at the same time (the last one wins).

    Returns the left columns plus the right columns (except ``by``), the latter
    with ``prefix``. ``how`` is 'inner' (drop left rows without a match) or 'left'.

    ``segment`` (a monotone function of the time, e.g. its month; a unit name;
    or 'auto' to segment only when a key is too large for one task) splits each
    ``by`` partition: the fill runs per (by, segment) and rows whose match lies
    in an earlier segment take the last right row of the segments before
    theirs, from a table with one row per (by, segment). A hot key is then
    spread over many tasks; the result is unchanged.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if isinstance(segment, str):
        segment = _measured_segment(left, right, by, left_on, right_on) if segment == "auto" else \
            (lambda c, unit=segment: F.date_trunc(unit, c))
    rcols = [c for c in right.columns if c not in by]
    lcols = [c for c in left.columns if c not in by]
    lstruct = F.struct(*[F.col(c) for c in lcols])
    rstruct = F.struct(*[F.col(c) for c in rcols])
    ltype = left.select(lstruct.alias("s")).schema["s"].dataType
    rtype = right.select(rstruct.alias("s")).schema["s"].dataType
    lside, rside = (0, 1) if strict else (1, 0)
    tie_type = [right.select(c).schema[0].dataType for c in right_order]

    lpart = left.select(*by, F.col(left_on).alias("__t"), F.lit(lside).alias("__side"),
                        *[F.lit(None).cast(t).alias(f"__o{i}") for i, t in enumerate(tie_type)],
                        lstruct.alias("__l"), F.lit(None).cast(rtype).alias("__r"))
    rpart = right.select(*by, F.col(right_on).alias("__t"), F.lit(rside).alias("__side"),
                         *[F.col(c).alias(f"__o{i}") for i, c in enumerate(right_order)],
                         F.lit(None).cast(ltype).alias("__l"), rstruct.alias("__r"))
    u = lpart.unionByName(rpart)
    okeys = ["__t", "__side", *[f"__o{i}" for i in range(len(right_order))]]
    if segment is None:
        w = Window.partitionBy(*by).orderBy(*okeys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = (u.select(*by, "__side", "__l", F.last("__r", ignorenulls=True).over(w).alias("__m"))
                   .filter(F.col("__side") == lside))
    else:
        u = u.withColumn("__g", segment(F.col("__t")))
        w = Window.partitionBy(*by, "__g").orderBy(*okeys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = (u.select(*by, "__g", "__side", "__l", F.last("__r", ignorenulls=True).over(w).alias("__m"))
                   .filter(F.col("__side") == lside))
        # last right row of each (by, segment): one row per segment
        rights = u.filter(F.col("__side") == rside)
        tails = rights.groupBy(*by, "__g").agg(F.max_by("__r", F.struct(*okeys)).alias("__tail"))
        keys = within.select(*by, "__g").distinct()
        src = (keys.select(*by, "__g", F.lit(0).alias("__k"), F.lit(None).cast(rtype).alias("__tail"))
               .unionByName(tails.select(*by, "__g", F.lit(1).alias("__k"), "__tail")))
        cw = Window.partitionBy(*by).orderBy("__g", "__k").rowsBetween(Window.unboundedPreceding, -1)
        carry = (src.select(*by, "__g", "__k", F.last("__tail", ignorenulls=True).over(cw).alias("__carry"))
                    .filter(F.col("__k") == 0).drop("__k"))
        # a null key or time is a group of its own, as in the plain window
        filled = (null_safe_join(within, carry, [*by, "__g"], "left")
                        .select(*by, "__side", "__l", F.coalesce("__m", "__carry").alias("__m")))
    if how == "inner":
        filled = filled.filter(F.col("__m").isNotNull())
    return filled.select(*by, *[F.col(f"__l.{c}").alias(c) for c in lcols],
                         *[F.col(f"__m.{c}").alias(prefix + c) for c in rcols])


def _measured_segment(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str):
    """'auto' segment of an as-of join: the finer unit needed by either side (or none)."""
    from panelspark.operators.segmented import UNITS, choose_segment
    units = [choose_segment(left, by, left_on), choose_segment(right, by, right_on)]
    picked = [u for u in units if u is not None]
    if not picked:
        return None
    unit = max(picked, key=UNITS.index)
    return lambda c: F.date_trunc(unit, c)


def keep_members(df: DataFrame, column: str, values=None, table: DataFrame | None = None,
                 table_column: str | None = None) -> DataFrame:
    """Keep rows whose ``column`` is in a literal list OR in a table column.

    A literal list becomes ``isin`` (pushed into the scan); a table becomes a
    ``left_semi`` join (no duplicates, no columns added). Giving both is an error.
    """
    if values is not None and table is not None:
        raise ValueError("give values or table, not both")
    if values is not None:
        return df.filter(F.col(column).isin(list(values)))
    if table is None:
        return df
    t = table.select(F.col(table_column or column).alias("__m"))
    return df.join(t, df[column] == t["__m"], "left_semi")
