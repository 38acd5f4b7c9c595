"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, ensure_checkpoint_dir
from panelspark.sources.tables import read_table

__all__ = ["cut_lineage", "documents", "ensure_checkpoint_dir", "lower_ascii", "map_rows", "read_table",
           "step", "text_or_empty", "words_of", "worker_table"]

# Tables that a Python worker keeps between tasks, by the module that made them.
_TABLES: dict[str, Callable[[], None]] = {}

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())


def words_of(col: Column) -> Column:
    """Maximal runs of characters other than the six white-space characters."""
    return F.filter(F.split(col, SPACE_CLASS), lambda w: w != F.lit(""))


def worker_table(make: Callable) -> Callable:
    """``make`` with its latest result kept in the worker, until the worker runs a task of another module."""
    kept = lru_cache(maxsize=1)(make)
    _TABLES[make.__module__] = kept.cache_clear
    return kept


def _give_up_tables(of_others_than: str) -> None:
    for name in [n for n in _TABLES if n != of_others_than]:
        _TABLES[name]()


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under one name: batches stream through a task, nothing is gathered. Workers are used again by later
    operators, so a task first gives up what another module's tasks have kept there."""
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_up_tables(module)
        return fn(batches)

    return df.mapInArrow(run, schema)


def step(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; the shuffle files of its making go at once instead of with
    the driver's next garbage collection, so that a long job's disk use is that of its largest step."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        # a new frame: the setting is read when a query is planned
        return cut_lineage(df.select("*"))
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
