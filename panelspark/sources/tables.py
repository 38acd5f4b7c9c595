"""Scans, folder readers and sinks.

Sources are Parquet by default (columnar: Catalyst prunes columns and pushes
filters into the scan). Header CSV is supported with an explicit schema, so no
second pass over the data is spent on schema inference.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(root: str, name: str, fmt: str = "parquet") -> str:
    return os.path.join(root, f"{name}.{fmt}")


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame:
    """Lazy scan of one table ``{root}/{name}.{fmt}``."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            raise ValueError("csv scans need an explicit schema (no inference pass)")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(table_path(root, name, fmt))


def scan_view(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
              schema: StructType | str | None = None, view: str | None = None) -> DataFrame:
    """Scan a table and register it as a temp view under ``view`` (default: its name)."""
    df = read_table(spark, root, name, fmt, schema)
    df.createOrReplaceTempView(view or name)
    return df


def list_tables(root: str, fmt: str = "parquet") -> list[str]:
    """Names (file stems) of the tables stored in ``root``. Only the listing runs on the driver."""
    suffix = "." + fmt
    return sorted(e[: -len(suffix)] for e in os.listdir(root) if e.endswith(suffix))


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet",
                schemas: dict[str, StructType | str] | None = None) -> dict[str, DataFrame]:
    """Every ``*.{fmt}`` table of a folder as a dict keyed by file stem (all lazy)."""
    schemas = schemas or {}
    return {n: read_table(spark, root, n, fmt, schemas.get(n)) for n in list_tables(root, fmt)}


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 partition_by: dict[str, list[str]] | None = None) -> list[str]:
    """S3: write a named set of tables to one folder, each replaced as a whole.

    Each table is written by the executors (no driver collect); ``overwrite``
    replaces the previous content of that table's folder.
    """
    partition_by = partition_by or {}
    written = []
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        if partition_by.get(name):
            w = w.partitionBy(*partition_by[name])
        path = table_path(root, name, fmt)
        w.save(path)
        written.append(path)
    return written
