"""Registered queries of the operators that compare documents with each other or with the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.llm import minhash, suffix_dedup, tiling
from panelspark.llm.common import documents, read_table
from panelspark.registry import query


@query("op10_minhash")
def op10_minhash(spark, root):
    return minhash.near_duplicates(documents(spark, root), width=2, percent=80)


@query("op9_decontamination")
def op9_decontamination(spark, root):
    return tiling.matches(documents(spark, root), read_table(spark, root, "benchmark")).drop("text_hash")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, root):
    out = suffix_dedup.remove_repeats(documents(spark, root))
    return out.select("doc_id", "n_bytes", suffix_dedup.removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
