"""Registered query of the operator on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.llm import whitening
from panelspark.llm.common import read_table
from panelspark.registry import query


@query("op12_whitening")
def op12_whitening(spark, root):
    out = whitening.whiten(read_table(spark, root, "embeddings"))
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
