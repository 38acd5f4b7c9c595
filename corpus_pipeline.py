"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as Parquet in
the shared checkpoint folder and read again. Every stage works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, minhash, quality, secret_scan, tiling
from panelspark.llm.common import documents, ensure_checkpoint_dir, read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or that the learned decision list rejects go."""
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more (five-word shingles) the document with the least id stays."""
    return minhash.deduplicate(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text."""
    out = bpe.encode_documents(docs, TOKENIZER)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

# The learned list, similarity search and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result is the last stage's frame."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = os.path.join(folder, f"{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
