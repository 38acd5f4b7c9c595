"""Registered queries of the operators that read each text or page by itself: extraction, encoding, toxicity."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from panelspark.llm import bpe, byte_bpe, html_render, toxicity
from panelspark.llm.common import documents, read_table
from panelspark.registry import query


@query("op1_html_text")
def op1_html_text(spark, root):
    out = html_render.extract_pages(read_table(spark, root, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


@query("op2_bpe")
def op2_bpe(spark, root):
    out = bpe.encode_documents(documents(spark, root), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_toxicity")
def op5_toxicity(spark, root):
    docs = documents(spark, root)
    model = toxicity.fit(docs, read_table(spark, root, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op13_byte_bpe")
def op13_byte_bpe(spark, root):
    out = byte_bpe.encode_documents(documents(spark, root), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
