"""Sampling and splitting.

Splits are a column on one DataFrame, derived from a hash of a row key and a
seed, so they are reproducible, need no driver round trip and survive task
retries (unlike ``randomSplit``, whose result depends on partition layout).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000


def hash_bucket(key: Sequence[str], seed: int = 42, buckets: int = BUCKETS) -> Column:
    """Bucket in [0, buckets) from the first 32 bits of md5(seed || '|' || key)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    h = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def split_column(key: Sequence[str], train_size: float = 0.6, with_validation: bool = True,
                 seed: int = 42, buckets: int = BUCKETS) -> Column:
    """X3: 'train' for the first ``train_size`` of buckets; the rest is 'test'
    or, with validation, halved into 'test' and 'val'."""
    if not 0 < train_size < 1:
        raise ValueError("train_size must be in (0, 1)")
    b = hash_bucket(key, seed, buckets)
    cut = int(round(train_size * buckets))
    if not with_validation:
        return F.when(b < cut, "train").otherwise("test")
    mid = cut + (buckets - cut) // 2
    return F.when(b < cut, "train").when(b < mid, "test").otherwise("val")


def fold_column(key: Sequence[str], n_folds: int = 5, seed: int = 42) -> Column:
    """Fold id in [0, n_folds) from the key hash (for ``CrossValidator(foldCol=)``)."""
    return (hash_bucket(key, seed + 1, BUCKETS) % n_folds).cast("int")


def sample_rows(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows whose key hash lies in the first ``fraction`` of the buckets: a filter
    without a shuffle that picks the same rows whatever the partition layout."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return df if fraction == 1.0 else df.filter(hash_bucket(key, seed + 2) < int(round(fraction * BUCKETS)))
