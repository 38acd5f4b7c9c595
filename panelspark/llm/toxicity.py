"""Toxicity by compression distance: one zstandard dictionary of ordinary and one of toxic text.

A window (``window_words`` consecutive words, letters only, lower-cased) is compressed with either dictionary; the
bytes that the toxic dictionary saves are its evidence. The largest savings among a text's distinct windows are
calibrated to a probability by logistic regression.

Training takes a bounded sample of labelled rows (``sample_rows`` of each class, ``sample_chars`` of text, chosen by
hash of the id). The ordinary dictionary is trained on ordinary texts, the toxic one on windows of toxic texts, less
those that ordinary texts share (toxic texts are mostly ordinary prose) and those that do not recur.

Scale: scoring is one map without a shuffle; the model (two dictionaries under 200 kB and a few numbers) travels with the
tasks; windows seen before come from a cache with a bounded number of entries.

Edge cases: null and empty texts, and texts without letters, have no evidence and get the score of that; null and repeated
doc_ids are scored row by row; no labelled rows of one class: every score is the prior (0.5 without any label), predicted
accordingly; an empty table gives an empty result; ties in savings do not matter.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows

SAMPLE_ROWS = 4_000  # of each class
SAMPLE_CHARS = 8_000_000  # of each class
CACHE_WINDOWS = 400_000
TOP = 3  # savings that count in a text
LEVEL = 6
# Follows each window, and ends both dictionaries: the coder never stores a short window raw, and it finds matches up
# to the window's last byte.
CARRIER = b"| end of the window, known to either dictionary |"
_LETTERS = re.compile(r"[^\W\d_]+")


def windows(text: str | None, width: int) -> set[str]:
    """Distinct windows of a text; a shorter text is one window."""
    words = _LETTERS.findall((text or "").lower())
    if width == 1:
        return set(words)
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


class Coder:
    """Compressed length of a window given a dictionary's content."""

    def __init__(self, content: bytes):
        d = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d.precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def __call__(self, window: str) -> int:
        return len(self.compress(b" " + window.encode() + b" " + CARRIER))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # intercept, then one for each of the TOP savings
    width: int = 1


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.coders = (Coder(model.ordinary), Coder(model.toxic)) if model.toxic else None
        self.saved: dict[str, int] = {}

    def saving(self, window: str) -> int:
        got = self.saved.get(window)
        if got is None:
            got = self.coders[0](window) - self.coders[1](window)
            if len(window) <= 64:
                if len(self.saved) >= CACHE_WINDOWS:
                    self.saved.clear()
                self.saved[window] = got
        return got

    def evidence(self, text: str | None) -> list[int]:
        if self.coders is None:
            return [0] * TOP
        return self.of_windows(windows(text, self.model.width))

    def of_windows(self, found: set[str]) -> list[int]:
        known, fresh = self.saved, self.saving
        values = [known[w] if w in known else fresh(w) for w in found]
        best = heapq.nlargest(TOP, values) if len(values) > TOP else sorted(values, reverse=True)
        return [max(0, b) for b in best] + [0] * (TOP - len(best))

    def score(self, text: str | None) -> float:
        w = self.model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], self.evidence(text)))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return w


def train(ordinary: list[str], toxic: list[str], *, width: int = 1, ordinary_bytes: int = 110_000, toxic_bytes: int = 1_024,
          least_chars: int = 4, least_share: float = 0.02, contrast: float = 0.02) -> Model:
    """Model from texts of both classes. The toxic dictionary's samples are the windows of toxic texts that recur in
    ``least_share`` of them (3 at least) and whose rate in ordinary texts is under ``contrast`` times that in toxic ones."""
    if not ordinary or not toxic:
        prior = (len(toxic) + 1) / (len(ordinary) + len(toxic) + 2)
        return Model(b"", b"", (math.log(prior / (1 - prior)), *[0.0] * TOP), width)
    good, bad = [windows(t, width) for t in ordinary], [windows(t, width) for t in toxic]

    def dictionary(samples: list[bytes], counts: Counter, size: int) -> bytes:
        """Half trained by zstandard; the rest holds the most frequent windows that the trained half cut or left out."""
        try:
            trained = zstandard.train_dictionary(max(256, size // 2), samples, k=16, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on
            trained = b""
        rest, left = [], size - len(trained)
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if (b := f" {w} ".encode()) not in trained:
                if left < len(b):
                    break
                rest.append(b)
                left -= len(b)
        return b"".join(rest[::-1]) + trained  # the end of a dictionary is cheapest to refer to

    n_good, n_bad = Counter(w for d in good for w in d), Counter(w for d in bad for w in d)
    base = dictionary([(" " + " ".join(sorted(d)) + " ").encode() for d in good if d], n_good, ordinary_bytes)
    own = Counter({w: n for w, n in n_bad.items() if n >= max(3, least_share * len(bad)) and len(w) >= least_chars
                   and n_good[w] * len(bad) < contrast * n * len(good)})
    content = dictionary([f" {w} ".encode().center(16) for w, n in sorted(own.items()) for _ in range(n)], own, toxic_bytes)
    model = Model(base, content, (0.0,) * (TOP + 1), width)
    scorer = Scorer(model)
    x = np.array([scorer.of_windows(d) for d in good + bad], float)
    weights = _logistic(x, np.array([0] * len(good) + [1] * len(bad), float))
    return Model(base, content, tuple(map(float, weights)), width)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, **options) -> Model:
    """Model from labelled rows that are not held out. Rows with equal text and label count once."""
    lab = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic")))
    # few ids are chosen before any text is read
    chosen = (lab.orderBy(F.xxhash64("_id")).where("_toxic").limit(sample_rows)
              .unionByName(lab.where("not _toxic").orderBy(F.xxhash64("_id")).limit(sample_rows)))
    rows = (docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
            .where(F.col("text").isNotNull()).select("_toxic", "_id", "text").distinct())
    texts: dict[bool, list[str]] = {False: [], True: []}
    used = {False: 0, True: 0}
    for r in rows.orderBy(F.xxhash64("_id"), "text").toLocalIterator():
        if used[r["_toxic"]] + len(r["text"]) <= sample_chars:
            used[r["_toxic"]] += len(r["text"])
            texts[r["_toxic"]].append(r["text"])
    return train(list(dict.fromkeys(texts[False])), list(dict.fromkeys(texts[True])), **options)


@lru_cache(maxsize=2)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 if the score reaches ``threshold``), one row per row."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            values = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    out = map_rows(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
