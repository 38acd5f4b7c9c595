"""Benchmark decontamination by greedy string tiling.

Tokens are words with A-Z lower-cased. Documents and benchmark items meet by shared seeds (``min_match`` consecutive
tokens; an item with fewer tokens is one seed). For each such pair the longest unmarked common stretch is marked again
and again, until none of ``min_match`` tokens is left; stretches are found by running Karp-Rabin hashes for window lengths
that halve from level to level. The share of an item's tokens that lie in tiles is its coverage; since tiles may
come in any order, reordered passages are caught.

Scale: documents stream through one map that keeps only those with a token window in a bit map of the benchmark's seeds (fixed
size, no window of the benchmark is missed); what is left is joined on seeds, so the benchmark may be of any
size. A pair is tiled in a row of its own, so items that many documents hold load no single task.

Edge cases: null, empty and white-space-only texts and items match nothing; repeated rows give repeated results; null
doc_ids and item_ids are carried along; an empty table gives an empty result; equal stretches are marked in the order
of their place in the item, then in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut_lineage, map_rows, text_or_empty
from panelspark.llm.minhash import _PLACES, _mix, word_hashes, words_of

MIN_MATCH = 5
MIN_COVERAGE = 0.5
MAP_BITS = 1 << 22
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Signed hash of every window of ``width`` word hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += words[j:j + n] * _PLACES[j]
    return _mix(total + np.uint64(width)).view(np.int64)


def tile(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, length), longest first."""
    tiles: list[tuple[int, int, int]] = []
    free_i, free_d = [True] * len(item), [True] * len(doc)

    def windows(seq: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(place, running hash) of the windows without a marked token."""
        top = pow(_BASE, s - 1, _MOD)
        h = run = 0
        for k, x in enumerate(seq):
            if not free[k]:
                h = run = 0
                continue
            if run == s:
                h = (h - seq[k - s] * top) % _MOD
                run -= 1
            h = (h * _BASE + x) % _MOD
            run += 1
            if run == s:
                yield k - s + 1, h

    s = min_match
    while 2 * s <= len(item):
        s *= 2
    while s >= min_match and len(item) >= min_match:
        places: dict[int, list[int]] = {}
        for p, h in windows(item, free_i, s):
            places.setdefault(h, []).append(p)
        heap: list[tuple[int, int, int]] = []
        if places:
            for d, h in windows(doc, free_d, s):
                for p in places.get(h, ()):
                    if p and d and free_i[p - 1] and free_d[d - 1] and item[p - 1] == doc[d - 1]:
                        continue  # part of the stretch that began before
                    if item[p:p + s] != doc[d:d + s]:
                        continue
                    n = s
                    while (p + n < len(item) and d + n < len(doc) and free_i[p + n] and free_d[d + n]
                           and item[p + n] == doc[d + n]):
                        n += 1
                    heap.append((-n, p, d))
        heapq.heapify(heap)
        while heap:
            n, p, d = heapq.heappop(heap)
            n = -n
            runs, start = [], None
            for k in range(n + 1):
                if k < n and free_i[p + k] and free_d[d + k]:
                    start = k if start is None else start
                elif start is not None:
                    runs.append((start, k - start))
                    start = None
            if runs == [(0, n)]:
                tiles.append((p, d, n))
                free_i[p:p + n] = [False] * n
                free_d[d:d + n] = [False] * n
            else:  # what is still free goes back, shorter stretches are found at a lower level
                for start, m in runs:
                    if m >= s:
                        heapq.heappush(heap, (-m, p + start, d + start))
        s //= 2
    return tiles


def _ids(words: list[bytes], known: dict[bytes, int]) -> list[int]:
    return [known.setdefault(w, len(known) + 1) for w in words]


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    """iid, seed, n_seed (how often the item has it), width, one row per item and seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            iid, seed, width = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(t)
                if len(words):
                    w = min(min_match, len(words))
                    found = window_hashes(words, w)
                    iid += [i] * len(found)
                    width += [w] * len(found)
                    seed += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(iid, pa.int64()), pa.array(seed, pa.int64()), pa.array(width, pa.int32())],
                                             names=["iid", "seed", "width"])

    return (map_rows(items.select("iid", "item_text"), run, "iid long, seed long, width int")
            .groupBy("iid", "seed", "width").agg(F.count("*").alias("n_seed")))


def matches(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, n_item, n_covered, coverage, tiles: the pairs whose coverage reaches ``min_coverage``."""
    items = cut_lineage(benchmark.select(F.col("item_id"), F.col("text").alias("item_text"))
                        .where("item_text is not null").withColumn("iid", F.monotonically_increasing_id()))
    seeds = cut_lineage(_seeds(items, min_match))
    place = F.pmod("seed", F.lit(MAP_BITS))
    parts = seeds.groupBy(F.floor(place / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {MAP_BITS}) % 64 as int))")).alias("bits")).collect()  # MAP_BITS / 64 rows at most
    widths = [r["width"] for r in seeds.select("width").distinct().collect()]  # min_match values at most
    words = np.zeros(MAP_BITS // 64, np.int64)
    for r in parts:
        words[r["at"]] = r["bits"]
    spread = docs.sparkSession.sparkContext.broadcast(words.astype("<i8").tobytes())
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(spread.value, np.uint8)
        for batch in batches:
            rows, found = [], []
            for k, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                h = word_hashes(t)
                hit = []
                for w in widths:
                    s = window_hashes(h, w)
                    at = s & (MAP_BITS - 1)
                    hit.append(s[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
                got = np.unique(np.concatenate(hit)) if hit else ()
                if len(got):
                    rows.append(k)
                    found.append(got.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
                                              pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "seeds"])

    kind = src.schema["doc_id"].dataType.simpleString()
    held = cut_lineage(map_rows(src, run, f"doc_id {kind}, text string, seeds array<long>").withColumn("rid", F.monotonically_increasing_id()))
    # A seed covers min_match tokens at most, which bounds the coverage before any text is compared.
    sizes = seeds.groupBy("iid").agg((F.sum("n_seed") + F.max("width") - 1).alias("n_item"))
    pairs = (held.select("rid", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("rid", "iid")
             .agg(F.sum(F.col("n_seed") * F.col("width")).alias("most")).join(sizes, "iid")
             .where(F.col("most") >= F.col("n_item") * F.lit(min_coverage)).select("rid", "iid"))
    rows = (pairs.join(held.select("rid", "doc_id", "text"), "rid").join(items, "iid").select("doc_id", "text", "item_id", "item_text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, covered, tiles = [], [], []
            for t, i in zip(batch.column(1), batch.column(3)):
                known: dict[bytes, int] = {}
                item, doc = _ids(words_of(i.as_py()), known), _ids(words_of(t.as_py()), known)
                got = tile(item, doc, min(min_match, max(1, len(item))))
                size.append(len(item))
                covered.append(sum(n for _, _, n in got))
                tiles.append([{"item_start": p, "doc_start": d, "length": n} for p, d, n in got])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(covered, pa.int64()),
                 pa.array(tiles, pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))],
                names=["doc_id", "text", "item_id", "n_item", "n_covered", "tiles"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    out = map_rows(rows, compare, f"doc_id {kind}, text string, item_id {item_kind}, n_item long, n_covered long, "
                                  "tiles array<struct<item_start:int,doc_start:int,length:int>>")
    return (out.withColumn("coverage", F.col("n_covered") / F.col("n_item")).where(F.col("coverage") >= min_coverage)
            .select("doc_id", F.xxhash64("text").alias("text_hash"), "item_id", "n_item", "n_covered", "coverage", "tiles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns as they were."""
    bad = matches(docs, benchmark, **options).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64(text_or_empty("text")) == F.col("__leak_hash")), "left_anti")
