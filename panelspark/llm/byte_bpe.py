"""Byte-level BPE encoding of overlapping chunks, and decoding.

A long text is cut into windows of ``chunk`` characters that run ``overlap`` characters into the next one. Windows are split
into pre-tokens in parallel. The split pattern looks only at what follows a position and covers every character, so two
windows that share one boundary agree from there on: the first boundary that both have in the overlap is where the later
window takes over. Windows without a common boundary (one run of letters longer than the overlap) are joined and split anew until
all meet. Then every window's pieces between its two meeting points are merged by rank, and the ids of a text's windows are put in order.
Texts up to ``chunk`` characters are one window and need no meeting. Decoding concatenates the raw bytes of the ids.

Scale: short texts are one map without a shuffle. Windows of long texts are dealt out by text and number, so one very
long text is split and encoded by many tasks; only a text's ids come together again, in its own row. Pieces seen
before come from a cache with a bounded number of entries; a piece of n bytes is merged in n log n steps.

Edge cases: null text is empty; an empty text has no ids and decodes to no bytes; white space is kept; strings that look like special tokens
are ordinary text; null and repeated doc_ids and repeated rows pass through row by row; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows, step, text_or_empty, worker_table

CHUNK, OVERLAP = 1 << 15, 1 << 10  # characters
CACHE_PIECES = 300_000  # per worker, in each of two generations
OUT_BYTES = 16 << 20  # of ids and bytes in a result batch
LOOK = 3  # characters from a match's start that decide between the alternatives
# The split pattern of the rank files, with white space spelt out; for ASCII texts an equal one of the faster standard module.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0d A-Za-z0-9]+|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+")


def pieces(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _PIECES).findall(text)


def boundaries(text: str, whole: bool) -> np.ndarray:
    """Sure boundaries of a window: 0 and the ends of matches that no text after the window could change.
    ``whole``: the text ends with the window."""
    ends = np.cumsum([0, *map(len, pieces(text))])
    if whole:
        return ends
    starts, n = ends[:-1], len(text)
    unsure = np.flatnonzero((ends[1:] >= n) | (starts + LOOK > n))
    return ends[: unsure[0] + 1] if len(unsure) else ends


class ByteTokenizer:
    """Encoder and decoder over the ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, spec: bytes) -> ByteTokenizer:
        """From a file with a base64 byte string and its rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all neighbouring pairs, the one of least rank (the leftmost of equals) is merged until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # a part starts at i and ends at after[i]
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if after[i] != mid or mid >= n or after[mid] != end:
                continue  # one of the two parts has been merged since
            after[i], after[mid] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i:after[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, after[end]))
            if i and (r := ranks.get(piece[before[i]:end])) is not None:
                heapq.heappush(heap, (r, before[i], i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        got = self.old.get(piece)
        if got is None:
            ids = self.merge(piece.encode())
            got = np.array(ids, "<i4").tobytes(), self.decode(ids)
        if len(piece) <= 64:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = got
        return got

    def encode(self, parts: list[str]) -> tuple[bytes, bytes]:
        """Ids (little-endian 32-bit integers) of pre-tokens, and the bytes that these ids stand for."""
        young, ids, said = self.young, [], []
        for p in parts:
            got = young.get(p)
            if got is None:
                got = self._piece(p)
                young = self.young
            ids.append(got[0])
            said.append(got[1])
        return b"".join(ids), b"".join(said)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


@worker_table
def _tokenizer(spec: bytes) -> ByteTokenizer:
    return ByteTokenizer.of(spec)


def _lists(values: list[bytes]) -> pa.ListArray:
    """int lists from packed ids."""
    ends = np.cumsum([0, *[len(v) >> 2 for v in values]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), "<i4")))


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Windows (row, id, k, start, text, last) of texts; ``row`` names a row of ``docs`` and is settled by the caller's write."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, text = uuid.uuid4().hex, batch.column(1)[r].as_py()
                n, one = len(text), batch.column(0).slice(r, 1)
                for k, start in enumerate(range(0, n, chunk)):
                    last = start + chunk >= n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), one, pa.array([k], pa.int32()), pa.array([start], pa.int64()),
                         pa.array([text[start:start + chunk + (0 if last else overlap)]]), pa.array([last])],
                        names=["row", "id", "k", "start", "text", "last"])

    return map_rows(docs, run, f"row string, id {docs.schema['id'].dataType.simpleString()}, k int, start long, text string, last boolean")


def _split(windows: DataFrame, overlap: int) -> DataFrame:
    """Windows with ``head`` and ``tail``: sure boundaries within ``overlap`` characters of either end, as positions in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                start, text, last = (batch.column(k)[r].as_py() for k in (3, 4, 5))
                b = boundaries(text, last)
                head = b[b <= overlap] + start
                tail = b[b >= len(text) - overlap] + start if not last else b[:0]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(r, 1) for k in range(6)), pa.array([head.tolist()], pa.list_(pa.int64())),
                                                  pa.array([tail.tolist()], pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema)
    return map_rows(windows, run, f"{fields}, head array<long>, tail array<long>")


def _met(split: DataFrame) -> DataFrame:
    """Windows with ``until``: where the next window takes over (null: nowhere; the last window ends with the text)."""
    order = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    return split.withColumn("until", F.when(~F.col("last"), common))


def _joined(met: DataFrame) -> DataFrame:
    """Windows that do not meet become one with the next."""
    order = Window.partitionBy("row").orderBy("k")
    open_end = F.col("until").isNull() & ~F.col("last")
    part = F.when(open_end, F.expr("substring(text, 1, cast(lead(start) over (partition by row order by k) - start as int))")).otherwise(F.col("text"))
    runs = met.select("row", "id", "k", "start", "last", part.alias("part"), F.lag(open_end).over(order).alias("_open"))
    runs = runs.withColumn("g", F.sum(F.when(F.col("_open"), 0).otherwise(1)).over(order))
    return runs.groupBy("row", "g").agg(
        F.first("id").alias("id"), F.min("k").alias("k"), F.min("start").alias("start"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"),
        F.max("last").alias("last")).select("row", "id", "k", "start", "text", "last")


def _encode_windows(met: DataFrame, spec) -> DataFrame:
    """(row, id, k, ids, said) of each window's pieces between its two meeting points."""
    order = Window.partitionBy("row").orderBy("k")
    src = met.select("row", "id", "k", "start", "text", F.coalesce(F.lag("until").over(order), F.lit(0)).alias("begin"), "until")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            for r in range(batch.num_rows):
                start, text, begin, until = (batch.column(k)[r].as_py() for k in range(3, 7))
                got = pieces(text[begin - start:])
                if until is not None:  # what follows is read, so that the last piece ends where it does in the whole text
                    got = got[:int(np.searchsorted(np.cumsum([len(p) for p in got]), until - begin, "right"))]
                ids, said = tokenizer.encode(got)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(r, 1) for k in range(3)), _lists([ids]), pa.array([said], pa.binary())],
                                                 names=["row", "id", "k", "ids", "said"])

    return map_rows(src, run, f"row string, id {met.schema['id'].dataType.simpleString()}, k int, ids array<int>, said binary")


def _encode_short(src: DataFrame, spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            names, start, size, ids, said = batch.column(0), 0, 0, [], []
            for k in range(batch.num_rows):
                a, b = tokenizer.encode(pieces(batch.column(1)[k].as_py()))
                ids.append(a)
                said.append(b)
                size += len(a) + len(b)
                if size > OUT_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([names[start:k + 1], _lists(ids), pa.array(said, pa.binary())], names=["id", "ids", "decoded"])
                    start, size, ids, said = k + 1, 0, [], []

    return map_rows(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")


def _encode_long(src: DataFrame, spec, chunk: int, overlap: int) -> DataFrame:
    windows = step(_cut(src, chunk, overlap))
    parts = max(1, min(windows.count(), windows.sparkSession.sparkContext.defaultParallelism * 4))
    met = step(_met(_split(windows.repartition(parts, "row", "k"), overlap)))
    while not met.where("until is null and not last").isEmpty():
        met = step(_met(_split(_joined(met), overlap)))
    coded = _encode_windows(met, spec)
    out = coded.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "ids", "said"))).alias("parts"))
    joined = F.aggregate(F.col("parts"), F.lit("").cast("binary"), lambda done, x: F.concat(done, x["said"]))
    return out.select("id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), joined.alias("decoded"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = CHUNK,
                     overlap: int = OVERLAP) -> DataFrame:
    """``id_col``, ids (array of int), decoded (binary: the bytes that the ids stand for), one row per row.

    ``path``: rank file, read on the driver."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap is at least one character and at most a chunk")
    with open(path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    short, long = src.where(F.length("text") <= chunk), src.where(F.length("text") > chunk)
    return (_encode_short(short, spec).unionByName(_encode_long(long, spec, chunk, overlap))
            .select(F.col("id").alias(id_col), "ids", "decoded"))


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text: the bytes of the ids as UTF-8, malformed ones replaced. Null ids give null; an unknown id is an error."""
    with open(path, "rb") as f:
        spec = coded.sparkSession.sparkContext.broadcast(f.read())
    src = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(1)[r].as_py()
                text = None if ids is None else tokenizer.decode(ids).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([text], pa.string())], names=["id", "text"])

    return map_rows(src, run, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
