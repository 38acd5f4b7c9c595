"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the encoding ends in one token only. An automaton over the vocabulary yields
all tokens that are suffixes of a prefix; the one whose pair with the last token of the shorter prefix is compatible (no
merge crosses the seam before the merges that build the two tokens) is the prefix's last token. Following the
stored last tokens back from the end of the word gives the ids that repeated merging would give.

Scale: rows are independent, so the job is one map without a shuffle; whole texts stream through
in Arrow batches and results leave in bounded batches. The vocabulary (fixed size) travels as a broadcast variable, words
seen before come from a cache with a bounded number of entries.

Edge cases: null text is empty; empty and white-space-only texts have no ids and decode to ""; special-token strings
in a text are those tokens, as the tokenizers library takes them; null and repeated doc_ids
pass through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows, worker_table

CACHE_WORDS = 300_000  # per worker, in each of two generations
OUT_BYTES = 16 << 20  # of ids and text in a result batch
_END = "\ue000"  # stands for the end-of-word mark; no byte maps to it
_NEVER = 1 << 62


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the
    others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PrefixTokenizer:
    """Encoder and decoder for a tokenizer file of a byte-level BPE with an end-of-word mark."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special_pattern = (re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
                                if self.special else None)
        self.rank: dict[int, int] = {}
        spelt: dict[int, str] = {}
        # (token, rank of the merge that uses it up) along a token's right and left edge, from the single character up
        self.right: dict[int, list[list[int]]] = {}
        self.left: dict[int, list[list[int]]] = {}
        for c in byte_characters():
            for s, text in ((c, c), (c + self.suffix, c + _END)) if self.suffix else ((c, c),):
                if s in vocab:
                    i = vocab[s]
                    spelt[i], self.right[i], self.left[i] = text, [[i, _NEVER]], [[i, _NEVER]]
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[a], vocab[b]
            i = vocab[a + b]
            self.rank.setdefault(x << 32 | y, r)
            if i not in spelt:
                spelt[i] = spelt[x] + spelt[y]
                self.right[i] = [*self.right[y][:-1], [y, r], [i, _NEVER]]
                self.left[i] = [*self.left[x][:-1], [x, r], [i, _NEVER]]
        self.automaton = ahocorasick.Automaton()
        for i, s in spelt.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.byte_char = byte_characters()
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        self.fits: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        # The file's split pattern; for ASCII texts an equal one of the faster standard module.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b together ends in exactly these two tokens."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(self.right[a], self.left[b])
        return known

    def _compatible(self, right: list[list[int]], left: list[list[int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            r = self.rank.get(x << 32 | y)
            # of equal ranks the leftmost pair merges first: x's own merge lies left of the seam, y's right of it
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until == y_until == _NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def word_ids(self, word: str) -> list[int]:
        """Ids of one piece of text (no white space inside needed)."""
        text = word if word.isascii() and word.isprintable() and " " not in word else "".join([self.byte_char[b] for b in word.encode()])
        n = len(text) if self.suffix else -1  # the word without its end mark ends in no token
        if self.suffix:
            text += _END
        last = [-1] * (len(text) + 1)
        size = last[:]
        fits = self.fits
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0 and end != n:
                start = end - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    ok = fits.get(before << 32 | token)
                    if not (self.compatible(before, token) if ok is None else ok):
                        continue
                last[end], size[end] = token, length
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _word(self, word: str) -> tuple[bytes, str]:
        got = self.old.get(word)
        if got is None:
            ids = self.word_ids(word)
            got = b"".join([self.packed[i] for i in ids]), " ".join([self.token[i] for i in ids])
        if len(word) <= 64:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    @staticmethod
    def normalize(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # each character on its own: a final sigma is lower-cased like any other
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        ids: list[bytes] = []
        said: list[str] = []
        young, word = self.young, self._word
        for part in parts:
            if part in self.special:
                ids.append(self.packed[self.special[part]])
                said.append(part)
                continue
            part = self.normalize(part)
            for w in (self.ascii_pieces if part.isascii() else self.pieces).findall(part):
                got = young.get(w)
                if got is None:
                    got = word(w)
                    young = self.young
                ids.append(got[0])
                said.append(got[1])
        return b"".join(ids), " ".join(said)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces; unknown ids are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@worker_table
def _tokenizer(spec: str) -> PrefixTokenizer:
    return PrefixTokenizer(spec)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids (binary, little-endian unsigned 32-bit integers), decoded (string), one row per row.

    ``path``: tokenizer file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            names, start, size, ids, said = batch.column(0), 0, 0, [], []
            for k in range(batch.num_rows):
                a, b = tokenizer.encode(batch.column(1)[k].as_py() or "")
                ids.append(a)
                said.append(b)
                size += len(a) + len(b)
                if size > OUT_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([names[start:k + 1], pa.array(ids, pa.binary()), pa.array(said, pa.string())],
                                                     names=[id_col, "ids", "decoded"])
                    start, size, ids, said = k + 1, 0, [], []

    return map_rows(src, run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, ids binary, decoded string")
