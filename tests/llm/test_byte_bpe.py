"""Byte-level BPE: the tiktoken library on whole texts, chunks of many sizes, edge cases."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from panelspark.llm import byte_bpe, queries  # noqa: F401
from panelspark.registry import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    with open(FILE, "rb") as f:
        return byte_bpe.ByteTokenizer.of(f.read())


def ids_of(tokenizer, text):
    return memoryview(tokenizer.encode(byte_bpe.pieces(text))[0]).cast("i").tolist()


def strange(rng, n):
    """Text in which pre-token boundaries are hard to find."""
    parts = ["a", "don't", "'re", "'r", "'", "''ll", " ", "  ", "\n", " \n", "\r\n", " ", "　", "\u0085", "\x1c", "x" * 40, "1", "23456", "é", "ß",
             "語", "🙂", "!", "...", "?!\"", "́", "½", "<|endoftext|>", "Ⅷ", " s", "'S", "z" * 9]
    return "".join(rng.choice(parts) for _ in range(n))


def test_pieces_of_every_character(library, tokenizer):
    # each character between letters and before a space, against the library's split
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bad = []
    for at in range(0, len(chars), 4096):
        text = "".join(f"a{c}1 {c} \n" for c in chars[at:at + 4096])
        # the ids tell the pieces apart wherever a boundary matters
        if ids_of(tokenizer, text) != library.encode_ordinary(text):
            bad.append(at)
    assert not bad


def test_ids_equal_the_library(library, tokenizer):
    rng = random.Random(5)
    texts = ["", " ", "\n\n", "a" * 3000, "ab" * 700, " " * 500, "'" * 99, "é" * 333, "🙂🙃" * 50] + [strange(rng, rng.randrange(1, 80)) for _ in range(3000)]
    for t in texts:
        assert ids_of(tokenizer, t) == library.encode_ordinary(t), t
        ids, said = tokenizer.encode(byte_bpe.pieces(t))
        assert said == t.encode()


def test_sure_boundaries_hold_in_longer_texts():
    rng = random.Random(6)
    for _ in range(2000):
        text = strange(rng, 30)
        cut = rng.randrange(len(text) + 1)
        sure = byte_bpe.boundaries(text[:cut], False)
        assert set(sure) <= set(byte_bpe.boundaries(text, True))
        assert list(byte_bpe.boundaries(text, True))[-1] == len(text)


@pytest.mark.parametrize("chunk, overlap", [(5, 5), (16, 3), (64, 16), (1000, 100)])
def test_chunks_give_whole_text_ids(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = [strange(rng, rng.randrange(0, 60)) for _ in range(60)]
    texts += ["", None, "a" * 500, "x" * 90 + " " + "y" * 300, " " * 200, "\n" * 77 + "b", "'" * 120, "12" * 80, "one two " * 60, texts[3], texts[3]]
    rows = [(i % 55 if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = byte_bpe.encode_documents(df, FILE, chunk=chunk, overlap=overlap).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"]), bytes(r["decoded"])) for r in out)
    assert got == sorted((i is not None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)


def test_decode(spark, library):
    texts = ["hello  world", "", "🙂é"]
    df = spark.createDataFrame([(i, library.encode_ordinary(t)) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(df, FILE).collect()}
    assert got == {0: texts[0], 1: "", 2: texts[2], 9: None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_documents(df, FILE).collect() == []


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
