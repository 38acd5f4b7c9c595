"""Conversation prefix trie: a dictionary of prefixes as brute force, blocks and shards of many sizes, edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelspark.llm import prefix_trie, queries  # noqa: F401
from panelspark.registry import ORACLE, QUERIES
from tests.oracle_harness import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: t[:2] + (hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest(),)
    own = {c: [t[2:] for t in sorted(v, key=key)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df, **options):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.trie(df, **options).select(*cols).collect()), key=str)


def sample(rng, convs, longest, words):
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("width, shard_rows", [(64, 40_000), (64, 7), (2, 5), (1, 4), (3, 1000)])
def test_against_brute_force(spark, width, shard_rows):
    rng = random.Random(width * 100 + shard_rows)
    rows = sample(rng, [*range(0, 60), *range(100, 130), *range(205, 215), -3, -200], 7, ["a", "bb", "", None, "é語🙂"])
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(9)]  # copies that fill several shards
    rows += [(2001, t % 5, "user", "x") for t in range(40)] + [(2002, None, None, None), (2002, None, "user", "q"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert ours(df, width=width, shard_rows=shard_rows) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(100, t, "user", f"w{t % 3}") for t in range(500)] + [(c, t, "user", f"w{t % 3}") for c in (200, 300) for t in range(499 - c // 100)]
    assert ours(spark.createDataFrame(rows, SCHEMA), width=16, shard_rows=10) == brute(rows)


def test_all_conversations_without_turns(spark):
    lost = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 1]  # no first conversation of the hundred, so the only turn goes
    rows = [(c, 0, "user", "x") for c in lost]
    got = ours(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and len(got) == 1 and got[0][:7] == (min(lost), 0, None, len(lost), 0, 1, 0)


def test_empty_table_and_clashing_columns(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "x"), (0, 0, "user", "y"), (0, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 5, "n", 7) for r in rows], SCHEMA + ", pos long, id string, depth int")
    assert ours(df) == brute(rows)


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_and_sql(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, root)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == brute(rows)
    r = compare(spark, "op11_prefix_trie", QUERIES["op11_prefix_trie"], ORACLE["op11_prefix_trie"], root)
    assert r["cols_match"] and r["types_match"] and r["status"] == "exact", r
