"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import minhash, queries, tiling  # noqa: F401
from panelspark.llm.components import connected_components
from panelspark.registry import QUERIES

ROOT = "/root/testdata/sf0.001"


def brute_components(rows, width, percent):
    """rows: (doc_id, text). component by all pairs."""
    sets = []
    for d, t in rows:
        w = minhash.words_of(t)
        sets.append(set(zip(*[w[j:] for j in range(width)])) if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def check(spark, rows, width=2, percent=80, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width=width, percent=percent).collect()), key=repr)
    assert got == sorted(brute_components([r[:2] for r in rows], width, percent), key=repr)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        c = minhash.sketch(s)
        assert len(c) == minhash.SIZE and (c != np.iinfo(np.uint64).max).all()
        # one element at a time gives the same coordinates as rounds in bulk
        slow = np.full(minhash.SIZE, np.iinfo(np.uint64).max, np.uint64)
        if n <= 40:
            for i in range(2 * minhash.SIZE):
                for x in s:
                    g = int(minhash._mix(np.array([x ^ minhash._SEEDS[i]]))[0])
                    b = g % minhash.SIZE if i < minhash.SIZE else i - minhash.SIZE
                    slow[b] = min(slow[b], np.uint64((i << 56) | (g >> 8)))
                if (slow != np.iinfo(np.uint64).max).all():
                    break
            assert (slow == c).all()
    errors = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(60):
            both = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
            rest = [rng.integers(0, 2**63, (1000 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
            a, b = (minhash.sketch(np.concatenate([both, r])) for r in rest)
            errors.append((a == b).mean() - share)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_real_texts(spark, width):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, width)


def test_crowded_buckets_keep_their_members(spark):
    nodes = spark.createDataFrame([(bytes([k]), 9, [5, 1000 + k, 2000 + k % 2]) for k in range(140)], "node binary, n long, buckets array<long>")
    m = minhash._memberships(nodes).collect()
    assert {r["node"] for r in m if r["bucket"] == 5 and r["c"] == 140 and r["crowded"]} == {bytes([k]) for k in range(140)}
    assert sum(r["bucket"] in (2000, 2001) for r in m) == 140 and not any(1000 <= r["bucket"] < 2000 for r in m)


def test_links_in_a_crowded_bucket_without_finer_ones(spark, monkeypatch):
    real = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda docs, width: real(docs, width).withColumn(
        "buckets", F.when(F.col("key").isNotNull(), F.array(F.lit(7).cast("long")))))
    monkeypatch.setattr(minhash, "CROWDED", 16)
    rnd = random.Random(8)
    rows = []
    for g in range(12):
        words = ["common"] * 3 + [f"w{rnd.randrange(10**6)}" for _ in range(60 + 9 * g)]
        for _ in range(4):
            at = rnd.randrange(3, len(words))
            words = words[:at] + [f"v{rnd.randrange(10**6)}"] + words[at + 1:]
            rows.append((len(rows), " ".join(words)))
    check(spark, rows)
    assert len({c for _, _, c in brute_components(rows, 2, 80)}) < len(rows)


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  b\n"), (7, "a  b\n"), (8, "b a"), (9, "é Ab"), (10, "É ab"),
            (None, "a b"), (None, "lonely text here"), (11, "x " * 30_000), (12, "x x"), (13, "w1 w2 w3 w4 w5 w6"), (13, "other text"), (0, "other text")]
    check(spark, [(*r, "clash", 1, None) for r in rows], schema="doc_id long, text string, key string, node int, kept string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, width=2).collect()}
    assert {(6, 6, True), (7, 6, False), (None, 6, False), (None, None, True), (1, 1, True), (13, 0, False), (13, 13, True)} <= got
    kept = minhash.deduplicate(df, width=2)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 13}


@pytest.mark.parametrize("crowded", [64, 4])
def test_near_duplicates_hot_group_of_chains(spark, monkeypatch, crowded):
    """Copies of copies: many members are far from any one hub, chains hold them together."""
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    texts = [base]
    for k in range(350):
        t = list(texts[rnd.randrange(max(0, len(texts) - 40), len(texts))])
        for _ in range(rnd.randint(1, 6)):
            t[rnd.randrange(len(t))] = f"n{rnd.randint(0, 10**6)}"
        texts.append(t)
    check(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])


# ---- tiling ------------------------------------------------------------------------------------------------

def brute_tiles(item, doc, least):
    """The longest unmarked common stretch, again and again; the first in the item, then in the document."""
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and fi[p + n] and fd[d + n] and item[p + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < least:
            return out
        out.append((p, d, n))
        fi[p:p + n] = [False] * n
        fd[d:d + n] = [False] * n


def test_tiles_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(400):
        letters = rnd.choice([2, 3, 30])
        item, doc = ([rnd.randrange(letters) + 1 for _ in range(rnd.randint(0, 40))] for _ in range(2))
        if rnd.random() < 0.5 and len(item) > 10:
            cut = rnd.randrange(len(item))
            doc = doc[:5] + item[cut:] + doc[5:9] + item[:cut] + doc[9:]
        least = rnd.choice([1, 2, 3, 5])
        got, want = tiling.tile(item, doc, least), brute_tiles(item, doc, least)
        assert [t[2] for t in got] == [t[2] for t in want] and sorted(got) == sorted(want)


def test_matches_equal_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], minhash.words_of(r["text"])) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    items = [(r["item_id"], minhash.words_of(r["text"])) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    want = {}
    for d, dw in docs:
        grams = {tuple(dw[k:k + 5]) for k in range(len(dw) - 4)}
        for i, iw in items:
            if any(tuple(iw[k:k + 5]) in grams for k in range(len(iw) - 4)):
                n = sum(t[2] for t in brute_tiles(iw, dw, 5))
                if n >= 0.5 * len(iw):
                    want[d, i] = n
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in QUERIES["op9_decontamination"](spark, root).collect()}
    assert got == want and len(want) > 10


def test_matches_edges_and_reordered_passages(spark):
    item = [f"t{k}" for k in range(40)]
    texts = [None, "", " \n", " ".join(item), " ".join(["x"] * 9 + item[20:] + ["y"] * 9 + item[:20]).upper(), " ".join(item[:12]), "short one here", "x " * 50_000]
    rows = [(k, t, 1, None) for k, t in enumerate(texts)] + [(3, texts[3], 2, None), (None, texts[3], 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, seeds string")
    bench = spark.createDataFrame([(7, " ".join(item), "z"), (None, "Short ONE", None), (8, None, None), (9, "", None)], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"], len(r["tiles"])) for r in tiling.matches(docs, bench).where("doc_id is not null").collect()
                 if r["item_id"] is not None)
    assert got == [(3, 7, 1.0, 1), (3, 7, 1.0, 1), (4, 7, 1.0, 2)]
    assert [(r["doc_id"], r["coverage"]) for r in tiling.matches(docs, bench).where("item_id is null").collect()] == [(6, 1.0)]
    clean = tiling.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 5, 7]
    assert tiling.matches(docs.limit(0), bench).count() == 0 and tiling.matches(docs, bench.limit(0)).count() == 0


def test_words_split_at_six_characters_only():
    import re
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for t in ("A b\tC\x1cd\x85e\u00a0f\n\x0bg\x0c h\r i", "É\x1f Ab\u2003c", "", "  ", "\x1c"):
        h = minhash.word_hashes(t)
        assert len(h) == len(minhash.words_of(t)) and all(h[i] == minhash.word_hashes(w)[0] for i, w in enumerate(minhash.words_of(t)))
        assert [w.decode() for w in minhash.words_of(t)] == [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in word.findall(t)]
