"""The corpus pipeline against brute force, stage by stage and as a whole."""

import array
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from panelspark.llm import minhash, quality, secret_scan, tiling
from tests.llm.test_dedup_ops import brute_components
from tests.llm.test_native_ops import brute_stats

ROOT = "/root/testdata/sf0.001"


def features(text):
    n, chars, symbols, dup, repeat = brute_stats(text)
    t = text or ""
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    words = re.findall(r"[^\x20\x09-\x0D]+", t)

    def share(a, b):
        return a / b if b else 0.0

    return {"n_words": float(n), "mean_word": share(chars, n), "symbol_share": share(symbols, chars),
            "upper_share": share(sum("A" <= c <= "Z" for c in t), chars), "digit_share": share(sum("0" <= c <= "9" for c in t), chars),
            "mark_share": share(sum(c in "!?\"'()[]{}/\\@^_~=+;:" for c in t), chars), "dup_line_share": share(dup, len(lines)),
            "repeat_share": share(repeat, n), "distinct_share": share(len(set(words)), n)}


def brute(rows, rules, bench, tokenizer):
    """rows: dicts. The five stages in plain Python, given the learned list."""
    kept = []
    for r in rows:
        n, _, _, _, repeat = brute_stats(r["text"])
        f = features(r["text"])
        fired = any(all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in rules.rules)
        if n >= 50 and 100 * repeat <= 50 * n and not fired:
            kept.append(r)
    yield kept
    component = {d: c for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in kept], 5, 80)}
    kept = [r for r in kept if component[r["doc_id"]] in (r["doc_id"], None)]
    yield kept
    clean = []
    for r in kept:
        known = {}
        doc = tiling._ids(minhash.words_of(r["text"]), known)
        items = [tiling._ids(minhash.words_of(b), known) for b in bench]
        grams = {tuple(doc[k:k + 5]) for k in range(len(doc) - 4)}
        near = [i for i in items if any(tuple(i[k:k + 5]) in grams for k in range(len(i) - 4))]
        if not any(sum(t[2] for t in tiling.tile(i, doc, 5)) >= 0.5 * len(i) for i in near):
            clean.append(r)
    yield clean
    for r in clean:
        for rule in secret_scan.RULES:
            r["text"] = re.sub(rule.pattern, lambda m, rule=rule: f"[{rule.kind}]" if len(m.group(rule.group)) >= rule.least else m.group(),
                               r["text"], flags=re.ASCII)
        r["n_chars"] = len(r["text"])
    yield clean
    out = []
    for r in clean:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        out.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids": array.array("I", ids).tobytes(), "decoded": tokenizer.decode(ids, skip_special_tokens=False)})
    yield out


def test_pipeline_equals_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    rules = quality.fit(quality.text_stats(docs), labels)
    bench = [r["text"] for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    stages = [[dict(r) for r in x] for x in brute([r.asDict() for r in docs.collect()], rules, bench, tokenizer)]
    assert len(stages[0]) < docs.count() and len(stages[1]) < len(stages[0]) and len(stages[2]) < len(stages[1])
    got = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        got = stage(spark, got, root).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        have = sorted((r.asDict() for r in got.collect()), key=lambda r: r["doc_id"])
        want = sorted(want, key=lambda r: r["doc_id"])
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert [r["doc_id"] for r in have] == [r["doc_id"] for r in want], name
        else:
            assert [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()} for r in have] == want, name


def test_run_writes_and_reads_between_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "tokens"]
    out = corpus_pipeline.run(spark, ROOT)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert rows and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)


def test_stages_on_nulls_extra_columns_and_empty_tables(spark):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, long, "en", "s", 5, "clash", 1), (1, long, "en", "s", 5, "clash", 1), (2, long + " more", None, None, None, None, None), (3, None, None, None, None, None, None),
            (None, long + " and other words token=abcdefgh1", "en", None, 1, "x", 2), (4, "", "", "", 0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node int")
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, ROOT)
        assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 1), (True, 0)]
    assert "[assign]" in next(r["text"] for r in got.collect() if r["doc_id"] is None)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, ROOT).count() == 0, name
