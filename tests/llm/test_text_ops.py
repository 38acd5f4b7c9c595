"""HTML extraction, BPE encoding and toxicity: golden cases, the tokenizers library, held-out accuracy."""

import array
import hashlib
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe, html_render, queries, toxicity  # noqa: F401
from panelspark.llm.html_render import extract
from panelspark.registry import QUERIES

ROOT = "/root/testdata/sf0.001"
BPE_FILE = public_tokenizers.path("word_bpe_49k.json")


# ---- HTML --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &amp; <text> 1 < 2", "plain & 1 < 2"), ("<p>a<p>b", "a\n\nb"), ("a<div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", "- x\n- y\n\n  3. z\n  4. w"),
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
    ("<table><tr><td>a<td>bbbb<tr><td>ccc<td>d</table>", "a    bbbb\nccc  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><th colspan=2>head<tr><td>x<td>y</table>", "head\nx  y"),
    ("<table><td>one<br>two<td>z</table>", "one  z\ntwo"),
    ("<head><title>t</title><style>p{}</style><p>x", "x"), ("<title>t</title>x", "x"),
    ("<script>var a='</p>'</script>ok<noscript>no</noscript>", "ok"),
    ("<pre>\n x\n  y</pre>z", " x\n  y\n\nz".strip("\n")),
    ("<p hidden>a</p><p style='display:none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>", "d"),
    ("<style>.ad, #q{display:none} p.x{visibility:hidden}</style><div class='ad z'>a</div><p id=q>b<p class=x>c<p>d", "d"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<select><option>1<option selected>2</select> <input value=v><input type=hidden value=h>", "2 v"),
    ("<b>a<p>b</b>c</p>d", "a\n\nbc\n\nd"), ("<!-- x -->a<!-- open", "a"), ("<!DOCTYPE html><html><body>a</body></html>", "a"),
    ('a<p title="never closed>b', "a\n\nb"), ("a&nbsp;b &copy; &#233;", "a b © é"), ("a  \n b<br>c", "a b\nc"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<textarea>x <b>\n y</textarea>", "x <b>\n y"), ("</p>a</div></span>", "a"), ("<h1>a<h2>b", "a\n\nb"), ("<", "<"), ("<p", ""),
])
def test_extract(html, text):
    assert extract(html) == text


@pytest.mark.parametrize("html, text", [
    ("<style>@media print { .nav{display:none} } .ad{display:none}</style><p class=nav>a<p class=ad>b", "a"),
    ("<style>@media (max-width:600px){table{display:none}}</style><table><tr><td>a</table>", "a"),
    ("<style>@media screen and (min-width:600px){.m{display:none}}</style><p class=m>a<p>b", "b"),
    ("<style>@media not all and (monochrome), print{.m{display:none}}</style><p class=m>a<p>b", "b"),
    ("<style>@media only screen and (width <= 37.5em){.m{display:none}} @media (400px<width<2000px){.n{display:none}}</style><p class=m>a<p class=n>b", "a"),
    ("<style>@media screen{@media print{.m{display:none}}}</style><p class=m>a", "a"),
    ("<style>@supports not (display:grid){.m{display:none}} @supports (display:grid){.n{display:none}}</style><p class=m>a<p class=n>b", "a"),
    ("<style>.a{color:red;.b{display:none} @media print{display:none}}</style><p class=b>b<p class=a>a", "b\n\na"),
    ("<style>@import url(x.css);.a{display:none} .b::after{content:'}.c{display:none}'}</style><p class=a>a<p class=c>c", "c"),
    ("<style>@keyframes k{from{visibility:hidden}} @media (no-such:1){p{display:none}}</style><from>a</from><p>b", "a\n\nb"),
    ("<style media=print>p{display:none}</style><style media='screen, print'>b{display:none}</style><p>a<b>c</b>", "a"),
    ("x<svg><title>no</title><defs><text>no</text></defs><rect width='5'/><g><text x=1>A <tspan>B</tspan></text></g>stray<text>C</text></svg>y", "x\nA B\nC\ny"),
    ("<svg><path d=''/><tspan/><foreignObject><p>in</p></foreignObject><text visibility=hidden>no</text></svg><p>out", "in\n\nout"),
    ("<svg><path d=''><p>out", "out"), ("<svg/><b>x</b><svg width=5/><text>t", "x\nt"),
    ("a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></mrow><annotation>no</annotation></semantics><mphantom>no</mphantom></math> b", "a x=1 b"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
    ("<map name=m><p>go <a href=x>there</a></p><area alt=no></map>", "go there"),
])
def test_extract_conditions_drawings_formulas_and_maps(html, text):
    assert extract(html) == text


def test_extract_deep_and_long():
    assert extract("<div>" * 5000 + "x" + "<span>" * 5000 + "y") .split() == ["xy"]
    assert extract("<p>a b " * 50_000).split() == ["a", "b"] * 50_000
    assert extract('<p x="' * 3001 + "z") in ("", "z")


def test_extract_keeps_every_visible_word():
    """Random trees whose visible words are known."""
    rnd = random.Random(4)
    count = 0

    def tree(depth, seen):
        nonlocal count
        out, words = "", []
        for _ in range(rnd.randint(1, 4)):
            if depth == 0 or rnd.random() < 0.4:
                count += 1
                out += f" w{count} "
                words += [f"w{count}"] if seen else []
                continue
            tag = rnd.choice(["div", "b", "section", "ul", "td", "span", "i", "script", "gone", "quote"])
            inner, got = tree(0 if tag == "script" else depth - 1, seen and tag not in ("script", "gone"))
            out += {"script": f"<script>{inner}</script>", "gone": f"<section hidden>{inner}</section>", "ul": f"<ul><li>{inner}</ul>",
                    "td": f"<table><tr><td>{inner}</td></tr></table>", "quote": f"<blockquote>{inner}</blockquote>"}.get(tag, f"<{tag}>{inner}</{tag}>")
            words += got
        return out, words

    for _ in range(300):
        html, words = tree(4, True)
        assert [x for x in extract(html).split() if x != "-"] == words, html


def _plain_table(rows):
    """Text of a table by a grid of its slots. Rows of (text lines, colspan, rowspan)."""
    grid, cells = set(), []
    for r, row in enumerate(rows):
        k = 0
        for lines, wide, tall in row:
            while (r, k) in grid:
                k += 1
            grid |= {(r + i, k + j) for i in range(min(tall or len(rows), len(rows) - r)) for j in range(wide)}
            cells.append((r, k, wide, lines))
            k += wide
    width = [0] * 100
    for one in (True, False):
        for _, k, wide, lines in cells:
            need = max(map(len, lines), default=0)
            while (wide == 1) == one and need and sum(w + 2 for w in width[k:k + wide] if w) - 2 < need:
                width[k + wide - 1] += 1
    left = [sum(w + 2 for w in width[:k] if w) for k in range(100)]
    out = []
    for r in range(len(rows)):
        own = [(k, lines) for q, k, _, lines in cells if q == r]
        for j in range(max((len(x) for _, x in own), default=0)):
            line = [" "] * 1000
            for k, lines in own:
                if j < len(lines):
                    line[left[k]:left[k] + len(lines[j])] = lines[j]
            out.append("".join(line).rstrip())
    return "\n".join(out)


def test_extract_table_layout_against_a_grid():
    rng = random.Random(5)
    for _ in range(500):
        rows = [[(rng.choice([[], ["q"], ["word two"], ["a", "b"], ["x" * 9]]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 0]))
                 for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={t}>" + "<br>".join(x) for x, w, t in row) for row in rows) + "</table>"
        assert extract(html) == _plain_table(rows).strip("\n"), html
        assert sorted(extract(html).split()) == sorted(" ".join(y for row in rows for x, _, _ in row for y in x).split())


def test_extract_large_tables_and_sheets_stay_in_proportion():
    wide = "<table><tr><td>" + "w" * 64_000 + "<td>x" + "<tr><td><td>y" * 4_000 + "</table>"
    assert extract(wide).split() == ["w" * 64_000, "x", *["y"] * 4_000]
    assert len(extract(wide)) < 2 * len(wide)
    spans = "<table>" + "<tr><td colspan=1000 rowspan=9999>x" * 3_000 + "</table>"
    assert extract(spans).split() == ["x"] * 3_000
    far = "<table><tr><td colspan=500><td>a<tr>" + "<td>" * 500 + "<td>b</table>"
    assert extract(far) == "a\nb"
    rules = "".join(f".c{i}{{display:none}}" for i in range(20_000))
    assert extract(f"<style>{rules}.k.m{{display:none}}</style>" + "<p class=k>a<p class='m k'>b<p class=c7>c" * 2_000).split() == ["a"] * 2_000


def test_extract_later_rules_win():
    assert extract("<style>.a{display:none}#i{display:block}</style><p class=a id=i>x") == "x"
    assert extract("<style>#i{display:block}.a{display:none}</style><p class=a id=i>x") == ""
    assert extract("<style>.a{display:none}.a{visibility:hidden}.a{display:block}p.a{visibility:visible}</style><p class=a>x<div class=a>y") == "x"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "y"), (None, None, None), (2, "", "z")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_render.extract_pages(pages).collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert html_render.extract_pages(pages.limit(0)).count() == 0
    got = {r["page_id"]: r["text"] for r in QUERIES["op1_html_text"](spark, ROOT).collect()}
    assert got == {r["page_id"]: extract(r["html"]) for r in spark.read.parquet(f"{ROOT}/pages.parquet").collect()}
    assert all("<p>" not in t and "track(" not in t for t in got.values())


# ---- BPE ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE_FILE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(BPE_FILE, encoding="utf-8") as f:
        return bpe.PrefixTokenizer(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_random_texts(library, own):
    rnd = random.Random(7)
    letters = list("abcdehilnorst'’ éÉßΣσςİ²٠ẞ́​\u0085  \x1c\x1f\n\t.,!<|>_-19#日本\U0001f600ﬁ\x00")
    for k in range(6000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        if k % 40 == 0:
            x += "<|endoftext|> A<|startoftext|>" + x
        ids, said = own.encode(x)
        assert (list(array.array("I", ids)), said) == expected(library, x), repr(x)
        assert own.decode(list(array.array("I", ids))) == said


def test_bpe_long_words(library, own):
    for x in ("a" * 5000, "ab" * 3000, "!" * 3000, "th" * 2000 + "é"):
        assert list(array.array("I", own.encode(x)[0])) == expected(library, x)[0]


def test_bpe_cache_generations(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    text = "the cat and the dog and the bird saw the cat again"
    for _ in range(3):
        assert list(array.array("I", own.encode(text)[0])) == expected(library, text)[0]


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, ROOT).collect()}
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, said = expected(library, r["text"])
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (
            len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_bpe_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "OUT_BYTES", 10)
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (2, "", None), (3, " \n", None)], "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, BPE_FILE).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]) // 4, r["decoded"]) for r in got) == [(0, 0, ""), (1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (2, 0, ""), (3, 0, "")]
    assert bpe.encode_documents(docs.limit(0), BPE_FILE).count() == 0


# ---- Toxicity ----------------------------------------------------------------------------------------------

def test_held_out_rule(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", toxicity.held_out(toxicity.F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_toxicity_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, root).where("held_out").collect()}
    lab = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{root}/labels.parquet").collect() if r["doc_id"] in got]
    assert len(lab) > 500 and all(0 <= r["score"] <= 1 for r in got.values())
    right = sum(got[i]["predicted"] == y for i, y in lab) / len(lab)
    false_alarms = sum(got[i]["predicted"] == 1 and y == 0 for i, y in lab) / sum(y == 0 for _, y in lab)
    assert right > 0.95 and false_alarms < 0.02


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "some text here", 5.0), (1, "some text here", None), (None, None, None), (2, "", 1.0), (3, "1234", 1.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], none.schema)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, one)).count() == 0


def test_toxicity_small_training_set():
    m = toxicity.train(["the quick brown fox jumps"] * 3 + [f"plain text number {k} goes on" for k in range(30)],
                       [f"plain text {k} you horrible nitwit" for k in range(12)])
    s = toxicity.Scorer(m)
    assert s.score("what a horrible nitwit he is") > 0.5 > s.score("plain text goes on") and s.score("x" * 100_000) < 0.5
    assert toxicity.windows("a b c", 2) == {"a b", "b c"} and toxicity.windows("a", 2) == {"a"} and toxicity.windows(None, 2) == set()
