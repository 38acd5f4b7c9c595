"""Secret scans over a trigram inverted index, DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams of the lower-cased text (every
match must contain them). ``postings`` lists, for the trigrams that the rules name, the documents that hold
them; ``candidates`` intersects the postings per rule; ``scan`` verifies the rules on their
candidates only. A rule without mandatory trigrams is verified on every document.

Scale: postings hold only trigrams that some rule names, at most ``len(vocabulary)`` short rows per
document. They are keyed and intersected by document, not by trigram, so a trigram of every text loads no single
task. Verification is per row and the join that brings candidates to texts is by
row id, one row each, so no key is hot.

Edge cases: null and empty texts have no spans; repeated rows and null doc_ids are scanned row by
row; an empty table gives an empty result; extra columns are ignored (``scan``) or kept (``redact``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import lower_ascii, text_or_empty

MAX_STRINGS = 64  # alternatives of one stretch of a pattern that are spelt out; beyond that it constrains nothing


@dataclass(frozen=True)
class Rule:
    """``pattern``: what to find, leftmost and non-overlapping; a find counts if group ``group`` has ``least``
    characters or more. ``rest``: what belongs to the secret after a find, removed with it by ``redact``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    rest: str = ""


# The body of a key: up to its END line, or where there is none before the next key, PEM headers and base64 lines. Line ends
# may be written as \n (JSON, source code). Loops are possessive, so that Java's matcher runs them without recursion.
_GAP = r"""(?:[\x09-\x0D\x20"',;+#>*]|\\[nrt])"""
_KEY_BODY = (r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
             rf"|(?:{_GAP}++(?:Proc-Type|DEK-Info):[\x20]*+[A-Za-z0-9,-]++)*+"
             rf"""(?:(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\\\x0A\x0D"']|\Z))?+)?+)""")

# The first three are fixed by the contract. Classes with a "+" and a least length are written with a count
# where that finds the same spans (a run cannot hold a longer run).
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", rest=_KEY_BODY),
    Rule("basic_auth", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"),
)
BASE_KINDS = ("assign", "access", "hex")


# ---- Boolean trigram queries -------------------------------------------------------------------------------
# A query is True (no constraint), ("gram", g), ("and", parts) or ("or", parts).

def _all(parts) -> object:
    flat = {p for q in parts if q is not True for p in (q[1] if q[0] == "and" else (q,))}
    return True if not flat else (next(iter(flat)) if len(flat) == 1 else ("and", tuple(sorted(flat, key=repr))))


def _any(parts) -> object:
    parts = list(parts)
    if any(p is True for p in parts):
        return True
    flat = {p for q in parts for p in (q[1] if q[0] == "or" else (q,))}
    terms = {p: set(p[1]) if p[0] == "and" else {p} for p in flat}
    flat = {p for p in flat if not any(terms[o] < terms[p] for o in flat)}  # a or (a and b) is a
    return next(iter(flat)) if len(flat) == 1 else ("or", tuple(sorted(flat, key=repr)))


def _grams(strings: set[str]) -> object:
    return _any(_all(("gram", s[i:i + 3]) for i in range(len(s) - 2)) for s in strings)


def _spelt(node) -> set[str] | None:
    """Every string a node can match, lower-cased, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _spelt_all(arg[3])
    if op is sre.BRANCH:
        sets = [_spelt_all(x) for x in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _spelt_all(inner) if high <= 8 else None
        if one is None or sum(len(one) ** k for k in range(low, high + 1)) > MAX_STRINGS:
            return None
        return {"".join(x) for k in range(low, high + 1) for x in itertools.product(one, repeat=k)}
    return {""} if op is sre.AT else None


def _spelt_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _spelt(node)
        if s is None or len(out) * len(s) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(nodes) -> object:
    """Stretches that can be spelt out are joined before they are cut into trigrams."""
    found, run = [], {""}
    for node in nodes:
        s = _spelt(node)
        if s is not None and len(run) * len(s) <= MAX_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        found.append(_grams(run))
        run = s if s is not None else {""}
        if s is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                found.append(_query(arg[3]))
            elif op is sre.BRANCH:
                found.append(_any(_query(x) for x in arg[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                found.append(_query(arg[2]))
    found.append(_grams(run))
    return _all(found)


def trigram_query(pattern: str) -> object:
    """Boolean query that the lower-cased text of each match satisfies; True if nothing is mandatory."""
    return _query(sre_parser.parse(pattern))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    out: set[str] = set()

    def walk(q) -> None:
        if q is not True:
            if q[0] == "gram":
                out.add(q[1])
            else:
                for p in q[1]:
                    walk(p)

    for r in rules:
        walk(trigram_query(r.pattern))
    return sorted(out)


# ---- Index -------------------------------------------------------------------------------------------------

def _gram_finder(grams: list[str]) -> str:
    """Pattern whose finds are the vocabulary's trigrams at every position (a look-ahead, so finds may
    overlap); alternatives share their first two characters."""
    def quoted(s: str) -> str:
        return "".join(c if c.isalnum() else rf"\x{ord(c):02x}" for c in s)

    heads: dict[str, dict[str, list[str]]] = {}
    for g in grams:
        heads.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    return "(?=(" + "|".join(
        quoted(a) + "(?:" + "|".join(f"{quoted(b)}[{''.join(quoted(c) for c in cs)}]" for b, cs in bs.items()) + ")"
        for a, bs in heads.items()) + "))"


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Inverted index (gram, id), one row per trigram of the rules and document that holds it."""
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(text_or_empty("text")), F.lit(_gram_finder(vocabulary(rules))), F.lit(1)))
    return docs.select(F.explode(found).alias("gram"), F.col(id_col).alias("id"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): the rules whose query the document's postings satisfy.

    The postings of a document meet as one bit mask per word of 62 trigrams, combined on the map side."""
    vocab = vocabulary(rules)
    place = {g: divmod(k, 62) for k, g in enumerate(vocab)}
    words = range(len(vocab) // 62 + 1)
    bit = F.create_map(*[F.lit(x) for g in vocab for x in (g, place[g][0] * 64 + place[g][1])])
    coded = index.select("id", F.element_at(bit, F.col("gram")).alias("at"))
    masks = coded.groupBy("id").agg(*[
        F.bit_or(F.when(F.shiftright("at", 6) == w, F.expr("shiftleft(1L, at & 63)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in words])

    def holds(q) -> Column:
        if q[0] == "gram":
            w, b = place[q[1]]
            return F.col(f"m{w}").bitwiseAND(F.lit(1 << b)) != 0
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), [holds(p) for p in q[1]])

    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items() if q is not True],
                                    F.lit(None).cast("string")))
    return masks.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def prefix_sums(values: Column, block: int = 256, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sum (or ``join``, whose neutral element is 0) of the elements before each element. Sums run within blocks and over
    blocks, so that growing an array by one element at a time stays cheap for long arrays."""
    def running(a: Column, start: Column) -> Column:
        grown = F.aggregate(a, F.array(start), lambda acc, v: F.concat(acc, F.array(join(F.element_at(acc, -1), v))))
        return F.slice(grown, 1, F.size(a))

    n_blocks = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1),
                         lambda b: F.slice(values, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: join(acc, v)))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))


_NO_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Spans of a rule's finds, ends exclusive, in code points. The texts between finds and the finds give all offsets."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)), F.lit(1), F.size(whole))
    lens = F.transform(whole, lambda x: F.length(x))
    before = prefix_sums(F.zip_with(gaps, lens, lambda a, b: a + b))
    rows = F.transform(F.arrays_zip(before.alias("b"), gaps.alias("g"), lens.alias("l"),
                                    F.transform(value, lambda x: F.length(x)).alias("v")),
                       lambda x: F.struct((x["b"] + x["g"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
                                          (x["b"] + x["g"] + x["l"]).alias("end"), x["v"].alias("v")))
    good = F.transform(F.filter(rows, lambda x: x["v"] >= rule.least),
                       lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), good).otherwise(F.array().cast(_NO_SPANS))


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus ``_kinds``, the rules to verify on each row.

    Rows meet their candidate kinds by ``id_col`` (rows that share an id share the union of their kinds)."""
    found = candidates(postings(docs, rules, id_col), rules)
    out = docs.join(found.withColumnRenamed("id", "_cid"), F.col(f"`{id_col}`").eqNullSafe(F.col("_cid")), "left")
    always = F.array(*[F.lit(r.kind) for r in rules if trigram_query(r.pattern) is True], F.lit(None).cast("string"))
    return (out.withColumn("_kinds", F.concat(F.coalesce(F.col("kinds"), F.array().cast("array<string>")), F.array_compact(always)))
            .drop("kinds", "_cid"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array<struct<start, order, kind, end>> sorted by start, then rule order. One row per row."""
    df = with_candidates(docs.select("doc_id", text_or_empty("text").alias("text")), rules)
    arrays = [F.when(F.array_contains("_kinds", r.kind), _spans(r, k, F.col("text")))
              .otherwise(F.array().cast(_NO_SPANS))
              for k, r in enumerate(rules)]
    return df.select("doc_id", F.sort_array(F.flatten(F.array(*arrays))).alias("spans"))


def _cut(text: Column, spans: Column, block: int = 256) -> Column:
    """``text`` with every stretch that ``spans`` cover (sorted, overlapping ones merged) replaced by the kind of its first
    span. Runs of ``block`` stretches are cut out of the text first, so that no stretch is looked up from the text's start."""
    before = prefix_sums(F.transform(spans, lambda s: s["end"]), join=F.greatest)
    opens = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))),
                     lambda x: x["to"] >= x["from"])
    held = F.transform(F.array(opens), lambda o: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(o) - 1) / F.lit(block)).cast("int")), lambda b: F.slice(o, b * block + 1, F.lit(block))))
    runs = F.transform(F.flatten(held), lambda r: F.struct(
        r.alias("r"), F.get(r, F.lit(0))["from"].alias("at"),
        F.substring(text, F.get(r, F.lit(0))["from"] + 1, F.element_at(r, -1)["to"] - F.get(r, F.lit(0))["from"]).alias("t")))
    pieces = F.transform(runs, lambda x: F.array_join(F.transform(x["r"], lambda o: F.concat(
        F.substring(x["t"], o["from"] - x["at"] + 1, o["to"] - o["from"]), F.lit("["), o["kind"], F.lit("]"))), ""))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with all that ``scan`` finds in the text replaced by ``[kind]``, overlapping finds by the kind of the first.
    What rules find only in the text so cut is then replaced rule after rule. ``n_chars``, if there, follows the text."""
    df = with_candidates(docs, rules)
    text = F.col("text")
    none = F.array().cast(_NO_SPANS)
    whole_rules = [replace(r, pattern=r.pattern + r.rest) for r in rules]
    df = df.withColumn("_found", F.sort_array(F.flatten(F.array(*[
        F.when(F.array_contains("_kinds", r.kind), F.coalesce(_spans(r, k, text), none)).otherwise(none) for k, r in enumerate(whole_rules)]))))
    df = df.withColumn("text", F.when(F.size("_found") > 0, _cut(text, F.col("_found"))).otherwise(text))
    for r in rules:
        whole = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)) if r.group else whole
        put = F.zip_with(whole, value, lambda a, v: F.when(F.length(v) >= r.least, F.lit(f"[{r.kind}]")).otherwise(a))
        done = F.array_join(F.zip_with(F.split(text, r.pattern, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        df = df.withColumn("text", F.when((F.size("_found") > 0) & F.array_contains("_kinds", r.kind) & text.rlike(r.pattern), done).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
