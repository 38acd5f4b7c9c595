"""Quality rules as a learned decision list, DataFrame functions only.

``text_stats`` adds per-document statistics, ``fit`` learns an ordered list of
threshold conjunctions for bad documents by sequential covering (grow a rule on one part
of the labelled rows, prune it on the other, remove what it covers, repeat) and
``DecisionList.verdict`` renders the list as one ordered ``CASE WHEN`` expression.

Scale: statistics are computed row by row without a shuffle. Learning works on the
labelled rows only, as a table of small bin numbers: each step is one aggregation of
(feature, bin) counts, pre-aggregated on the map side, whose result has at most
features x bins rows.

Edge cases: null text counts as no words; white-space-only and empty texts have zero
statistics; repeated rows are judged row by row; null labels, null doc_ids and doc_ids with no row
give no training data; without training data of both classes the list is empty and
every document that passes the base checks is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut_lineage, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# A position and the upper hash bits share one long while positions fit into this many bits.
_POSITION_BITS = 24

FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share",
            "dup_line_share", "repeat_share", "distinct_share")


def _repeat_words(df: DataFrame, words: str, n_words: str, out: str) -> DataFrame:
    """Words that lie in a 3-word window found twice or more (first find included).

    Windows are hashed; a sort of packed (hash, position) longs leaves the positions whose hash
    has an equal neighbour; those few are compared by their words. Covered words
    follow from the gaps between sorted window positions. O(n log n) per text.
    """
    w, n = F.col(words), F.col(n_words)
    mask = F.lit(-(1 << _POSITION_BITS))
    starts = F.when(n >= 4, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.sort_array(F.transform(
        starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(mask)
        .bitwiseOR(i.cast("long"))))
    df = df.withColumn("_sorted", F.when(n < (1 << _POSITION_BITS), packed))
    s = F.col("_sorted")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS), F.lit(False))

    near = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.when(k > 0, F.get(s, k - 1))))
    maybe = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int"))
    df = df.withColumn("_maybe", F.coalesce(maybe, starts))  # beyond the packed range every window is compared
    df = df.withColumn("_windows", F.sort_array(F.transform(
        F.col("_maybe"), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))))
    v = F.col("_windows")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce(x["g"] == y["g"], F.lit(False))

    twice = F.filter(v, lambda x, k: equal(x, F.get(v, k + 1)) | equal(x, F.when(k > 0, F.get(v, k - 1))))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_sorted", "_maybe", "_windows", "_at")


def text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus the statistics, one row per input row."""
    text = text_or_empty(F.col(text_col))
    df = docs.select(*keep, text.alias("_text"))
    t = F.col("_text")
    # blank lines hold no word and do not count as repeated lines
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_words": words_of(t), "_lines": lines})
    w = F.col("_words")

    def occurrences(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    df = df.select(
        *keep, "_words",
        F.size(w).alias("_n"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        occurrences(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        occurrences("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        occurrences("0123456789").alias("n_digits"),
        occurrences("!?\"'()[]{}/\\@^_~=+;:").alias("n_marks"))
    return _repeat_words(df, "_words", "_n", "n_repeat_words").drop("_words", "_n")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    """The learner's inputs: sizes and shares that do not depend on the text's length."""
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = feature_columns()[self.feature]
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects the document."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self) -> Column:
        """Number (from 1) of the first rule that holds, 0 if none does."""
        if not self.rules:
            return F.lit(0)
        out = None
        for k, rule in enumerate(self.rules, 1):
            cond = reduce(lambda a, b: a & b, [c.column() for c in rule])
            out = F.when(cond, k) if out is None else out.when(cond, k)
        return out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) or "keep"


def _bin_of(value: Column, cuts: list[float]) -> Column:
    """How many cut points lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)).cast("int")


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality",
        n_cuts: int = 48, max_rules: int = 10, max_conditions: int = 4, min_cover: int = 3,
        min_precision: float = 0.9, prune_of: int = 3) -> DecisionList:
    """Learn the list from labelled rows that pass the base checks (label 0: reject).

    Every labelled row takes part. One of ``prune_of`` hash shares prunes. A rule is kept if on both parts
    together it has ``min_precision`` and covers ``min_cover`` bad rows.
    """
    lab = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y")))
    feats = feature_columns()
    # written before it is filtered: a filter pushed below the statistics would repeat their expressions
    rows = cut_lineage(
        stats.join(lab, F.col(id_col) == F.col("_id"))
        .select((F.col("_y") == 0).cast("int").alias("bad"), base_failed().alias("failed"),
                (F.pmod(F.xxhash64("_id"), F.lit(prune_of)) == 0).alias("prune"),
                *[c.alias(f) for f, c in feats.items()])).where("not failed")
    shares = [k / (n_cuts + 1) for k in range(1, n_cuts + 1)]
    names = list(feats)
    # bad rows are rare: cut points come from both classes
    q = rows.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), shares, 10_000).alias(f"{f}_{b}")
                   for f in names for b in (0, 1)]).first()
    cuts = {f: sorted(set((q[f"{f}_0"] or []) + (q[f"{f}_1"] or []))) for f in names}
    if any(not q[f"{names[0]}_{b}"] for b in (0, 1)):
        return DecisionList()
    binned = cut_lineage(rows.select("bad", "prune", *[_bin_of(F.col(f), cuts[f]).alias(f) for f in names]))

    def holds(rule: list[tuple[str, bool, int]]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > k if above else F.col(f) <= k for f, above, k in rule], F.lit(True))

    def grow(left: DataFrame) -> list[tuple[str, bool, int]]:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            counts = (left.where(~F.col("prune") & holds(rule))
                      .select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])).alias("x"))
                      .groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("t")).collect())
            by: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in names}
            for r in counts:
                by[r["f"]][r["b"]] = (r["p"], r["t"] - r["p"])
            total_p = sum(p for p, _ in by[names[0]].values())
            total_n = sum(n for _, n in by[names[0]].values())
            if not total_p or not total_n:
                break
            best = (1e-9, None)
            for f in names:
                p = n = 0
                for k in range(len(cuts[f])):
                    dp, dn = by[f].get(k, (0, 0))
                    p, n = p + dp, n + dn  # bins up to k: value <= cut k
                    for above, pp, nn in ((False, p, n), (True, total_p - p, total_n - n)):
                        if pp >= min_cover and (g := _gain(pp, nn, total_p, total_n)) > best[0]:
                            best = (g, (f, above, k))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def pruned(left: DataFrame, rule: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], bool]:
        heads = [holds(rule[: k + 1]) for k in range(len(rule))]
        r = left.agg(*[F.sum(F.when(h & (F.col("prune") == part) & (F.col("bad") == b), 1).otherwise(0)).alias(f"c{k}_{int(part)}_{b}")
                       for k, h in enumerate(heads) for part in (False, True) for b in (0, 1)]).first()

        def worth(k: int) -> float:
            p, n = r[f"c{k}_1_1"], r[f"c{k}_1_0"]
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(len(rule)), key=lambda i: (worth(i), -i))
        p, n = r[f"c{k}_0_1"] + r[f"c{k}_1_1"], r[f"c{k}_0_0"] + r[f"c{k}_1_0"]
        return rule[: k + 1], p >= min_cover and p / (p + n) >= min_precision

    out, left = DecisionList(), binned
    while len(out.rules) < max_rules:
        rule = grow(left)
        if not rule:
            break
        rule, good = pruned(left, rule)
        if not good:
            break
        out.rules.append([Condition(f, above, float(cuts[f][k])) for f, above, k in rule])
        left = left.where(~holds(rule))
    return out


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics plus ``base_failed``, ``rule`` (0: none) and ``kept``."""
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.fired())
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were.

    Statistics are made once and written; rejected rows are found again by id and text hash."""
    text_hash = F.xxhash64(text_or_empty("text"))
    stats = cut_lineage(text_stats(docs.select("doc_id", "text", text_hash.alias("text_hash")), keep=("doc_id", "text_hash")))
    bad = judge(stats, fit(stats, labels)).where("not kept").select(
        F.col("doc_id").alias("__rejected_id"), F.col("text_hash").alias("__rejected_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__rejected_id")) & (text_hash == F.col("__rejected_hash")), "left_anti")
