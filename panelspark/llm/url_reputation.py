"""URL filter by empirical-Bayes host reputation, DataFrame functions only.

Outcomes of labelled pages (1 good, 0 bad) are counted per host. A beta-binomial model shrinks
the rate of each suffix towards the overall rate, of each registered domain towards
its suffix and of each host towards its domain; how strongly is estimated by
moments at every level. A page is blocked if its host's posterior rate is below ``min_rate`` with
confidence: posterior mean + ``z`` posterior standard deviations < ``min_rate``. Hand-written rules go first.

Scale: pages are pre-aggregated to one row per host; domains and suffixes are aggregates of
that. A page meets its host's row by a join in which the hosts that hold more than 1/1000 of all labelled or unlabelled pages
(fewer than 1,000 by arithmetic) are broadcast and the others shuffled, so no key is hot.

Edge cases: a null url or one without ``://`` has empty host and path and is judged as host ""; hosts
without outcomes take their domain's posterior; no outcomes at all: the rate is 0.5 everywhere and
nothing is blocked; null page_ids and repeated rows are judged row by row; null outcomes are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut_lineage, lower_ascii

# Two-part public suffixes, fixed values; every other suffix is the part after the last dot.
TWO_PART_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
HOT_SHARE = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the part before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-counts of the prior at one level, by moments of the beta-binomial (between 1 and 10,000)."""
    v = mean * (1 - mean)
    n, y = F.col("n").cast("double"), F.col("good").cast("double")
    r = groups.agg(F.sum((y - n * mean) * (y - n * mean) - n * v).alias("a"), F.sum(n * (n - 1) * v).alias("b")).first()
    if not r["b"]:
        return 10_000.0
    rho = min(max(r["a"] / r["b"], 1 / 10_001), 0.5)
    return 1 / rho - 1


def reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", label_col: str = "good") -> DataFrame:
    """One row per host of ``pages`` (page id, host): host, n_pages, n, good, mean, sd of the posterior rate."""
    lab = (outcomes.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_oid")).agg(F.min(label_col).cast("long").alias("_good")))
    hosts = (pages.select(F.col(id_col).alias("_pid"), "host").join(lab, F.col("_pid") == F.col("_oid"), "left")
             .groupBy("host").agg(F.count("*").alias("n_pages"), F.count("_good").alias("n"),
                                  F.coalesce(F.sum("_good"), F.lit(0)).alias("good"))
             .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    hosts = cut_lineage(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0, total["good"] or 0
    overall = F.lit(good / n if n else 0.5)

    def posterior(df: DataFrame, mean: Column) -> tuple[Column, float]:
        k = _strength(df, mean)
        return (F.col("good") + k * mean) / (F.col("n") + k), k

    s_mean, _ = posterior(suffixes, overall)
    s = suffixes.select(F.col("suffix").alias("_s"), s_mean.alias("s_mean"))
    d = domains.join(s, F.col("suffix") == F.col("_s")).drop("_s")
    d_mean, _ = posterior(d, F.col("s_mean"))
    d = d.select(F.col("domain").alias("_d"), F.col("suffix").alias("_ds"), d_mean.alias("d_mean"))
    h = hosts.join(d, (F.col("domain") == F.col("_d")) & (F.col("suffix") == F.col("_ds"))).drop("_d", "_ds")
    h_mean, k = posterior(h, F.col("d_mean"))
    return h.select("host", "n_pages", "n", "good", h_mean.alias("mean"),
                    F.sqrt(h_mean * (1 - h_mean) / (F.col("n") + k + 1)).alias("sd"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null if none fits). A rule is (verdict, host/path); it fits its host and
    all subdomains if the path starts with the rule's path. Equal lengths: the first listed."""
    name = verdict = None
    for v, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), *, min_rate: float = 0.5,
          z: float = 1.645, id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound; one row per row of ``pages``."""
    host, path = split_url(F.col("url"))
    p = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rep = cut_lineage(reputation(p, outcomes, id_col)).select(
        F.col("host").alias("_h"), "n_pages", F.col("mean").alias("rate"),
        (F.col("mean") + z * F.col("sd")).alias("bound"))
    n = rep.agg(F.sum("n_pages")).first()[0] or 0
    hot = rep.where(F.col("n_pages") * HOT_SHARE > n)  # fewer than HOT_SHARE rows
    cold = rep.where(F.col("n_pages") * HOT_SHARE <= n)
    p = p.join(F.broadcast(hot.select(F.col("_h").alias("_hh"), F.col("rate").alias("_r"), F.col("bound").alias("_b"))),
               F.col("host") == F.col("_hh"), "left")
    # pages of hot hosts are done: they travel under keys of their own, which no host equals
    key = F.when(F.col("_hh").isNull(), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64(id_col, "path")))
    p = p.withColumn("_key", key).join(cold.drop("n_pages"), F.col("_key") == F.col("_h"), "left")
    rate, bound = F.coalesce("_r", "rate"), F.coalesce("_b", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(bound < min_rate, "block").otherwise("allow")
    return p.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
                    rate.alias("rate"), bound.alias("bound"))
