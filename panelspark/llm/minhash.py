"""Near-duplicate groups: fast similarity sketches, banding, exact verification, connected components.

A text's set holds its distinct ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle). Texts with the
same word sequence form one class; classes are compared. A sketch throws every shingle into one of ``SIZE`` bins
per round and keeps the least value of a bin's first round, round after round until no bin is empty; after SIZE rounds a
round serves one bin each, so every coordinate fills. Equal coordinates estimate the Jaccard
similarity with binomial concentration. ``BANDS`` bands of ``ROWS`` coordinates give buckets; a pair at similarity 0.8
misses all buckets with probability 5e-8.

Links are confirmed on the full sets. Only the components of the link graph are wanted, so a bucket needs no all-pairs
output: (1) every member is compared with the bucket's hub, the member whose buckets are largest, and in larger
buckets with a random member; (2) in buckets that still hold several components, members outside the bucket's main component
are compared with a random member of it; (3) in buckets that still do, they are compared with the members of all other
components, so that no candidate link between components is left out. Members of crowded buckets also meet in finer ones; step (3)
takes the crowded buckets last, when the finer ones have joined most components, and there joins members on the rarest of the
shingles that tell them from the hub: a prefix filter that forms no pair by the bucket alone and loses none that can link.
Before texts are read, pairs whose 8-bit sketches agree in less than ``LEAST_AGREEMENT`` of the coordinates go (over 5
standard deviations below 0.8).

Scale: sketches are one map over the texts; classes, buckets and pairs are aggregated and joined by hash; nothing is gathered
per group in a task, and hot buckets give rows in proportion to their members. Rounds are written to
the checkpoint folder.

Edge cases: null, empty and white-space-only texts have an empty set and are linked with nothing; identical texts are one
component; repeated rows appear as often as given; rows with null doc_id take part and get the least non-null id of their
component (null if there is none; such rows are kept); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE_CLASS, lower_ascii, map_rows, step, text_or_empty
from panelspark.llm.components import connected_components

SIZE, ROWS = 128, 4
BANDS = SIZE // ROWS
LEAST_AGREEMENT = 0.6
CROWDED = 64  # members of a bucket beyond which they also meet in finer ones
DRAWS = 8  # random orders by which larger buckets pick a member; one for each bucket would give as many pairs as buckets
OUT_ROWS = 1_000  # sketches in a result batch
OUT_HASHES = 250_000  # hashes of differences in a result batch
FEW = 8  # members up to which a bucket's hub alone is compared first
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_SEEDS = _mix(np.arange(1, 2 * SIZE + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACES = _mix(np.arange(1, 65, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base and of its inverse, modulo 2**64."""
    def table(x: int) -> np.ndarray:
        out = np.ones(1, _U)
        while len(out) < 1 << bits:
            out = np.concatenate((out, out * _U(pow(x, len(out), 1 << 64))))
        return out

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def word_hashes(text: bytes | str | None) -> np.ndarray:
    """64-bit hash of every word of ``words_of(text)``: differences of one running polynomial over the bytes."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    n = len(raw)
    if not n:
        return np.empty(0, _U)
    power, inverse = _powers(max(14, (n - 1).bit_length()))
    a = np.frombuffer(raw, np.uint8)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(n + 1, _U)
    np.cumsum(a * power[:n], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of a text (UTF-8) with A-Z lower-cased. Byte strings lower-case and split at ASCII characters only, and their
    white space is the six characters meant."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes from word hashes."""
    k = min(width, len(words))
    if not k:
        return words
    total = np.zeros(len(words) - k + 1, _U)
    for j in range(k):
        total += words[j:len(words) - k + 1 + j] * _PLACES[j]
    s = np.sort(_mix(total + _U(k)))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def sketch(s: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set of hashes."""
    out = np.full(SIZE, np.iinfo(_U).max, _U)
    step = max(1, -(-4 * SIZE // len(s)))  # rounds done at once; later rounds never replace earlier ones
    i = 0
    while i < SIZE:
        rounds = np.arange(i, min(SIZE, i + step))
        g = _mix(s[None, :] ^ _SEEDS[rounds, None])
        np.minimum.at(out, (g & _U(SIZE - 1)).ravel(), ((rounds.astype(_U)[:, None] << _U(56)) | (g >> _U(8))).ravel())
        i += step
        if out.max() < _U(i) << _U(56):
            return out
    for b in np.flatnonzero(out == np.iinfo(_U).max):  # a round for each bin that is still empty
        out[b] = (_U(SIZE + b) << _U(56)) | (_mix(s ^ _SEEDS[SIZE + b]).min() >> _U(8))
    return out


def buckets_of(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket name for each band."""
    bands = coordinates.reshape(BANDS, ROWS) * _PLACES[:ROWS]
    return _mix(bands.sum(axis=1, dtype=_U) + _mix(np.arange(BANDS, dtype=_U) + _U(77))).view(np.int64)


def marks_of(coordinates: np.ndarray) -> bytes:
    """Eight bits of each coordinate."""
    return (_mix(coordinates) >> _U(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (names the word sequence), n_shingles, marks, buckets; key and the rest are null for empty sets."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, OUT_ROWS):  # one text at a time; few results wait for their batch
                keys, sizes, marks, buckets = [], [], [], []
                for k in range(at, min(at + OUT_ROWS, batch.num_rows)):
                    t = texts[k].as_py()
                    h = word_hashes(t)
                    if not len(h):
                        keys.append(None), sizes.append(0), marks.append(None), buckets.append(None)
                        continue
                    s = shingles(h, width)
                    c = sketch(s)
                    keys.append(md5(b" ".join(words_of(t)), usedforsecurity=False).digest())
                    sizes.append(len(s))
                    marks.append(marks_of(c))
                    buckets.append(buckets_of(c))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(keys)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                     pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "marks", "buckets"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_rows(src, run, f"doc_id {kind}, key binary, n_shingles long, marks binary, buckets array<long>")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, wide) whose marks agree often enough, or that are wanted for their difference (wide = 2)."""
    m = nodes.select("node", "marks")
    both = (pairs.join(m.select(F.col("node").alias("a"), F.col("marks").alias("ma")), "a")
            .join(m.select(F.col("node").alias("b"), F.col("marks").alias("mb")), "b").select("a", "b", "ma", "mb", "wide"))
    # equal marks also arise by chance, 1 in 256
    least = round(SIZE * (LEAST_AGREEMENT + (1 - LEAST_AGREEMENT) / 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
            near = pa.array(((x == y).sum(axis=1) >= least) | (batch.column(4).to_numpy() == 2))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in (0, 1, 4)], names=["a", "b", "wide"])

    return map_rows(both, run, "a binary, b binary, wide int")


def shingle_set(text: bytes | str | None, width: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return set(zip(*[w[j:] for j in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_parts(a: bytes | str | None, b: bytes | str | None, width: int) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' shingle sets, by the words themselves."""
    x, y = shingle_set(a, width), shingle_set(b, width)
    both = len(x & y)
    return both, len(x) + len(y) - both


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked, delta) of pairs (a, b, wide): ``linked`` by the full sets; for wide pairs (1 or 2) ``delta`` has the hashes of the
    shingles that one of the two lacks. Each text comes to its pairs by two joins, on either end."""
    rows = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb", "wide"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, linked, delta = 0, 0, [], []
            for k in range(batch.num_rows):
                x, y, wide = (batch.column(c)[k].as_py() for c in (2, 3, 4))
                both, either = jaccard_parts(x, y, width)
                linked.append(100 * both >= percent * either)
                delta.append(np.setxor1d(shingles(word_hashes(x), width), shingles(word_hashes(y), width), assume_unique=True).view(np.int64)
                             if wide else None)
                held += 1 + (len(delta[-1]) if wide else 0)
                if held >= OUT_HASHES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[start:k + 1], batch.column(1)[start:k + 1], pa.array(linked, pa.bool_()), pa.array(delta, pa.list_(pa.int64()))],
                        names=["a", "b", "linked", "delta"])
                    start, held, linked, delta = k + 1, 0, [], []

    return map_rows(rows, run, "a binary, b binary, linked boolean, delta array<long>")


def _distances(checked: DataFrame, hubs: DataFrame) -> DataFrame:
    """(hub, node, d, q, own): the shingles that tell a node from its hub, rarest among the hub's nodes first; how many they are, and how many of
    them tell another node from that hub, too."""
    ends = F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("node")), F.struct(F.col("b").alias("hub"), F.col("a").alias("node")))
    either = (checked.where("delta is not null").select("delta", F.inline(ends))
              .join(hubs.select("hub").distinct(), "hub", "left_semi"))
    each = either.select("hub", "node", F.explode_outer("delta").alias("e"))  # nodes without a difference stay, with a null
    counts = each.where("e is not null").groupBy("hub", "e").agg(F.count("*").alias("k"))
    own = each.join(counts, ["hub", "e"], "left").groupBy("hub", "node").agg(
        F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("k", "e")))).alias("own"))  # no longer than two texts
    return own.select("hub", "node", F.size("own").alias("d"), F.size(F.filter("own", lambda x: x["k"] > 1)).alias("q"), F.col("own.e").alias("own"))


def _possible_pairs(members: DataFrame, aside: DataFrame, hubs: DataFrame, away: DataFrame, percent: int) -> DataFrame:
    """(node, n, other, n_other) of crowded buckets that may link, for members outside their bucket's main component.

    Two members differ by what tells either from the hub, less twice what tells both from it. With the excess of a member (far times its
    difference from the hub less fit times its size), a link needs that the two share (sum of the excesses) / 2 far of their
    differences. Pairs that need none link for sure, and all of them with the member of least excess, so that one member is enough.
    All others share one of their rarest differences: prefixes that leave out the shared number less one are joined. Excesses
    fall into classes, so that a prefix is no longer than the other side's class asks for."""
    far, fit = 100 + percent, 100 - percent
    at = hubs.join(members.select("bucket").distinct(), "bucket", "left_semi")
    outside = aside.select("bucket", "node").join(at, "bucket").select("hub", "node").distinct().withColumn("out", F.lit(True))
    every = (members.select("bucket", "node", "n", "component").join(at, "bucket").select("hub", "node", "n", "component").distinct()
             .join(away.select("hub", "node", "d", "own"), ["hub", "node"]).join(outside, ["hub", "node"], "left"))
    excess = F.col("d") * far - F.col("n") * fit
    level = F.when(F.col("excess") <= 0, 0).otherwise(1 + F.floor(F.log2(F.col("excess") / far + 1)).cast("int"))
    every = step(every.select("hub", "node", "n", "component", "d", "own", F.coalesce("out", F.lit(False)).alias("out"), excess.alias("excess"))
                 .withColumn("level", level))
    least = every.groupBy("hub").agg(F.min(F.struct("excess", "node", "n", "component")).alias("low"), F.max("out").alias("any_out"))
    # either member of such a pair may be the one outside
    sure = (every.join(least, "hub").where(F.col("any_out") & (F.col("excess") + F.col("low.excess") <= 0) & (F.col("component") != F.col("low.component")))
            .select("node", "n", F.col("low.node").alias("other"), F.col("low.n").alias("n_other")))

    def prefixes(side: DataFrame, against: DataFrame, mine: str, theirs: str) -> DataFrame:
        levels = against.groupBy("hub", F.col("level").alias(theirs)).agg(F.min("excess").alias("low"))
        need = F.greatest(F.ceil((F.col("excess") + F.col("low")) / (2 * far)), F.lit(1)).cast("int")
        return (side.withColumnRenamed("level", mine).join(levels, "hub").withColumn("keep", F.col("d") - need + 1).where("keep > 0")
                .select("hub", mine, theirs, "node", "component", F.explode(F.slice("own", F.lit(1), F.col("keep"))).alias("e")))

    x = prefixes(every.where("out"), every, "lx", "ly")
    y = prefixes(every, every.where("out"), "ly", "lx").withColumnRenamed("node", "other").withColumnRenamed("component", "c_other")
    met = (x.join(y, ["hub", "lx", "ly", "e"]).where("component != c_other").select("hub", "node", "other").distinct())
    facts = every.select("hub", "node", "n", "own", "excess")
    both = (met.join(facts, ["hub", "node"])
            .join(facts.select("hub", F.col("node").alias("other"), F.col("n").alias("n_other"), F.col("own").alias("own_other"),
                               F.col("excess").alias("excess_other")), ["hub", "other"]))
    shared = F.size(F.array_intersect("own", "own_other"))
    return sure.unionByName(both.where(shared * (2 * far) >= F.col("excess") + F.col("excess_other")).select("node", "n", "other", "n_other"))


def _memberships(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, c, crowded, fine): who shares a bucket with whom; c: members of the bucket.

    A bucket of over ``CROWDED`` members (texts that share one common passage, say) stays, marked ``crowded``, and its members also meet in
    buckets of two bands, the band and one of the next three, marked ``fine``. These part texts with little in common, so most links are found there
    before the members of the crowded bucket are compared; they replace nothing."""
    def counted(m: DataFrame) -> DataFrame:
        return m.join(m.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "bucket")

    m = step(counted(nodes.select("node", "n", F.posexplode("buckets").alias("band", "bucket"))))
    crowded = (m.where(F.col("c") > CROWDED).groupBy("node", "n")
               .agg(F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("own")))  # a row per band at most
    two = F.flatten(F.transform("own", lambda x: F.transform(
        F.filter("own", lambda y: F.pmod(y["band"] - x["band"], F.lit(BANDS)).isin(1, 2, 3)),
        lambda y: F.xxhash64(x["band"], x["bucket"], y["band"], y["bucket"]))))
    fine = counted(crowded.select("node", "n", F.explode(two).alias("bucket")))
    cols = ["bucket", "node", "n", "c"]
    return step(m.select(*cols, (F.col("c") > CROWDED).alias("crowded"), F.lit(False).alias("fine")).unionByName(
        fine.select(*cols, F.lit(False).alias("crowded"), F.lit(True).alias("fine"))))


def _texts(docs: DataFrame, nodes: DataFrame, m: DataFrame) -> DataFrame:
    """(node, text) of the classes that share a bucket, from the document with the class's least id."""
    wanted = m.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    normal = F.trim(F.regexp_replace(lower_ascii(text_or_empty("text")), SPACE_CLASS, " "))
    key = F.unhex(F.md5(normal.cast("binary")))
    # the comparison of keys is no join key, so only rows that met are normalised; it tells texts under one id apart
    named = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("first_id")).where(F.coalesce(key == F.col("node"), F.lit(False)))
    nameless = docs.where("doc_id is null").select("text", key.alias("key")).join(wanted.where("first_id is null"), F.col("key") == F.col("node"))
    return step(named.select("node", "text").unionByName(nameless.groupBy("node").agg(F.first("text").alias("text"))))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    rows = step(sketches(docs, width))
    full = rows.where("key is not null")
    nodes = step(full.groupBy(F.col("key").alias("node")).agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("marks").alias("marks"),
        F.first("buckets").alias("buckets")))
    m = _memberships(nodes)
    close = (F.col("n") * 100 >= F.col("n_other") * percent) & (F.col("n_other") * 100 >= F.col("n") * percent)

    def pairs_of(df: DataFrame) -> DataFrame:
        return (df.where((F.col("node") != F.col("other")) & (close | (F.col("wide") == 2)))
                .groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.max("wide").alias("wide")))

    def check(pairs: DataFrame) -> DataFrame:
        return step(_verified(_agreeing(pairs, nodes), texts, width, percent))

    # (1) hub and, in larger buckets, a random member
    score = m.groupBy("node").agg(F.sum("c").alias("score"))
    picks = step(m.join(score, "node").groupBy("bucket").agg(
        F.max(F.struct("score", "node", "n")).alias("hub"),
        F.max(F.when(F.col("c") > FEW, F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(DRAWS))).alias("score"), "node", "n"))).alias("any")))
    hubs = picks.select("bucket", F.col("hub.node").alias("hub"))
    one = picks.select("bucket", F.col("hub.node").alias("hub"), F.inline(F.array_compact(F.array("hub", "any")))).select(
        "bucket", "hub", F.col("node").alias("other"), F.col("n").alias("n_other"))
    # in crowded buckets every member's difference from the hub is taken, since the bound of step (3) needs it
    wide = (F.when(F.col("crowded") & (F.col("other") == F.col("hub")), 2)
            .when(~F.col("crowded") & ~F.col("fine") & (F.col("c") > FEW), 1).otherwise(0))
    tested = step(pairs_of(m.join(one, "bucket").withColumn("wide", wide)))
    texts = _texts(docs, nodes, m)
    checked = check(tested)
    found = step(connected_components(checked.where("linked").select("a", "b")))
    # Buckets that still hold several components, each with its main one.
    away = step(_distances(checked, hubs))

    def mixed_buckets(which: str = "true") -> tuple[DataFrame, DataFrame]:
        """(members of mixed buckets, those outside the main component of their bucket)."""
        c = m.where("c > 2").where(which).join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
        sizes = c.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(
            F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        members = step(c.join(sizes, "bucket"))
        return members, members.where("component != main")

    def settle(pairs: DataFrame) -> None:
        nonlocal tested, found
        fresh = step(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = check(fresh).where("linked").select("a", "b")
        tested = tested.select("a", "b").unionByName(fresh.select("a", "b"))
        if not more.isEmpty():
            stars = found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = step(connected_components(stars.unionByName(more)))

    # (2) each outsider against one member of the main component, another one in every bucket
    members, aside = mixed_buckets()
    if not aside.isEmpty():
        pick = members.where("component = main").groupBy("bucket").agg(
            F.max(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "n")).alias("p")).select(
            "bucket", F.col("p.node").alias("other"), F.col("p.n").alias("n_other"))
        settle(pairs_of(aside.join(pick, "bucket").withColumn("wide", F.lit(0))))
    # (3) what is still outside against all other components, crowded buckets last
    members, aside = mixed_buckets("not crowded and not fine")
    if not aside.isEmpty():
        # What two nodes differ by is what tells either from the hub, less what tells both from it, and that
        # is no more than either has in common with anyone.
        far, fit = F.lit(100 + percent), F.lit(100 - percent)
        own = fit * F.col("n") - far * (F.col("d") - 2 * F.col("q"))
        demand = far * F.col("d") - fit * F.col("n")

        def known(df: DataFrame) -> DataFrame:
            return df.join(hubs, "bucket").join(away.drop("own"), ["hub", "node"], "left").select(
                "bucket", "node", "n", "component", own.alias("offer"), demand.alias("demand"))

        against = known(members).select("bucket", *[F.col(c).alias(d) for c, d in (
            ("node", "other"), ("n", "n_other"), ("component", "c_other"), ("offer", "offer_other"), ("demand", "demand_other"))])
        possible = F.coalesce((F.col("offer_other") >= F.col("demand")) & (F.col("offer") >= F.col("demand_other")), F.lit(True))
        settle(pairs_of(known(aside).join(against, "bucket").where((F.col("component") != F.col("c_other")) & close & possible).withColumn("wide", F.lit(0))))
    # pairs of a fine bucket are pairs of a crowded one, too
    members, aside = mixed_buckets("crowded")
    if not aside.isEmpty():
        settle(pairs_of(_possible_pairs(members, aside, hubs, away, percent).withColumn("wide", F.lit(0))))

    label = (nodes.join(found, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component")))
    named = label.join(label.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("node", "component_id")
    out = full.select("doc_id", "key", "n_shingles").join(named, F.col("key") == F.col("node")).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each group, all columns as they were. Rows with a null
    doc_id cannot be named and stay."""
    found = near_duplicates(docs, **options).where("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where("not _kept")
    return docs.join(gone.select("_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
