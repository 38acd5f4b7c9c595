"""Conversation prefix trie: padded turn-id matrices, column change masks, aggregates of every depth.

Conversations are dealt out by ranges of (turn ids, conversation id), so a node's members are neighbours. A shard becomes a matrix with one
row per conversation and one column per turn, padded behind the last turn; numpy's lexsort orders it, and OR-accumulating the mask of
columns that differ from the row above marks where the nodes of every depth start. ``reduceat`` over these starts gives each node's members,
children, leaves and saved text. Nodes that reach over a shard's border leave it as partial rows, which are added up by node; the first
and last row of the neighbouring shards tell a shard which nodes started before it or go on after it, so that every node is counted once.

Long conversations are cut into blocks of ``width`` turns; a block's rows are told apart by the hash of all turns before. What a conversation's later
blocks add to the nodes of earlier ones is added to its rows first.

Scale: texts leave the job at the scan as 128-bit turn ids and lengths. Positions within a conversation come from one range sort, which
splits a conversation with very many turns over tasks; a shard holds a bounded number of block rows; equal sequences are told apart by the
conversation id, so a conversation copied very often fills several shards. The driver sees two numbers per shard. The members that
end at a node are hashed as one stream of pieces, a shard's part each.

Edge cases: turns are ordered by turn (null first), then by a hash of role and text; null role or text is empty; repeated rows are turns of
their own; rows with a null conv_id belong to no conversation and are ignored, other columns, too; conversations without rebuilt turns are members of
the root; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows, step

WIDTH = 64  # turns in a block
SHARD_ROWS = 40_000  # block rows in a shard
_U = np.uint64
NODE = ("hi long, lo long, depth long, up_hi long, up_lo long, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends string, split boolean")

_ARROW = pa.schema([(a, {"string": pa.string(), "boolean": pa.bool_()}.get(t, pa.int64())) for a, t in (f.split() for f in NODE.split(", "))])


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6)).cast("int")


def first_of_hundred(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id, chars) of the table's own turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"), F.length(text).alias("chars"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (turns.repartitionByRange(parts, "conv_id", F.asc_nulls_first("turn"), "id")
              .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            c = batch.column(1).to_numpy()
            if not len(c):
                continue
            starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            pos = np.arange(1, len(c) + 1) - np.repeat(starts, np.diff(np.append(starts, len(c))))
            if last == c[0]:
                pos[:starts[1] if len(starts) > 1 else len(c)] += seen
            last, seen = c[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4)), pa.array(pos, pa.int64())],
                                             names=["pid", "conv_id", "id", "chars", "pos"])

    numbered = step(map_rows(placed.select(F.spark_partition_id().alias("pid"), "conv_id", "turn", "id", "chars"), run,
                             "pid int, conv_id long, id binary, chars int, pos long"))
    # a conversation that began in an earlier part of the range: at most one for each part
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = (numbered.groupBy("conv_id", "pid").agg(F.max("pos").alias("n"))
               .withColumn("offset", F.sum("n").over(before)).where("offset is not null").select("conv_id", "pid", "offset"))
    return numbered.join(F.broadcast(carried), ["conv_id", "pid"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"), "id", "chars")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, n: rebuilt turns) of every conversation, (conv_id, pos, id, chars) of the rebuilt turns)."""
    turns = step(_turns(conversations))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", first_of_hundred(F.col("conv_id")))
    lead = own.where("conv_id = base").select("base", F.least("own", F.lit(5)).alias("n_base"))
    taken = F.least(F.coalesce("n_base", F.lit(0)), shared_turns(F.col("conv_id")))
    convs = step(own.join(lead, "base", "left").select(
        "conv_id", "base", taken.cast("long").alias("taken"), shared_turns(F.col("conv_id")).alias("h"),
        (taken + F.greatest(F.col("own") - shared_turns(F.col("conv_id")), F.lit(0))).cast("long").alias("n")))
    first = turns.where("pos <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    from_base = convs.join(first, "base").where("pos <= taken").select("conv_id", "pos", "id", "chars")
    from_own = (turns.where(F.col("pos") > shared_turns(F.col("conv_id"))).join(convs.select("conv_id", "taken", "h"), "conv_id")
                .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "chars"))
    return convs.select("conv_id", "n"), from_base.unionByName(from_own)


# ---- node names: a running XOR of the turn ids, each mixed with its depth -----------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tags(ids: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """(rows, 2) words from (rows, 2) words of turn ids and their depths."""
    d = depth.astype(_U)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], _U)
    return _mix(ids ^ _mix(d))


def _words(ids: pa.Array) -> np.ndarray:
    """(rows, 2) words of 16-byte ids; their order is that of the bytes."""
    return np.frombuffer(b"".join(ids.to_pylist()), ">u8").reshape(-1, 2).astype(_U)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers, in the order of the rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """((k, hi, lo, ids, more, conv_id, chars, rest_leaves, rest_saved) per conversation and block, last k); hi, lo name the turns before the block."""
    k = F.floor((F.col("pos") - 1) / width).cast("int").alias("k")
    rows = step(turns.groupBy("conv_id", k).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("t"))
                .join(convs, "conv_id").select("conv_id", "k", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"),
                                               (F.col("n") > (F.col("k") + 1) * width).alias("more")))
    last = rows.agg(F.max("k")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            n = np.diff(ids.offsets.to_numpy())
            depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(batch.column(1).to_numpy().astype(np.int64) * width, n) + 1
            x = np.bitwise_xor.reduceat(_tags(_words(ids.flatten()), depth), np.cumsum(n) - n, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["conv_id", "k", "x", "y"])

    zero = F.lit(0).cast("long")
    if not last:
        named = rows.select("*", zero.alias("hi"), zero.alias("lo"))
    else:
        before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        names = map_rows(rows.select("conv_id", "k", "ids"), run, "conv_id long, k int, x long, y long")
        names = names.select("conv_id", "k", *[F.coalesce(F.bit_xor(a).over(before), zero).alias(b) for a, b in (("x", "hi"), ("y", "lo"))])
        named = rows.join(names, ["conv_id", "k"])
    return named.select("k", "hi", "lo", "ids", "more", "conv_id", "chars", zero.alias("rest_leaves"), zero.alias("rest_saved")), last


ORDER = ["k", "hi", "lo", "ids", "more", "conv_id"]


def _sharded(blocks: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(blocks by ranges of ORDER with their shard, {shard: columns that its first row has in common with the row before it, its last row with the
    row after it}); the turns before the block are column 0, and -1 means that they differ."""
    shards = max(1, -(-blocks.count() // shard_rows))
    placed = step(blocks.repartitionByRange(shards, *ORDER).select(F.spark_partition_id().alias("shard"), "*"))
    row = F.struct(*ORDER)
    ends = placed.groupBy("shard").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    by = Window.orderBy("shard")
    ends = ends.select("shard", "a", "b", F.lag("b").over(by).alias("before"), F.lead("a").over(by).alias("after"))

    def common(x: str, y: str) -> Column:
        x, y = F.col(x), F.col(y)
        same = F.zip_with(x["ids"], y["ids"], lambda p, q: F.coalesce(p == q, F.lit(False)))
        at = F.array_position(same, False)
        together = (x["k"] == y["k"]) & (x["hi"] == y["hi"]) & (x["lo"] == y["lo"])
        return F.when(together, F.when(at == 0, F.size(x["ids"])).otherwise(at - 1)).otherwise(-1)

    found = ends.select("shard", F.coalesce(common("before", "a"), F.lit(-1)).alias("up"), F.coalesce(common("b", "after"), F.lit(-1)).alias("down"))
    return placed, {r["shard"]: (r["up"], r["down"]) for r in found.collect()}


def _shard(batches: Iterator[pa.RecordBatch], width: int, neighbours: dict[int, tuple[int, int]]):
    """The sorted matrix of a shard with its masks, or None for an empty one."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    table = pa.Table.from_batches(got).combine_chunks()
    get = {c: table.column(c).chunk(0) for c in table.column_names}
    num = {c: get[c].to_numpy(zero_copy_only=False) for c in ("k", "hi", "lo", "more", "conv_id", "rest_leaves", "rest_saved")}
    n = np.diff(get["ids"].offsets.to_numpy())
    rows, cols = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    words = _words(get["ids"].flatten())
    high = int(n.max())
    # ids of the shard's turns and of what lies before the blocks, in the order of their bytes or numbers
    m = np.full((len(n), high + 1), -1, np.int64)
    m[rows, cols] = _ranks(words[:, 0], words[:, 1])
    m[:, 0] = _ranks(num["k"], num["hi"], num["lo"])
    depth = num["k"][rows].astype(np.int64) * width + cols
    order = np.lexsort((num["conv_id"], num["more"], *m.T[::-1]))
    rows = np.argsort(order)[rows]
    m, n = m[order], n[order]
    num = {c: v[order] for c, v in num.items()}
    chars = np.zeros(m.shape, np.int64)
    chars[rows, cols] = get["chars"].flatten().to_numpy()
    tags = np.zeros((*m.shape, 2), _U)
    tags[rows, cols] = _tags(words, depth)
    tags[:, 0, 0], tags[:, 0, 1] = num["hi"].astype(np.int64).view(_U), num["lo"].astype(np.int64).view(_U)
    names = np.bitwise_xor.accumulate(tags, axis=1).view(np.int64)
    up, down = neighbours[get["shard"][0].as_py()]
    new = np.ones((len(m) + 1, high + 1), bool)  # a node's rows end above such a row; the last line is the border below
    new[1:-1] = np.logical_or.accumulate(m[1:] != m[:-1], axis=1)
    new[0], new[-1] = np.arange(high + 1) > up, np.arange(high + 1) > down
    starts = new[:-1] & (m >= 0)
    # the last of equal rows is a leaf unless the next row goes on from it
    leaf = ~num["more"].astype(bool) & new[1:][np.arange(len(m)), n]
    gains = np.where(starts, 0, chars)
    return m, n, num, names, new, starts, leaf, gains, up, down


def _own_gains(blocks: DataFrame, width: int, neighbours: dict) -> DataFrame:
    """(conv_id, k, leaves, saved) of each block row by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _shard(batches, width, neighbours)
        if got is not None:
            _, _, num, _, _, _, leaf, gains, _, _ = got
            yield pa.RecordBatch.from_arrays([pa.array(num["conv_id"]), pa.array(num["k"]), pa.array(leaf.astype(np.int64)), pa.array(gains.sum(axis=1))],
                                             names=["conv_id", "k", "leaves", "saved"])

    return map_rows(blocks, run, "conv_id long, k int, leaves long, saved long")


def _nodes(blocks: DataFrame, width: int, neighbours: dict, root_conv: int) -> DataFrame:
    """NODE rows of every shard; nodes that may have rows elsewhere are marked ``split``, others are whole and have the digest of their ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _shard(batches, width, neighbours)
        if got is None:
            return
        m, n, num, names, new, starts, leaf, gains, up, down = got
        size, high = len(m), m.shape[1] - 1
        more, conv, k = num["more"].astype(bool), num["conv_id"], num["k"].astype(np.int64)
        leaves = leaf + num["rest_leaves"]
        saved = np.cumsum(gains[:, ::-1], axis=1)[:, ::-1] + num["rest_saved"][:, None]
        parents = parents_split = first_row = None
        for j in range(high + 1):
            edge = new[:-1, j].copy()
            edge[0] = True  # also where the node began in the shard before
            at = np.flatnonzero(edge)
            until = np.append(at[1:], size)
            here = m[at, j] >= 0
            members = until - at
            least = np.minimum.reduceat(conv, at)
            children = np.add.reduceat(starts[:, j + 1], at) if j < high else np.zeros(len(at), np.int64)
            split = (((at == 0) & (j <= up)) | ((until == size) & (j <= down)))
            if j == width:
                split |= np.logical_or.reduceat(more, at)
            if j == 0:  # the node before the block: the root, or one whose other rows lie in the block before
                split[:] = True
                members, least = np.where(k[at] == 0, members, 0), np.where(k[at] == 0, least, np.iinfo(np.int64).max)
            # members that end here stand first among the node's rows
            done = np.add.reduceat((n == j) & ~more, at) if j else np.zeros(len(at), np.int64)
            ends = []
            for a, d, s, h in zip(at.tolist(), done.tolist(), split.tolist(), here.tolist()):
                text = ",".join(map(str, conv[a:a + d].tolist())) if h else None
                ends.append(text if s or text is None else hashlib.sha256(text.encode()).hexdigest())
            lacking = np.zeros(len(at), bool)
            if j:
                held = np.searchsorted(first_row, at, "right") - 1  # the parent's rows hold the node's
                above, lacking = parents[held], parents_split[held]
                if j == 1:
                    above, lacking = np.where(k[at] == 0, root_conv, above), lacking & (k[at] != 0)
            else:
                above, lacking = least, np.ones(len(at), bool)
            inside = k[at] == 0 if j == 0 else np.ones(len(at), bool)
            cols = [pa.array(names[at, j, 0]), pa.array(names[at, j, 1]), pa.array(k[at] * width + j),
                    pa.array(names[at, max(j - 1, 0), 0]), pa.array(names[at, max(j - 1, 0), 1]), pa.array(above, pa.int64(), mask=lacking),
                    pa.array(least, pa.int64(), mask=~inside), pa.array(members, pa.int64()), pa.array(children, pa.int64()),
                    pa.array(np.where(inside, np.add.reduceat(leaves, at), 0)), pa.array(np.where(inside, np.add.reduceat(saved[:, j], at), 0)),
                    pa.array(ends, pa.string()), pa.array(split)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(here)) for c in cols], names=_ARROW.names)
            parents, parents_split, first_row = least, split, at

    return map_rows(blocks, run, NODE)


def _recombined(parts: DataFrame) -> DataFrame:
    """One row per node from its partial rows; the pieces of its ends are hashed in the order of their conversations."""
    ordered = (parts.withColumn("at", F.split("ends", ",", 2)[0].try_cast("long"))
               .repartition("hi", "lo", "depth").sortWithinPartitions("hi", "lo", "depth", "at"))
    names = _ARROW.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, digest, some = None, None, None, False

        def row() -> pa.RecordBatch:
            state["ends"] = digest.hexdigest()
            return pa.RecordBatch.from_pylist([state], schema=_ARROW)

        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(i)[r].as_py() for i, c in enumerate(names)}
                key = x["hi"], x["lo"], x["depth"]
                if key != now:
                    if now is not None:
                        yield row()
                    now, state, digest, some = key, dict(x), hashlib.sha256(), False
                else:
                    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        state[c] += x[c]
                    for c in ("conv_id", "parent_conv_id"):
                        state[c] = min((v for v in (state[c], x[c]) if v is not None), default=None)
                    if x["n_convs"]:  # a row from the block after does not know the node's parent
                        state["up_hi"], state["up_lo"] = x["up_hi"], x["up_lo"]
                if x["ends"]:
                    digest.update(("," if some else "").encode() + x["ends"].encode())
                    some = True
        if now is not None:
            yield row()

    return map_rows(ordered.select(*names), run, NODE)


def _turnless(convs: DataFrame) -> DataFrame:
    """Partial rows of the root for conversations without turns, in pieces by ranges of their ids."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = convs.where("n = 0").select("conv_id").repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_pylist()
            if c:
                yield pa.RecordBatch.from_pylist([{"hi": 0, "lo": 0, "depth": 0, "up_hi": 0, "up_lo": 0, "parent_conv_id": None, "conv_id": c[0], "n_convs": len(c),
                                                   "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends": ",".join(map(str, c)), "split": True}], schema=_ARROW)

    return map_rows(ids, run, NODE)


def trie(conversations: DataFrame, *, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text."""
    convs, turns = rebuilt_turns(conversations)
    root_conv = convs.agg(F.min("conv_id")).first()[0]
    blocks, last = _blocks(turns, convs, width)
    placed, neighbours = _sharded(blocks, shard_rows)
    if last:
        gains = _own_gains(placed, width, neighbours)
        later = Window.partitionBy("conv_id").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
        rest = step(gains.select("conv_id", "k", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"rest_{c}") for c in ("leaves", "saved")]))
        placed, neighbours = _sharded(placed.drop("shard", "rest_leaves", "rest_saved").join(rest, ["conv_id", "k"]).select(blocks.columns), shard_rows)
    rows = step(_nodes(placed, width, neighbours, root_conv or 0))
    whole = rows.where("not split")
    joined = step(_recombined(rows.where("split").unionByName(_turnless(convs))))
    nodes = whole.unionByName(joined)
    tops = joined.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up"))
    lacking = F.col("parent_conv_id").isNull() & (F.col("depth") > 0)
    filled = nodes.where(lacking).join(tops, ["up_hi", "up_lo", "depth"]).withColumn("parent_conv_id", F.col("_up")).drop("_up")
    out = reduce(DataFrame.unionByName, [nodes.where(~lacking), filled.select(nodes.columns)])
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
                      F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens", F.col("ends").alias("ends_sha256"))
