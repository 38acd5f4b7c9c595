"""Regression trees, forests and boosting on histograms: the options that Spark ML's trees lack (M5-M7).

Huber loss, leaf penalties (``reg_lambda``, ``reg_alpha``), least gain (``gamma``), ``num_leaves``, ``min_split_rows`` and
the Friedman criterion. Features are cut at quantiles once; a level of all trees grown together is one pass: every task adds up
count, gradient and curvature per (node, feature, bin), and for every node one task adds up these tables and keeps its best cut.
One row per node reaches the driver, and a tree has the size its limits allow, so nothing there grows with the rows.

Leaves are Newton steps ``-T(G) / (H + reg_lambda)`` with ``T`` the soft threshold at ``reg_alpha``; a cut needs a gain
``T(GL)^2/(HL+reg_lambda) + T(GR)^2/(HR+reg_lambda) - T(G)^2/(H+reg_lambda)`` of ``gamma`` at least. Huber trees follow the clipped residuals
(at the ``huber_quantile`` of their sizes); their leaves are the median plus the mean clipped distance from it.

``num_leaves`` gives the tree that splits the best leaf first, still level by level: best-first order takes splits by the least
gain on their path from the root, so a node whose path is not among the ``num_leaves - 1`` best so far can never be split.

Edge cases: rows without label or features are left out of a fit; a row without features has a null prediction; NaN goes right; without rows
a fit raises; a constant label gives trees of one leaf.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import ensure_checkpoint_dir

MAX_CELLS = 2_000_000  # (node, feature, bin) cells in a task; wider levels take several passes
MARGIN_EVERY = 4  # trees between written predictions of the training rows
SUMMED_BYTES = 32 << 20  # of histograms that one task adds up
_NOISE = 1e-10  # relative gain that rounding alone can give


@dataclass(frozen=True)
class TreeSpec:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int | None = None
    min_child_rows: int = 1
    min_child_weight: float = 0.0
    min_split_rows: int = 2
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    loss: str = "squared_error"  # or huber
    huber_quantile: float = 0.9
    criterion: str = "squared_error"  # or friedman_mse
    subsample: float = 1.0  # rows of a tree
    colsample: float = 1.0  # columns of a tree
    max_features: str | None = None  # columns of a node: sqrt, log2 or all
    forest: bool = False  # independent trees, averaged
    bootstrap: bool = False
    trees_per_pass: int = 10  # of a forest
    bins: int = 64
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("squared_error", "huber") or self.criterion not in ("squared_error", "friedman_mse"):
            raise ValueError(f"loss {self.loss!r}, criterion {self.criterion!r}")
        if self.loss == "huber" and (self.reg_lambda or self.reg_alpha or self.forest):
            raise ValueError("huber leaves are robust means: they take no penalties and belong to boosting")
        if self.max_depth < 1 or self.min_child_rows < 1 or not 2 <= self.bins <= 256 or (self.num_leaves or 2) < 2:
            raise ValueError("max_depth and min_child_rows are 1 at least, num_leaves 2, bins 2 to 256")


@dataclass
class _Tree:
    """Nodes in order of creation; ``feature`` -1 marks a leaf; bins up to ``cut`` go left."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))


def _leaf_of(tree: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(x), np.int64)
    while True:
        rows = np.flatnonzero(feature[at] >= 0)
        if not len(rows):
            return at
        here = at[rows]
        at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])


def _uniform(row: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A reproducible number in [0, 1) of every (row, tree)."""
    z = row.astype(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(float) / 2.0**53


_POISSON = np.cumsum([1, 1, 1 / 2, 1 / 6, 1 / 24, 1 / 120, 1 / 720, 1 / 5040, 1 / 40320]) / np.e


def _weights(row: np.ndarray, number: int, spec: TreeSpec) -> np.ndarray:
    if spec.bootstrap:
        return np.searchsorted(_POISSON, _uniform(row, number, spec.seed)).astype(float)
    if spec.subsample < 1:
        return (_uniform(row, number, spec.seed) < spec.subsample).astype(float)
    return np.ones(len(row))


# ---- training rows in blocks: first row's number, bins (a byte per feature), y, margin ----------------------------------------------------


def _edges(x: DataFrame, bins: int) -> list[np.ndarray]:
    """Cut points of every feature: its distinct quantiles without the greatest. One row per feature reaches the driver."""
    probs = [k / bins for k in range(1, bins + 1)]
    long = x.select(F.posexplode("x").alias("feature", "v")).where(~F.isnan("v"))
    got = long.groupBy("feature").agg(F.percentile_approx("v", probs, 100 * bins).alias("e")).collect()
    width = x.select(F.max(F.size("x"))).first()[0]
    out = [np.empty(0)] * width
    for r in got:
        out[r["feature"]] = np.unique(r["e"])[:-1]
    return out


def _stored(blocks: DataFrame) -> tuple[DataFrame, str]:
    """The blocks as files in the shared checkpoint folder, and where: a later state takes their place, so they are deleted then."""
    spark = blocks.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "trees", uuid.uuid4().hex)
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path), path


def _spread(rows: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Few rows come in few files, which would leave cores idle in every pass: their blocks are dealt out to all of them."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:
        old, (rows, path) = path, _stored(rows.repartition(cores))
        _forget(spark, old)
    return rows, path


def _forget(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _block(first: int, bins: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in (bins, y, margin)]],
                                      names=["first", "bins", "y", "margin"])


def _binned(x: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows, one record each: a pass then costs what is done with the rows, not their way through records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cells = np.stack([np.searchsorted(e, m[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint8)
                # the numbers of a batch follow one another
                yield _block(b.column(0)[0].as_py(), cells, b.column(2).to_numpy(zero_copy_only=False), np.full(b.num_rows, base))

    numbered = x.select(F.monotonically_increasing_id().alias("row"), "x", "y")
    return numbered.mapInArrow(run, "first long, bins binary, y binary, margin binary")


def _read(batches: Iterator[pa.RecordBatch], done: Sequence, rate: float):
    """(row, bins, y, margin with the trees ``done`` added) of every block."""
    for b in batches:
        for k in range(b.num_rows):
            first, bins, y, margin = (b.column(c)[k].as_py() if not c else b.column(c)[k].as_buffer() for c in range(4))
            y, margin = np.frombuffer(y), np.frombuffer(margin)
            bins = np.frombuffer(bins, np.uint8).reshape(len(y), -1)
            if done:
                margin = margin + rate * sum(tree[4][_leaf_of(tree, bins)] for tree in done)
            yield np.arange(first, first + len(y)), bins, y, margin


def _with_margin(rows: DataFrame, done: Sequence, rate: float) -> DataFrame:
    def run(batches):
        for row, bins, y, margin in _read(batches, done, rate):
            yield _block(int(row[0]), bins, y, margin)

    return rows.mapInArrow(run, rows.schema)


def _residuals(rows: DataFrame, done: Sequence, rate: float, tree: Sequence | None, number: int, spec: TreeSpec) -> DataFrame:
    """(leaf, r) of the rows that take part in a tree; leaf 0 without a tree."""
    def run(batches):
        for row, bins, y, margin in _read(batches, done, rate):
            used = _weights(row, number, spec) > 0
            leaf = _leaf_of(tree, bins) if tree is not None else np.zeros(len(y), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[used]), pa.array((y - margin)[used])], names=["leaf", "r"])

    return rows.mapInArrow(run, "leaf long, r double")


# ---- one level ------------------------------------------------------------------------------------------------


def _histograms(rows: DataFrame, done: Sequence, growing: list, nodes: list[tuple[int, int]], numbers: Sequence[int],
                delta: float | None, spec: TreeSpec, width: int, bins: int) -> DataFrame:
    """(node, v) of the ``nodes`` (tree, node of it) in every task; node is the place in that list, v the doubles
    [feature, (n, g, h), bin]."""
    slots = [np.full(len(t[0]), -1) for t in growing]
    for k, (t, node) in enumerate(nodes):
        slots[t][node] = k
    size, rate = len(nodes) * bins, spec.learning_rate
    weighted = spec.bootstrap or spec.subsample < 1

    def run(batches):
        total = np.zeros((width, 3, size))
        for row, x, y, margin in _read(batches, done, rate):
            g = margin - y if delta is None else np.clip(margin - y, -delta, delta)
            for t, tree in enumerate(growing):
                slot = slots[t][_leaf_of(tree, x)]
                w = _weights(row, numbers[t], spec) if weighted else None
                used = np.flatnonzero(slot >= 0 if w is None else (slot >= 0) & (w > 0))
                if not len(used):
                    continue
                every = len(used) == len(slot)
                at, wg = (slot if every else slot[used]) * bins, g if every else g[used]
                columns = np.ascontiguousarray((x if every else x[used]).T)
                if w is not None:
                    w = w[used]
                    wg = w * wg
                for f in range(width):
                    cell = at + columns[f]
                    n = np.bincount(cell, minlength=size)
                    total[f, 0] += n
                    total[f, 1] += np.bincount(cell, wg, size)
                    total[f, 2] += n if w is None else np.bincount(cell, w, size)
        total = total.reshape(width, 3, len(nodes), bins)
        for k in np.flatnonzero(total[0, 0].any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[:, :, k].tobytes()], pa.binary())], names=["node", "v"])

    return rows.mapInArrow(run, "node int, v binary")


def _best_cut(v: np.ndarray, allowed: np.ndarray, spec: TreeSpec) -> tuple[list[float], list | None]:
    """Totals of a node and its cut (feature, bin, gain, nl, gl, hl) of the greatest gain; ties: least feature, least bin."""
    places = np.flatnonzero(allowed)
    nl, gl, hl = np.moveaxis(np.cumsum(v[places], axis=2), 1, 0)
    n, g, h = (c[:, -1:] for c in (nl, gl, hl))

    def score(g, h):
        soft, below = np.maximum(np.abs(g) - spec.reg_alpha, 0.0), h + spec.reg_lambda
        return np.divide(soft * soft, below, out=np.zeros_like(soft), where=below != 0)

    def ratio(a, b):
        return np.divide(a, b, out=np.full_like(a, np.nan), where=b != 0)

    parts = score(gl, hl) + score(g - gl, h - hl)
    if spec.criterion == "friedman_mse":
        gain = ratio(hl * (h - hl), h + np.zeros_like(hl)) * (ratio(gl, hl) - ratio(g - gl, h - hl)) ** 2
    else:
        gain = parts - score(g, h)
    fits = ((nl >= spec.min_child_rows) & (n - nl >= spec.min_child_rows) & (hl >= spec.min_child_weight) & (h - hl >= spec.min_child_weight)
            & (n >= spec.min_split_rows) & (gain >= spec.gamma) & (gain > _NOISE * parts))
    best = np.where(fits, gain, -np.inf).argmax()
    f, b = np.unravel_index(best, fits.shape)
    total = [float(c[0, 0]) for c in (n, g, h)]
    return total, [int(places[f]), int(b), *[float(c[f, b]) for c in (gain, nl, gl, hl)]] if fits[f, b] else None


def _best_cuts(hist: DataFrame, files: int, allowed: np.ndarray, spec: TreeSpec, bins: int) -> list:
    """One row per node: totals and best cut (nulls without one). A node's histograms are added up by one task, nodes by as many
    as the tables of some ``files`` tasks call for."""
    width = allowed.shape[1]

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                node, v = b.column(0)[k].as_py(), np.frombuffer(b.column(1)[k].as_buffer())
                if node in total:
                    total[node] += v
                else:
                    total[node] = v.copy()
        for node, v in total.items():
            whole, cut = _best_cut(v.reshape(width, 3, bins), allowed[node], spec)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [node, *whole, *(cut or [None] * 6)]))], schema=schema)

    schema = pa.schema([("node", pa.int32()), *[(c, pa.float64()) for c in ("n", "g", "h")], ("feature", pa.int32()), ("bin", pa.int32()),
                        *[(c, pa.float64()) for c in ("gain", "nl", "gl", "hl")]])
    parts = max(1, min(len(allowed), allowed.size * bins * 24 * files // SUMMED_BYTES))
    return hist.repartition(parts, "node").mapInArrow(
        run, "node int, n double, g double, h double, feature int, bin int, gain double, nl double, gl double, hl double").collect()


def _features_of(spec: TreeSpec, number: int, node: int, width: int) -> np.ndarray:
    """Columns that a node may use: those of its tree, then those of the node."""
    mask = np.ones(width, bool)
    if spec.colsample < 1:
        keep = max(1, int(spec.colsample * width))
        mask[np.random.default_rng((spec.seed, number)).permutation(width)[keep:]] = False
    if spec.max_features in ("sqrt", "log2"):
        left = np.flatnonzero(mask)
        keep = max(1, int(np.sqrt(len(left)) if spec.max_features == "sqrt" else np.log2(len(left))))
        mask[np.random.default_rng((spec.seed, number, node + 1)).permutation(left)[keep:]] = False
    return mask


def _leaf_value(g: float, h: float, spec: TreeSpec) -> float:
    below = h + spec.reg_lambda
    return -np.sign(g) * max(abs(g) - spec.reg_alpha, 0.0) / below if below > 0 else 0.0


def _grow(rows: DataFrame, done: Sequence, numbers: Sequence[int], width: int, bins: int, delta: float | None, spec: TreeSpec) -> list[_Tree]:
    trees = [_Tree() for _ in numbers]
    path: list[dict[int, float]] = [{0: np.inf} for _ in numbers]  # least gain on the way to a node
    split: list[dict[int, float]] = [{} for _ in numbers]  # least gain up to and with a node's own cut
    level = [(t, 0) for t in range(len(numbers))]
    per_pass, files = max(1, MAX_CELLS // (width * bins)), len(rows.inputFiles())
    for _ in range(spec.max_depth):
        cuts = {}
        for k in range(0, len(level), per_pass):
            nodes = level[k:k + per_pass]
            allowed = np.stack([_features_of(spec, numbers[t], node, width) for t, node in nodes])
            hist = _histograms(rows, done, [t.arrays() for t in trees], nodes, numbers, delta, spec, width, bins)
            cuts.update({nodes[r["node"]]: r for r in _best_cuts(hist, files, allowed, spec, bins)})
        fresh = []
        for t, node in level:
            r = cuts.get((t, node))
            if r is None:
                continue
            if node == 0:
                trees[t].value[0] = _leaf_value(r["g"], r["h"], spec)
            if r["feature"] is not None:
                split[t][node] = min(path[t][node], r["gain"])
                fresh.append((t, node, r))
        if spec.num_leaves:  # parents stand before their children in ties
            live = [set(sorted(s, key=lambda n: (-s[n], n))[:spec.num_leaves - 1]) for s in split]
            fresh = [(t, node, r) for t, node, r in fresh if node in live[t]]
        level = []
        for t, node, r in fresh:
            tree = trees[t]
            tree.feature[node], tree.cut[node] = r["feature"], r["bin"]
            for side, g, h in (("left", r["gl"], r["hl"]), ("right", r["g"] - r["gl"], r["h"] - r["hl"])):
                child = tree.add()
                getattr(tree, side)[node] = child
                tree.value[child], path[t][child] = _leaf_value(g, h, spec), split[t][node]
                level.append((t, child))
        if not level:
            break
    if spec.num_leaves:
        for tree, s in zip(trees, split):
            kept = set(sorted(s, key=lambda n: (-s[n], n))[:spec.num_leaves - 1])
            tree.feature = [f if n in kept else -1 for n, f in enumerate(tree.feature)]
    return trees


def _huber_leaves(rows: DataFrame, done: Sequence, tree: _Tree, number: int, delta: float, spec: TreeSpec) -> None:
    r = _residuals(rows, done, spec.learning_rate, tree.arrays(), number, spec)
    middle = r.groupBy("leaf").agg(F.percentile_approx("r", 0.5, 10_000).alias("m"))
    d = F.col("r") - F.col("m")
    # a row per leaf, bounded by the tree's limits
    found = (r.join(F.broadcast(middle), "leaf").groupBy("leaf")
             .agg((F.first("m") + F.avg(F.least(F.greatest(d, F.lit(-delta)), F.lit(delta)))).alias("v")).collect())
    for f in found:
        tree.value[f["leaf"]] = f["v"]


# ---- estimator and model ----------------------------------------------------------------------------------------


class HistTreeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a pipeline stage; saved and read with Spark's writer."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "base, rate and trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol: str = "features", trees: str = '{"base": 0.0, "rate": 1.0, "trees": []}'):
        super().__init__()
        self._set(**self._input_kwargs)

    def tables(self) -> list[dict[str, list]]:
        return json.loads(self.getOrDefault("trees"))["trees"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault("trees"))

        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = json.loads(spec.value)
            trees = [tuple(np.array(t[k]) for k in ("feature", "cut", "left", "right", "value")) for t in model["trees"]]
            for s in parts:
                out, there = np.full(len(s), np.nan), s.notna().to_numpy()
                if there.any():
                    x = np.stack(s[there].to_list()).astype(float)
                    out[there] = model["base"] + model["rate"] * sum((t[4][_leaf_of(t, x)] for t in trees), np.zeros(len(x)))
                yield pd.Series(out)

        name = self.getOrDefault("featuresCol")
        col = F.when(F.col(name).isNotNull(), vector_to_array(F.col(name)))
        p = F.pandas_udf(score, "double")(col)
        return dataset.withColumn("prediction", F.when(F.col(name).isNotNull(), p))


@dataclass(frozen=True)
class HistTreeRegressor:
    spec: TreeSpec
    features: str = "features"
    label: str = "label"

    def fit(self, data: DataFrame) -> HistTreeModel:
        spec = self.spec
        x = (data.where(F.col(self.features).isNotNull() & F.col(self.label).isNotNull())
             .select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).cast("double").alias("y")))
        centre = F.percentile_approx("y", 0.5, 10_000) if spec.loss == "huber" else F.avg("y")
        base = x.agg(centre).first()[0]
        if base is None:
            raise ValueError("no row with features and a label")
        edges = _edges(x, spec.bins)
        if not edges:
            raise ValueError("no features")
        (rows, path), width, bins = _spread(*_stored(_binned(x, edges, base))), len(edges), max(len(e) for e in edges) + 1
        trees: list[_Tree] = []
        done: list[tuple[np.ndarray, ...]] = []
        at_once = spec.trees_per_pass if spec.forest else 1
        while len(trees) < spec.n_estimators:
            numbers = range(len(trees), min(len(trees) + at_once, spec.n_estimators))
            delta = None
            if spec.loss == "huber":
                r = _residuals(rows, done, spec.learning_rate, None, numbers[0], spec)
                delta = r.agg(F.percentile_approx(F.abs("r"), spec.huber_quantile, 10_000)).first()[0] or 0.0
            grown = _grow(rows, done, numbers, width, bins, delta, spec)
            if delta is not None:
                _huber_leaves(rows, done, grown[0], numbers[0], delta, spec)
            trees += grown
            if not spec.forest:
                done += [t.arrays() for t in grown]
                if len(done) >= MARGIN_EVERY and len(trees) < spec.n_estimators:
                    old = path
                    (rows, path), done = _stored(_with_margin(rows, done, spec.learning_rate)), []
                    _forget(data.sparkSession, old)
        _forget(data.sparkSession, path)
        out = []
        for t in trees:
            table = asdict(t)
            table["cut"] = [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
            out.append({k: [float(v) if k in ("cut", "value") else int(v) for v in column] for k, column in table.items()})
        rate = 1.0 / spec.n_estimators if spec.forest else spec.learning_rate
        return HistTreeModel(featuresCol=self.features, trees=json.dumps({"base": float(base), "rate": rate, "trees": out}))
