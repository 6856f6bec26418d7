"""Random forests over quantile bins (M1) that know which rows each tree drew.

Spark's own forest keeps no bags and has no least size of a node to be split. Here the number of times that a tree draws a
row is a Poisson(1) number read off a hash of (row key, tree, seed). Any task, and any later job, finds the same bag
from the key alone, so nothing is stored for each row and tree, and a lost executor changes nothing. The out-of-bag score of a
row is the mean of the trees that did not draw it.

* Rows are binned once and kept as packed, cached blocks (bins, label, key), as in :mod:`.boosting`.
* Open nodes of all trees wait in one queue. One job takes as many as fit ``histogram_mb`` and counts, in each task, the rows
  of its blocks by (node, feature, bin): rows of the bag, and draws of either class. One shuffle on (node, feature) adds the
  counts and finds the feature's best split; the driver sees one row for each node and feature of the job. All counts are whole
  numbers, and class weights are applied to the sums: neither tasks nor their order change a tree.
* A node draws its features by its place in its tree, so a model depends on the seed only.

Cases. Rows without a key column are named by a hash of their values and their place in a block; their bags then change with the
partitioning, and :meth:`HistogramForestModel.out_of_bag` needs a key. Rows with equal keys share their bags. A null key is key 0.
A row that every tree drew has no out-of-bag score and counts in none. Of equally good splits the first feature, then the first cut wins.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, persist_adaptive, ship_package
from .boosting import _NODES, BLOCK_ROWS, HistogramBoostedModel, bin_edges, margins

_BLOCK = "rows int, bins binary, label binary, key binary"
_SPLIT = "slot int, feature int, bin int, gain double, n long, c0 long, c1 long, ln long, l0 long, l1 long"
# --- fixed values: the 32-bit finalizer of MurmurHash3 and the step between trees ---
MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))
TREE_STEP = 0x9E3779B9
#: The n-th limit is 2^32 times the chance of at most n draws; a hash is a draw more for each limit that it reaches.
POISSON_LIMITS = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(12)]


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return x


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often ``tree`` draws each row: Poisson(1) by a hash of the 64-bit key."""
    k = key.astype("i8").view(np.uint64)
    low, high = k & np.uint64(0xFFFFFFFF), k >> np.uint64(32)
    start = np.uint64((seed + (tree + 1) * TREE_STEP) & 0xFFFFFFFF)
    h = _mix(_mix(low + start & np.uint64(0xFFFFFFFF)) ^ high)
    return np.searchsorted(np.array(POISSON_LIMITS, np.uint64), h, side="right")


def impurity(w0: np.ndarray, w1: np.ndarray, kind: str) -> np.ndarray:
    """Impurity of nodes with these class weights, times their weight."""
    w = w0 + w1
    with np.errstate(all="ignore"):
        p = np.where(w > 0, w1 / w, 0.0)
        if kind == "gini":
            return w * 2 * p * (1 - p)
        return -w * (np.where(p > 0, p * np.log2(p), 0.0) + np.where(p < 1, (1 - p) * np.log2(1 - p), 0.0))


def best_split(n: np.ndarray, c0: np.ndarray, c1: np.ndarray, weights: tuple[float, float], kind: str, least: int) -> tuple:
    """Last bin on the left, decrease of impurity, and counts on the left, for one feature's bins; -inf where none is allowed."""
    ln, l0, l1 = (np.cumsum(v)[:-1] for v in (n, c0, c1))
    if not len(ln):
        return -1, -np.inf, 0, 0, 0
    a, b = weights
    whole = impurity(np.float64(a * c0.sum()), np.float64(b * c1.sum()), kind)
    gain = whole - impurity(a * l0, b * l1, kind) - impurity(a * (c0.sum() - l0), b * (c1.sum() - l1), kind)
    gain = np.where((ln >= least) & (n.sum() - ln >= least), gain, -np.inf)
    i = int(np.argmax(np.round(gain, 9)))
    return i, float(gain[i]), int(ln[i]), int(l0[i]), int(l1[i])


def _pack(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], keyed: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            n = part.num_rows
            cells = np.stack([np.searchsorted(e, part.column(i).to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for i, e in enumerate(edges)])
            label = part.column("__label").to_numpy(zero_copy_only=False).astype(np.uint8)
            key = part.column("__key").to_numpy(zero_copy_only=False).astype("i8")
            if not keyed:
                key = key + np.arange(n)  # equal rows are drawn apart
            flat = [cells.tobytes(), label.tobytes(), key.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in flat)], names=["rows", "bins", "label", "key"])


def _leaf(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The node of a growing tree that each row has come to."""
    node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while True:
        inner = tree["left"][node] >= 0
        if not inner.any():
            return node
        left = bins[np.maximum(tree["feature"][node], 0), at] <= tree["threshold"][node]
        node = np.where(inner, np.where(left, tree["left"][node], tree["right"][node]), node)


def _counts(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Counts of this task's blocks, one packed row for each node of the job and each of its features."""
    job = sent.value
    width, chosen = job["width"], job["chosen"]
    slots, m = chosen.shape
    total = np.zeros((3, slots * m * width), np.int64)
    for b in batches:
        for row in b.to_pylist():
            bins = np.frombuffer(row["bins"], np.uint8).reshape(job["features"], row["rows"])
            label, key = np.frombuffer(row["label"], np.uint8), np.frombuffer(row["key"], "i8")
            for number, tree in job["trees"].items():
                times = draws(key, number, job["seed"]) if job["bootstrap"] else np.ones(len(key), np.int64)
                slot = tree["slot"][_leaf(bins, tree)]
                rows = np.flatnonzero((slot >= 0) & (times > 0))
                slot, times, positive = slot[rows], times[rows], label[rows] == 1
                low, high = tree["slots"]
                own = total[:, low * m * width : high * m * width]  # the nodes of a tree stand together
                for j in range(m):
                    code = ((slot - low) * m + j) * width + bins[chosen[slot, j], rows]
                    for k, weight in enumerate((None, times * ~positive, times * positive)):
                        own[k] += np.bincount(code, weights=weight, minlength=own.shape[1]).astype(np.int64)
    cut = total.reshape(3, slots, m, width)
    for s in range(slots):
        cells = [pa.array([s] * m, pa.int32()), pa.array(chosen[s], pa.int32()),
                 *(pa.array([cut[k, s, j].tobytes() for j in range(m)], pa.binary()) for k in range(3))]
        yield pa.RecordBatch.from_arrays(cells, names=["slot", "feature", "n", "c0", "c1"])


def _splits(batches: Iterator[pa.RecordBatch], weights: tuple[float, float], kind: str, least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, feature): their counts added up, and the best split of each."""
    now, sums = None, None
    out: list[tuple] = []

    def done() -> None:
        i, gain, *left = best_split(*sums, weights, kind, least)
        out.append((*now, i, gain, *(int(v.sum()) for v in sums), *left))

    for b in batches:
        for row in b.to_pylist():
            own = [np.frombuffer(row[c], "i8") for c in ("n", "c0", "c1")]
            if (row["slot"], row["feature"]) == now:
                sums = [a + x for a, x in zip(sums, own, strict=True)]
                continue
            if now is not None:
                done()
            now, sums = (row["slot"], row["feature"]), own
    if now is not None:
        done()
    kinds = [pa.int32()] * 3 + [pa.float64()] + [pa.int64()] * 6
    names = [c.split()[0] for c in _SPLIT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


class _ForestSettings(HasFeaturesCol, HasLabelCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level of a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", TypeConverters.toString)
    minRowsSplit = Param(Params._dummy(), "minRowsSplit", "least rows of a node that is split", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "all, sqrt, log2, a number or a share", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether trees draw rows", TypeConverters.toBoolean)
    keyCol = Param(Params._dummy(), "keyCol", "long column that names a row; empty: none", TypeConverters.toString)
    oobScore = Param(Params._dummy(), "oobScore", "whether fit scores the training rows out of bag", TypeConverters.toBoolean)
    histogramMb = Param(Params._dummy(), "histogramMb", "memory of a task's counts", TypeConverters.toInt)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def getMinInstancesPerNode(self) -> int:
        return self.getOrDefault(self.minInstancesPerNode)


def subset_size(strategy: str, features: int) -> int:
    """Features that a node draws."""
    named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": math.ceil(math.log2(features)) if features > 1 else 1}
    size = named[strategy] if strategy in named else math.ceil(float(strategy) * features) if "." in strategy else int(strategy)
    return max(1, min(features, size))


class _Growing:
    """A tree while it grows; thresholds are bins."""

    def __init__(self):
        self.left, self.right, self.feature, self.threshold, self.gain = [-1], [-1], [-1], [0.0], [0.0]
        self.depth, self.counts = [0], [(0, 0, 0)]

    def split(self, node: int, r: dict, gain: float) -> tuple[int, int]:
        first = len(self.left)
        self.left[node], self.right[node] = first, first + 1
        self.feature[node], self.threshold[node], self.gain[node] = r["feature"], float(r["bin"]), gain
        for part in ((r["ln"], r["l0"], r["l1"]), (r["n"] - r["ln"], r["c0"] - r["l0"], r["c1"] - r["l1"])):
            for column, value in ((self.left, -1), (self.right, -1), (self.feature, -1), (self.threshold, 0.0), (self.gain, 0.0),
                                  (self.depth, self.depth[node] + 1), (self.counts, part)):
                column.append(value)
        return first, first + 1

    def arrays(self) -> dict:
        return {"left": np.array(self.left), "right": np.array(self.right), "feature": np.array(self.feature), "threshold": np.array(self.threshold),
                "slot": np.full(len(self.left), -1)}


class HistogramForest(Estimator, _ForestSettings):
    """Estimator: ``fit`` gives a :class:`HistogramForestModel`. Labels are 0 and 1."""

    def __init__(self, class_weights: tuple[float, float] = (1.0, 1.0), **settings):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, maxBins=32, impurity="gini", minRowsSplit=2, minInstancesPerNode=1, featureSubsetStrategy="sqrt",
                         bootstrap=True, keyCol="", oobScore=False, histogramMb=64, seed=0, featuresCol="features", labelCol="label")
        self._set(**settings)
        self.class_weights = class_weights
        if not 2 <= self.getOrDefault("maxBins") <= 256:
            raise ValueError("maxBins must be from 2 to 256")

    def _rows(self, df: DataFrame) -> DataFrame:
        key = self.getOrDefault("keyCol")
        vector = vector_to_array(F.col(self.getFeaturesCol()))
        named = F.coalesce(F.col(key).cast("long"), F.lit(0)) if key else F.xxhash64(vector, F.col(self.getLabelCol()))
        return df.select(vector.alias("v"), F.col(self.getLabelCol()).cast("int").alias("__label"), named.alias("__key"))

    def _fit(self, df: DataFrame) -> "HistogramForestModel":
        get = self.getOrDefault
        spark = df.sparkSession
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        names = df.schema[self.getFeaturesCol()].metadata.get("ml_attr", {})
        size = names.get("num_attrs") or len(df.select(self.getFeaturesCol()).first()[0])
        columns = [f"f{i}" for i in range(size)]
        flat = self._rows(df).select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)], "__label", "__key")
        edges = bin_edges(flat, columns, get("maxBins"))
        keyed = bool(get("keyCol"))
        blocks = persist_adaptive(flat.mapInArrow(lambda b: _pack(b, edges, keyed), _BLOCK))
        try:
            grown = self._grow(blocks, size, max(len(e) for e in edges) + 1)
        finally:
            blocks.unpersist()
        a, b = self.class_weights
        nodes = []
        for t, tree in enumerate(grown):
            for i, (_, c0, c1) in enumerate(tree.counts):
                w = a * c0 + b * c1
                cut = float(edges[tree.feature[i]][int(tree.threshold[i])]) if tree.left[i] >= 0 else 0.0
                nodes.append((t, i, tree.left[i], tree.right[i], tree.feature[i], cut, b * c1 / w if w else 0.0, float(w), tree.gain[i]))
        table = pd.DataFrame(nodes, columns=_NODES).astype({c: "int32" for c in _NODES[:5]})
        model = self._copyValues(HistogramForestModel(table, size))
        if get("oobScore"):
            right = (F.col("oob_score") > 0.5).cast("int") == F.col(self.getLabelCol()).cast("int")
            seen = model.out_of_bag(df, get("keyCol")).where("oob_trees > 0").agg(F.count("*").alias("n"), F.count_if(right).alias("right")).first()
            model.oob_rows = int(seen["n"])
            model.oob_score = seen["right"] / seen["n"] if seen["n"] else None
        return model

    def _grow(self, blocks: DataFrame, size: int, width: int) -> list[_Growing]:
        get = self.getOrDefault
        weights, kind, least = self.class_weights, get("impurity"), get("minInstancesPerNode")
        m = subset_size(get("featureSubsetStrategy"), size)
        at_once = max(1, (get("histogramMb") << 20) // (m * width * 24))
        trees = [_Growing() for _ in range(get("numTrees"))]
        queue = deque((t, 0) for t in range(len(trees)))
        context = blocks.sparkSession.sparkContext
        while queue:
            now = sorted(queue.popleft() for _ in range(min(at_once, len(queue))))
            chosen = np.stack([np.sort(np.random.default_rng((get("seed") & 0xFFFFFFFF, t, node)).choice(size, m, replace=False)) for t, node in now])
            arrays = {t: trees[t].arrays() for t, _ in now}
            for slot, (t, node) in enumerate(now):
                arrays[t]["slot"][node] = slot
                arrays[t]["slots"] = (arrays[t].get("slots", (slot,))[0], slot + 1)
            sent = context.broadcast({"features": size, "width": width, "chosen": chosen, "trees": arrays, "seed": get("seed"), "bootstrap": get("bootstrap")})
            sums = blocks.mapInArrow(lambda b: _counts(b, sent), "slot int, feature int, n binary, c0 binary, c1 binary")  # noqa: B023
            best = sums.repartition("slot", "feature").sortWithinPartitions("slot", "feature").mapInArrow(lambda b: _splits(b, weights, kind, least), _SPLIT)
            found: dict[int, dict] = {}
            for r in sorted(best.toArrow().to_pylist(), key=lambda r: (r["slot"], r["feature"])):  # a row for each node and feature of the job
                if r["slot"] not in found or round(r["gain"], 9) > round(found[r["slot"]]["gain"], 9):
                    found[r["slot"]] = r
            sent.unpersist()
            for slot, r in sorted(found.items()):
                t, node = now[slot]
                tree = trees[t]
                if node == 0:
                    tree.counts[0] = (r["n"], r["c0"], r["c1"])
                if r["gain"] <= 1e-9 or r["n"] < get("minRowsSplit"):
                    continue
                for child in tree.split(node, r, r["gain"]):
                    n, c0, c1 = tree.counts[child]
                    if tree.depth[child] < get("maxDepth") and n >= max(get("minRowsSplit"), 2 * least) and c0 and c1:
                        queue.append((t, child))
        return trees


class HistogramForestModel(HistogramBoostedModel, _ForestSettings):
    """Trees of a :class:`HistogramForest`; the score of a row is the mean share of class 1 in its leaves."""

    SAVED = ("size", "oob_score", "oob_rows")
    oob_score: float | None = None
    oob_rows: int | None = None

    @property
    def getNumTrees(self) -> int:
        return int(self.nodes["tree"].nunique())

    @property
    def featureImportances(self) -> DenseVector:
        """Decrease of impurity of a feature's splits, as shares of each tree, averaged over the trees that split."""
        total = np.zeros(self.size)
        for _, t in self.nodes[self.nodes["left"] >= 0].groupby("tree"):
            gain = np.bincount(t["feature"], weights=t["gain"], minlength=self.size)
            total += gain / gain.sum()
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def predictRaw(self, value) -> DenseVector:
        trees = self.arrays()
        p = float(margins(np.asarray([value.toArray()]), trees)[0])
        return DenseVector([len(trees) - p, p])

    def predictProbability(self, value) -> DenseVector:
        return DenseVector(self.predictRaw(value).toArray() / self.getNumTrees)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self.arrays())

        @F.pandas_udf(T.DoubleType())
        def votes(v: pd.Series) -> pd.Series:
            return pd.Series(margins(np.stack(v.to_numpy()), sent.value) if len(v) else np.zeros(0))

        n, p = float(self.getNumTrees), F.col("__votes")
        return (df.withColumn("__votes", votes(vector_to_array(F.col(self.getFeaturesCol()))))
                .withColumn("rawPrediction", array_to_vector(F.array(n - p, p)))
                .withColumn("probability", array_to_vector(F.array((n - p) / n, p / n)))
                .withColumn("prediction", (p > n / 2).cast("double")).drop("__votes"))

    def out_of_bag(self, df: DataFrame, key: str = "") -> DataFrame:
        """``df`` with ``oob_trees``, the trees that did not draw the row, and ``oob_score``, their mean (null if none)."""
        key = key or self.getOrDefault("keyCol")
        if not key or not self.getOrDefault("bootstrap"):
            raise ValueError("out-of-bag scores need a key column and trees that draw rows")
        ship_package(df.sparkSession)
        sent, seed = df.sparkSession.sparkContext.broadcast(self.arrays()), self.getOrDefault("seed")

        @F.pandas_udf("trees int, votes double")
        def unseen(v: pd.Series, k: pd.Series) -> pd.DataFrame:
            n, votes = np.zeros(len(k), np.int32), np.zeros(len(k))
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
            for t, tree in enumerate(sent.value):
                out = draws(k.to_numpy(), t, seed) == 0
                n += out
                votes[out] += margins(x[out], [tree])
            return pd.DataFrame({"trees": n, "votes": votes})

        cell = unseen(vector_to_array(F.col(self.getFeaturesCol())), F.coalesce(F.col(key).cast("long"), F.lit(0)))
        out = df.withColumn("__oob", cell)
        return out.withColumn("oob_trees", F.col("__oob.trees")).withColumn(
            "oob_score", F.when(F.col("__oob.trees") > 0, F.col("__oob.votes") / F.col("__oob.trees"))).drop("__oob")
