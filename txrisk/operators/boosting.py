"""Second-order gradient-boosted trees for two classes (M2), trained by Spark jobs over quantile bins.

Each round fits a tree to the gradients ``g = w (p - y)`` and hessians ``h = w p (1 - p)`` of the logistic loss. With ``T`` the
soft threshold by ``reg_alpha``, a node with sums G and H scores ``T(G)^2 / (H + reg_lambda)`` and a leaf weighs
``-T(G) / (H + reg_lambda)``. A split needs ``min_child_weight`` of hessian on both sides and a gain above ``gamma``.

* Features are binned once: at all their values where these are few, else at quantiles. Rows are kept as packed blocks
  (bins, label, weight, margin), cached, and rewritten every ``checkpoint_interval`` trees with the margins so far, so that
  a lost executor repeats at most that many trees for its blocks.
* A level of a tree is one job: each task sums g and h of its blocks by (node, feature, bin) and hands on one packed row for
  each node and feature; one shuffle on (node, feature) adds them up and finds the feature's best split; the driver
  sees one row for each node and feature. No task holds the rows of a node, so skewed nodes do not matter.
* Sums are of whole multiples of 2^-30, so neither the number of tasks nor their order changes a model.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, persist_adaptive, ship_package

#: Whole numbers stand for multiples of this in sums.
UNIT = 2.0**-30
_NODES = ["tree", "id", "left", "right", "feature", "threshold", "value", "cover", "gain"]
_NODE_SCHEMA = "tree int, id int, left int, right int, feature int, threshold double, value double, cover double, gain double"
#: Rows of a packed block.
BLOCK_ROWS = 16_384


class _Settings(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    """Parameters of the estimator."""

    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level of a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "gain that a split must exceed", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty of leaf weights", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf weights", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of the rows that a tree sees", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of the features that a tree sees", TypeConverters.toFloat)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "trees between written margins", TypeConverters.toInt)

    def getMaxIter(self) -> int:
        return self.getOrDefault(self.maxIter)

    def getStepSize(self) -> float:
        return self.getOrDefault(self.stepSize)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


def margins(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Sum of the trees' leaf weights for rows of feature values (or of bins, with ``threshold`` in bins)."""
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        node = np.zeros(len(x), np.int64)
        inner = t["left"][node] >= 0
        while inner.any():
            left = x[rows, np.maximum(t["feature"][node], 0)] <= t["threshold"][node]
            node = np.where(inner, np.where(left, t["left"][node], t["right"][node]), node)
            inner = t["left"][node] >= 0
        out += t["value"][node]
    return out


# -------------------------------------------------------------- training ---
def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of each feature (a row is left of a cut if its value is at most the cut), in two aggregations."""
    cells = [F.col(f"`{c}`").cast("double") for c in features]
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cells)],
                  *[F.percentile_approx(c, shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(cells)],
                  *[F.max(c).alias(f"m{i}") for i, c in enumerate(cells)]).first()
    # only features of few values are collected whole
    few = [i for i in range(len(cells)) if seen[f"d{i}"] <= 2 * bins]
    sets = df.agg(*[F.collect_set(cells[i]).alias(f"s{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(cells)):
        values = sorted(set(sets[f"s{i}"])) if i in few else None
        cuts = values if values is not None and len(values) <= bins else sorted(set(seen[f"q{i}"] or []))
        out.append(np.array([v for v in cuts if v < seen[f"m{i}"]]))
    return out


def _pack(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks: bins feature by feature, label, weight, a number for drawing rows, margin."""
    names = ["rows", "bins", "label", "weight", "draw", "margin"]
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            n = part.num_rows
            cells = np.stack([np.searchsorted(e, part.column(i).to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for i, e in enumerate(edges)])
            label, weight = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__label", "__weight"))
            draw = part.column("__draw").to_numpy(zero_copy_only=False) + np.arange(n)  # equal rows are drawn apart
            flat = [cells.tobytes(), label.astype("f8").tobytes(), weight.astype("f8").tobytes(), draw.astype("i8").tobytes(), np.zeros(n).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in flat)], names=names)


_BLOCK = "rows int, bins binary, label binary, weight binary, draw binary, margin binary"


class _Block:
    def __init__(self, row: dict, features: int):
        n = row["rows"]
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(features, n)
        self.label, self.weight, self.margin = (np.frombuffer(row[c], "f8") for c in ("label", "weight", "margin"))
        self.draw = np.frombuffer(row["draw"], "i8")


def _uniform(draw: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, by its hash and the tree's seed."""
    x = draw.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def _gradients(block: _Block, pending: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    margin = block.margin + margins(block.bins.T, pending) if pending else block.margin
    p = 1.0 / (1.0 + np.exp(-margin))
    return block.weight * (p - block.label), block.weight * p * (1.0 - p)


def _histograms(batches: Iterator[pa.RecordBatch], sent, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of g and h of this task's blocks, one packed row for each open node and feature."""
    job = sent.value
    features, chosen, open_ = job["features"], job["chosen"], job["open"]
    place = np.full(max(open_) + 1, -1)
    place[open_] = np.arange(len(open_))
    total = np.zeros((2, len(chosen), len(open_) * width))
    for b in batches:
        for row in b.to_pylist():
            block = _Block(row, features)
            g, h = _gradients(block, job["pending"])
            node = np.zeros(row["rows"], np.int64)
            t = job["tree"]
            for _ in range(job["level"]):
                inner = t["left"][node] >= 0
                cells = block.bins[np.maximum(t["feature"][node], 0), np.arange(len(node))]
                node = np.where(inner, np.where(cells <= t["threshold"][node], t["left"][node], t["right"][node]), node)
            at = np.where(node < len(place), place[np.minimum(node, len(place) - 1)], -1)
            take = at >= 0
            if job["subsample"] < 1.0:
                take &= _uniform(block.draw, job["seed"]) < job["subsample"]
            at = at[take] * width
            sums = [np.rint(v[take] / UNIT) for v in (g, h)]  # whole numbers: exact in any order below 2^53
            for j, f in enumerate(chosen):
                code = at + block.bins[f][take]
                for k in (0, 1):
                    total[k, j] += np.bincount(code, weights=sums[k], minlength=total.shape[2])
    for i, node in enumerate(open_):
        cut = total[:, :, i * width : (i + 1) * width]
        cells = [pa.array([node] * len(chosen), pa.int32()), pa.array(chosen, pa.int32()),
                 *(pa.array([c.tobytes() for c in cut[k].astype("i8")], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(cells, names=["node", "feature", "g", "h"])


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, lam: float, alpha: float, least: float) -> tuple[int, float, float, float]:
    """Last bin on the left, gain, and sums on the left, for one feature's bins; gain -inf where no split is allowed."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    with np.errstate(all="ignore"):
        gain = soft(gl, alpha) ** 2 / (hl + lam) + soft(gr, alpha) ** 2 / (hr + lam) - soft(g.sum(), alpha) ** 2 / (h.sum() + lam)
    gain = np.where((hl >= least) & (hr >= least) & (hl > 0) & (hr > 0) & np.isfinite(gain), gain, -np.inf)
    if not len(gain):
        return -1, -np.inf, 0.0, 0.0
    i = int(np.argmax(np.round(gain, 12)))  # of equal gains the first cut
    return i, float(gain[i]), float(gl[i]), float(hl[i])


def _splits(batches: Iterator[pa.RecordBatch], lam: float, alpha: float, least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, feature): their histograms added up, and the best split of each."""
    now, g, h = None, None, None
    out: list[tuple] = []

    def done() -> None:
        gs, hs = g * UNIT, h * UNIT
        i, gain, gl, hl = best_split(gs, hs, lam, alpha, least)
        out.append((*now, i, gain, gl, hl, float(gs.sum()), float(hs.sum())))

    for b in batches:
        for row in b.to_pylist():
            key = (row["node"], row["feature"])
            own = [np.frombuffer(row[c], "i8").astype(float) for c in ("g", "h")]
            if key != now:
                if now is not None:
                    done()
                now, g, h = key, *own
            else:
                g, h = g + own[0], h + own[1]
    if now is not None:
        done()
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 5]
    names = ["node", "feature", "bin", "gain", "gl", "hl", "g", "h"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


class _Tree:
    """A tree while it grows; thresholds are bins."""

    def __init__(self):
        self.rows: list[dict] = []

    def add(self, g: float, h: float) -> int:
        self.rows.append({"left": -1, "right": -1, "feature": -1, "threshold": 0.0, "g": g, "h": h, "gain": 0.0})
        return len(self.rows) - 1

    def arrays(self, value: list[float] | None = None) -> dict:
        out = {c: np.array([r[c] for r in self.rows]) for c in ("left", "right", "feature", "threshold")}
        out["value"] = np.array(value if value is not None else [0.0] * len(self.rows))
        return out


class HistogramBooster(Estimator, _Settings):
    """Estimator: ``fit`` gives a :class:`HistogramBoostedModel`."""

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=6, maxBins=32, minChildWeight=1.0, gamma=0.0, regAlpha=0.0, regLambda=1.0,
                         subsample=1.0, colsample=1.0, checkpointInterval=10, seed=0, featuresCol="features", labelCol="label")
        self._set(**settings)
        if not 2 <= self.getOrDefault("maxBins") <= 256:
            raise ValueError("maxBins must be from 2 to 256")

    def setWeightCol(self, value: str) -> "HistogramBooster":
        return self._set(weightCol=value)

    def _fit(self, df: DataFrame) -> "HistogramBoostedModel":
        get = self.getOrDefault
        spark = df.sparkSession
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        names = df.schema[self.getFeaturesCol()].metadata.get("ml_attr", {})
        size = names.get("num_attrs") or len(df.select(self.getFeaturesCol()).first()[0])
        vector = vector_to_array(F.col(self.getFeaturesCol()))
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") else F.lit(1.0)
        flat = df.select(vector.alias("v"), F.col(self.getLabelCol()).cast("double").alias("__label"), weight.cast("double").alias("__weight"))
        columns = [f"f{i}" for i in range(size)]
        flat = flat.select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)], "__label", "__weight", F.xxhash64("v", "__label").alias("__draw"))
        edges = bin_edges(flat, columns, get("maxBins"))
        width = max(len(e) for e in edges) + 1
        blocks = persist_adaptive(flat.mapInArrow(lambda b: _pack(b, edges), _BLOCK))
        written: list[dict] = []  # trees whose margins the blocks hold
        trees: list[dict] = []
        nodes: list[tuple] = []
        rng = np.random.default_rng(get("seed"))
        try:
            for number in range(get("maxIter")):
                chosen = sorted(rng.choice(size, max(1, math.ceil(get("colsample") * size)), replace=False).tolist())
                tree, values = self._grow(blocks, trees[len(written):], chosen, size, width, number)
                if len(tree.rows) == 1 and values[0] == 0.0 and get("subsample") == 1.0 and get("colsample") == 1.0:
                    break  # every later tree would be the same
                arrays = tree.arrays(values)
                trees.append(arrays)
                for i, r in enumerate(tree.rows):
                    cut = float(edges[r["feature"]][int(r["threshold"])]) if r["left"] >= 0 else 0.0
                    nodes.append((len(trees) - 1, i, r["left"], r["right"], r["feature"], cut, float(values[i]), r["h"], r["gain"]))
                if len(trees) - len(written) == get("checkpointInterval") and number + 1 < get("maxIter"):
                    blocks, written = self._write_margins(blocks, trees[len(written):], size), list(trees)
        finally:
            blocks.unpersist()
        table = pd.DataFrame(nodes, columns=_NODES).astype({c: "int32" for c in _NODES[:5]})
        return self._copyValues(HistogramBoostedModel(table, size))

    def _grow(self, blocks: DataFrame, pending: list[dict], chosen: list[int], size: int, width: int, number: int) -> tuple[_Tree, list[float]]:
        get = self.getOrDefault
        lam, alpha, least = get("regLambda"), get("regAlpha"), get("minChildWeight")
        tree = _Tree()
        open_ = [tree.add(0.0, 0.0)]
        level = 0
        while open_:
            job = {"features": size, "chosen": chosen, "open": open_, "pending": pending, "tree": tree.arrays(), "level": level,
                   "subsample": get("subsample"), "seed": get("seed") * 1_000_003 + number}
            sent = blocks.sparkSession.sparkContext.broadcast(job)
            sums = blocks.mapInArrow(lambda b: _histograms(b, sent, width), "node int, feature int, g binary, h binary")
            best = sums.repartition("node", "feature").sortWithinPartitions("node", "feature").mapInArrow(
                lambda b: _splits(b, lam, alpha, least), "node int, feature int, bin int, gain double, gl double, hl double, g double, h double")
            found: dict[int, tuple] = {}
            for r in sorted(best.toArrow().to_pylist(), key=lambda r: (r["node"], r["feature"])):  # a row for each node and feature
                tree.rows[r["node"]]["g"], tree.rows[r["node"]]["h"] = r["g"], r["h"]
                if r["node"] not in found or round(r["gain"], 12) > round(found[r["node"]]["gain"], 12):
                    found[r["node"]] = r
            sent.unpersist()
            level += 1
            open_ = []
            for node, r in found.items():
                if r["gain"] <= max(get("gamma"), 1e-6) or level > get("maxDepth"):
                    continue
                own = tree.rows[node]
                left, right = tree.add(r["gl"], r["hl"]), tree.add(r["g"] - r["gl"], r["h"] - r["hl"])
                own.update(left=left, right=right, feature=r["feature"], threshold=float(r["bin"]), gain=r["gain"])
                open_ += [left, right]
            if level >= get("maxDepth"):
                break
        values = []
        for r in tree.rows:
            weigh = r["left"] < 0 and r["h"] + lam > 0
            values.append(float(-soft(np.float64(r["g"]), alpha) / (r["h"] + lam)) * get("stepSize") if weigh else 0.0)
        return tree, values

    def _write_margins(self, blocks: DataFrame, pending: list[dict], size: int) -> DataFrame:
        """The blocks with the margins of ``pending`` added, in the shared folder."""
        spark = blocks.sparkSession
        sent = spark.sparkContext.broadcast(pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block = _Block(row, size)
                    row["margin"] = (block.margin + margins(block.bins.T, sent.value)).tobytes()
                    yield pa.RecordBatch.from_pylist([row], schema=b.schema)

        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/margins-{uuid.uuid4().hex}"
        blocks.mapInArrow(run, _BLOCK).write.parquet(path)
        blocks.unpersist()
        return persist_adaptive(spark.read.schema(_BLOCK).parquet(path))


# ----------------------------------------------------------------- model ---
class HistogramBoostedModel(Model, _Settings, MLWritable, MLReadable):
    """Trees of a :class:`HistogramBooster`; ``transform`` adds rawPrediction and probability vectors and the likelier class."""

    #: Attributes kept with a saved model.
    SAVED = ("size",)

    def __init__(self, nodes: pd.DataFrame | None = None, size: int = 0):
        super().__init__()
        self.nodes, self.size = nodes, size

    @property
    def getNumTrees(self) -> int:
        return int(self.nodes["tree"].nunique())

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * self.getNumTrees

    def arrays(self) -> list[dict]:
        return [{c: t[c].to_numpy() for c in ("left", "right", "feature", "threshold", "value")} for _, t in self.nodes.groupby("tree", sort=True)]

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of all splits of a feature, as shares."""
        inner = self.nodes[self.nodes["left"] >= 0]
        gain = np.bincount(inner["feature"], weights=inner["gain"], minlength=self.size).astype(float)
        return DenseVector(gain / gain.sum() if gain.sum() > 0 else gain)

    def predictRaw(self, value) -> DenseVector:
        m = float(margins(np.asarray([value.toArray()]), self.arrays())[0])
        return DenseVector([-m, m])

    def predictProbability(self, value) -> DenseVector:
        p = 1.0 / (1.0 + math.exp(-self.predictRaw(value)[1]))
        return DenseVector([1.0 - p, p])

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self.arrays())

        @F.pandas_udf(T.DoubleType())
        def margin(v: pd.Series) -> pd.Series:
            return pd.Series(margins(np.stack(v.to_numpy()), sent.value) if len(v) else np.zeros(0))

        m = F.col("__margin")
        p = 1 / (1 + F.exp(-m))
        return (df.withColumn("__margin", margin(vector_to_array(F.col(self.getFeaturesCol()))))
                .withColumn("rawPrediction", array_to_vector(F.array(-m, m)))
                .withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (m > 0).cast("double")).drop("__margin"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: HistogramBoostedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={c: getattr(self.model, c) for c in self.model.SAVED})
        spark.createDataFrame(pa.Table.from_pandas(self.model.nodes, preserve_index=False), _NODE_SCHEMA).repartition("tree").sortWithinPartitions(
            "tree", "id").write.parquet(f"{path}/data")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> HistogramBoostedModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.parquet(f"{path}/data").orderBy("tree", "id").toArrow().to_pandas()
        model = self.cls(nodes)
        for c in model.SAVED:
            setattr(model, c, metadata[c])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
