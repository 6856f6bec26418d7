"""Per-row additive attributions for tree ensembles.

Path-dependent Shapley values (Lundberg, Erion & Lee, 2018) in linear time per leaf (Yu et al., 2022), as a Spark job.
On the path to a leaf, feature ``k`` has ``z_k``, the share of training rows that its tests pass, and a row has ``o_k``, 1 if it
passes them all itself. The leaf gives feature ``k``

    value * (o_k - z_k) * integral over t in (0, 1) of the product over j != k of (t o_j + (1 - t) z_j)

whose integrand is a polynomial of a degree below the number ``d`` of features on the path: Gauss-Legendre quadrature
with ``ceil(d / 2)`` points is exact. One walk over a tree carries the product at these points for a batch of rows and
sums it over the leaves below each edge, so the cost is edges x points x rows, whatever the depth.

The node table of the saved model is cut into groups of trees of at most ``group_nodes`` nodes. One group is read to the driver
at a time and sent to the tasks; with several groups their contributions are summed by row key.

Explained output (positive class):

* random forest: the class-1 probability (mean of the trees' leaf class distributions);
* boosted trees: the log-odds (``2 * sum(w_t * tree_t(x))`` for Spark's own boosting).

For every row ``base_value + sum(attributions) == model_output``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..session import ensure_checkpoint_dir, ship_package
from .boosting import HistogramBoostedModel
from .forest import HistogramForestModel

BASE = "base_value"
OUTPUT = "model_output"
#: Nodes of the trees that a task holds at once (about 50 bytes each); larger models are explained in groups of trees.
GROUP_NODES = 1_000_000
#: Rows that walk a tree together.
ROWS = 2048


# -------------------------------------------------------------- one tree ---
def path_features(tree: dict) -> int:
    """Most different features on a path of the tree."""
    most = 0
    stack = [(0, frozenset())]
    while stack:
        j, seen = stack.pop()
        if tree["left"][j] < 0:
            most = max(most, len(seen))
        else:
            seen = seen | {int(tree["feature"][j])}
            stack += [(tree["left"][j], seen), (tree["right"][j], seen)]
    return most


def quadrature(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in (0, 1) and weights that integrate polynomials of degree ``d - 1`` exactly."""
    x, w = np.polynomial.legendre.leggauss(max(1, -(-d // 2)))
    return (x + 1) / 2, w / 2


def tree_shap(x: np.ndarray, tree: dict, phi: np.ndarray, scale: float) -> None:
    """Add ``scale`` * Shapley values of one tree for all rows of ``x`` into ``phi``."""
    left, right, feature, cover = (tree[c] for c in ("left", "right", "feature", "cover"))
    t, w = quadrature(tree.get("path_features") or path_features(tree))

    def edge(z: float, o: np.ndarray) -> tuple:
        """A feature's part of the product: share, own rows, values where passed and not, and quadrature weights over them."""
        passed, missed = t + (1 - t) * z, (1 - t) * z
        return z, o, passed[:, None], missed[:, None], w / passed, w / missed

    def gives(e: tuple, total: np.ndarray) -> np.ndarray:
        z, o, _, _, wp, wm = e
        return np.where(o, (1 - z) * (wp @ total), -z * (wm @ total))

    def walk(j: int, product: np.ndarray, path: dict) -> np.ndarray:
        """Sum over the leaves below ``j`` of value times product, at each point and row."""
        if left[j] < 0:
            return product * tree["value"][j]
        f = int(feature[j])
        before = path.get(f)
        goes_left = x[:, f] <= tree["threshold"][j]
        total = 0.0
        for child, own in ((left[j], goes_left), (right[j], ~goes_left)):
            if cover[child] <= 0:  # no training row went there: the edge has no share
                continue
            z = cover[child] / cover[j]
            e = edge(z, own) if before is None else edge(z * before[0], own & before[1])
            below = product if before is None else product / np.where(before[1], before[2], before[3])
            got = walk(child, below * np.where(e[1], e[2], e[3]), {**path, f: e})
            change = gives(e, got)
            if before is not None:  # leaves below this edge count with it, no longer with the one above
                change -= gives(before, got)
            phi[:, f] += scale * change
            total = total + got
        return total

    if left[0] >= 0:
        walk(0, np.ones((len(t), len(x))), {})


def tree_expectation(tree: dict) -> float:
    leaves = tree["left"] < 0
    return float(np.sum(tree["value"][leaves] * tree["cover"][leaves]) / tree["cover"][0])


def tree_predict(x: np.ndarray, tree: dict) -> np.ndarray:
    node = np.zeros(x.shape[0], dtype=np.int64)
    while True:
        inner = tree["left"][node] >= 0
        if not inner.any():
            return tree["value"][node]
        go_left = x[np.arange(x.shape[0]), np.maximum(tree["feature"][node], 0)] <= tree["threshold"][node]
        node = np.where(inner, np.where(go_left, tree["left"][node], tree["right"][node]), node)


# ---------------------------------------------------------- model tables ---
class NodeTables:
    """The trees of a saved model as arrays, read group by group."""

    def __init__(self, spark: SparkSession, model: PipelineModel, kind: str, group_nodes: int):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/explain-{uuid.uuid4().hex}"
        model.write().overwrite().save(path)
        nodes = spark.read.parquet(f"{path}/stages/*/data")
        self.kind = kind
        if kind == "boosted":
            self.nodes = nodes
        else:
            self.nodes = nodes.select(
                F.col("treeID").alias("tree"), "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats").alias("stats"),
                F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                F.col("nodeData.split.featureIndex").alias("feature"),
                F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold"))
        sizes = sorted(tuple(r) for r in self.nodes.groupBy("tree").count().collect())  # one row a tree
        self.groups: list[tuple[int, int]] = []  # first and last tree
        weight = 0
        for tree, size in sizes:
            if self.groups and weight + size <= group_nodes:
                self.groups[-1], weight = (self.groups[-1][0], tree), weight + size
            else:
                self.groups.append((tree, tree))
                weight = size
        self.trees = len(sizes)

    def read(self, group: tuple[int, int]) -> list[dict]:
        table = self.nodes.where(F.col("tree").between(*group)).orderBy("tree", "id").toArrow()
        tree, id_, left, right = (table[c].to_numpy().astype(np.int64) for c in ("tree", "id", "left", "right"))
        feature = table["feature"].fill_null(-1).to_numpy().astype(np.int64)
        threshold = table["threshold"].fill_null(0.0).to_numpy()
        if self.kind == "boosted":
            cover, value = table["cover"].to_numpy(), table["value"].to_numpy()
        else:
            stats = np.array(table["stats"].to_pylist(), dtype=float)
            cover = stats.sum(axis=1) if self.kind == "rf" else stats[:, 0]
            value = table["prediction"].to_numpy()
            if self.kind == "rf":
                value = np.divide(stats[:, 1], cover, out=np.zeros(len(stats)), where=cover > 0) if stats.shape[1] > 1 else np.zeros(len(stats))
        out = []
        for one in np.split(np.arange(len(tree)), np.flatnonzero(np.diff(tree)) + 1):
            ids = id_[one]
            if ids[0] != 0:
                raise E.ExplainerError("unexpected node numbering in the saved tree table")
            inner = left[one] >= 0
            place = {"left": left[one], "right": right[one]}
            arrays = {c: np.where(inner, np.searchsorted(ids, np.maximum(v, 0)), -1) for c, v in place.items()}
            arrays |= {"feature": np.where(inner, feature[one], -1), "threshold": threshold[one], "value": value[one], "cover": cover[one]}
            arrays["path_features"] = path_features(arrays)
            out.append(arrays)
        return out


class TreeExplainer:
    """X1/X2 for a fitted ``PipelineModel`` ending in a forest or boosted trees."""

    def __init__(self, model: PipelineModel, group_nodes: int = GROUP_NODES, spark: SparkSession | None = None):
        if not isinstance(model, PipelineModel) or not model.stages:
            raise E.ExplainerError(f"attributions need a fitted pipeline model, not {type(model).__name__}")
        clf = model.stages[-1]
        if isinstance(clf, RandomForestClassificationModel):
            self.kind = "rf"
            n = clf.getNumTrees
            self.scales = [1.0 / n] * n
        elif isinstance(clf, GBTClassificationModel):
            self.kind = "gbt"
            self.scales = [2.0 * w for w in clf.treeWeights]
        elif isinstance(clf, HistogramBoostedModel):
            self.kind = "boosted"
            n = clf.getNumTrees
            self.scales = [1.0 / n if isinstance(clf, HistogramForestModel) else 1.0] * n
        else:
            raise E.ExplainerError(f"{type(clf).__name__} is not a forest or boosted trees")
        self.features = list(model.stages[0].getInputCols())
        self.tables = NodeTables(spark or SparkSession.getActiveSession(), model, self.kind, group_nodes)
        if self.tables.trees != len(self.scales):
            raise E.ExplainerError("tree table does not match the model")

    @property
    def trees(self) -> list[dict]:
        """All trees as arrays (the whole model, on the driver)."""
        return [t for g in self.tables.groups for t in self.tables.read(g)]

    def _validate(self, df: DataFrame) -> None:
        """Non-empty, unique names, features present, no nulls/NaN (one job)."""
        if len(set(df.columns)) != len(df.columns):
            raise E.ExplainerError(f"column names occur more than once: {df.columns}")
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise E.ExplainerError(f"rows lack the model's features {missing}")
        bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in self.features]
        r = df.agg(F.count(F.lit(1)).alias("__n"), *bad).first().asDict()
        if r.pop("__n") == 0:
            raise E.ExplainerError("there are no rows to explain")
        if any(r.values()):
            raise E.ExplainerError(f"null or NaN in {sorted(c for c, n in r.items() if n)}")

    def attributions(self, df: DataFrame, key: str = S.ROW_ID, validate: bool = True) -> DataFrame:
        """One row per input row: key, base_value, model_output and one column per feature.

        A model of several groups of trees needs a key that is unique by row.
        """
        if validate:
            self._validate(df)
        ship_package(df.sparkSession)
        feats = self.features
        keys = [key] if key in df.columns else []
        groups = self.tables.groups
        if len(groups) > 1 and not keys:
            raise E.ExplainerError(f"a model of several groups of trees needs the key column {key}")
        schema = ", ".join([f"`{k}` bigint" for k in keys] + [f"{BASE} double", f"{OUTPUT} double"] + [f"`{c}` double" for c in feats])
        parts = []
        for group in groups:
            trees = self.tables.read(group)
            scales = self.scales[group[0]: group[1] + 1]
            base = float(sum(s * tree_expectation(t) for s, t in zip(scales, trees)))
            sent = df.sparkSession.sparkContext.broadcast((trees, scales, base))
            parts.append(df.select(*keys, *feats).mapInPandas(_explain(sent, feats, keys), schema))
        if len(parts) == 1:
            return parts[0]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        numbers = [BASE, OUTPUT, *feats]
        return every.groupBy(*keys).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in numbers])


def _explain(sent, feats: list[str], keys: list[str]):
    def explain(batches):
        trees, scales, base = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at: at + ROWS]
                # column-major: every test reads one feature column
                x = np.asfortranarray(part[feats].to_numpy(dtype=np.float64))
                phi = np.zeros(x.shape, order="F")
                out = np.zeros(x.shape[0])
                for t, s in zip(trees, scales):
                    tree_shap(x, t, phi, s)
                    out += s * tree_predict(x, t)
                res = pd.DataFrame(phi, columns=feats)
                res.insert(0, OUTPUT, out)
                res.insert(0, BASE, base)
                for k in reversed(keys):
                    res.insert(0, k, part[k].to_numpy())
                yield res

    return explain


def summarize(attr: DataFrame, features: list[str]) -> DataFrame:
    """Mean |attribution| per feature, largest first (data behind a summary plot)."""
    one = attr.agg(*[F.avg(F.abs(F.col(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(features)])  # the data meet one aggregate
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("mean_abs_attribution")) for i, c in enumerate(features)])
    return (one.select(F.explode(cells).alias("e")).select("e.feature", "e.mean_abs_attribution")
            .orderBy(F.desc("mean_abs_attribution"), "feature"))
