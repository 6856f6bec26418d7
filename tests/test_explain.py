"""TreeSHAP attributions are additive and equal brute-force Shapley values."""

import itertools
import math

import numpy as np
import pytest

from txrisk import errors as E
from txrisk.operators.explain import BASE, OUTPUT, TreeExplainer, path_features, summarize, tree_expectation, tree_predict, tree_shap
from txrisk.operators.models import ModelFactory, ModelTrainer, score

FEATS = ["f1", "f2", "f3", "f4"]


def _frame(spark, n=200):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a, b, c, d = rng.normal(size=4)
        y = int(a + 0.5 * b * c + 0.3 * rng.normal() > 0.2)
        rows.append((i, float(a), float(b), float(c), float(round(d, 1)), y))
    return spark.createDataFrame(rows, "row_id bigint, f1 double, f2 double, f3 double, f4 double, isFraud int")


def _cond_expectation(tree, x, subset):
    def rec(j):
        if tree["left"][j] < 0:
            return tree["value"][j]
        f = tree["feature"][j]
        a, b = tree["left"][j], tree["right"][j]
        if f in subset:
            return rec(a if x[f] <= tree["threshold"][j] else b)
        return (tree["cover"][a] * rec(a) + tree["cover"][b] * rec(b)) / tree["cover"][j]
    return rec(0)


def _brute(trees, scales, x, nf):
    phi = np.zeros(nf)
    for j in range(nf):
        others = [k for k in range(nf) if k != j]
        for r in range(len(others) + 1):
            for sub in itertools.combinations(others, r):
                wgt = math.factorial(r) * math.factorial(nf - r - 1) / math.factorial(nf)
                s = set(sub)
                for t, sc in zip(trees, scales):
                    phi[j] += sc * wgt * (_cond_expectation(t, x, s | {j}) - _cond_expectation(t, x, s))
    return phi


@pytest.mark.parametrize("name,kw", [
    ("random_forest", dict(n_estimators=5, max_depth=4, class_weight=None)),
    ("gbt", dict(n_estimators=6, max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0)),
    ("xgboost", dict(n_estimators=12, max_depth=4, learning_rate=0.3, reg_alpha=0.1)),
])
def test_additive_and_exact(spark, name, kw):
    df = _frame(spark)
    model = ModelTrainer(ModelFactory.create(name, **kw)).train(df, FEATS)
    ex = TreeExplainer(model)
    attr = ex.attributions(df).orderBy("row_id").toPandas()
    assert len(attr) == 200
    # additivity against Spark's own prediction
    p = score(model, df).orderBy("row_id").toPandas()["score"].to_numpy()
    target = p if name == "random_forest" else np.log(p / (1 - p))
    recon = attr[BASE].to_numpy() + attr[FEATS].to_numpy().sum(axis=1)
    assert np.allclose(recon, target, atol=1e-6)
    assert np.allclose(attr[OUTPUT].to_numpy(), target, atol=1e-6)
    # brute-force Shapley values on a few rows
    x = df.orderBy("row_id").toPandas()[FEATS].to_numpy()
    for i in (0, 17, 101):
        want = _brute(ex.trees, ex.scales, x[i], len(FEATS))
        assert np.allclose(attr.loc[i, FEATS].to_numpy(dtype=float), want, atol=1e-9)
    # tree_predict agrees with the model output
    out = sum(s * tree_predict(x, t) for s, t in zip(ex.scales, ex.trees))
    assert np.allclose(out, target, atol=1e-6)


def test_summary_orders_by_mean_abs(spark):
    df = _frame(spark)
    model = ModelTrainer(ModelFactory.create("xgboost", n_estimators=3, max_depth=2)).train(df, FEATS)
    ex = TreeExplainer(model)
    s = summarize(ex.attributions(df), FEATS).collect()
    vals = [r["mean_abs_attribution"] for r in s]
    assert vals == sorted(vals, reverse=True)
    assert {r["feature"] for r in s} == set(FEATS)


def test_rejects_nan_and_non_tree(spark):
    from txrisk import errors as E

    df = _frame(spark)
    model = ModelTrainer(ModelFactory.create("xgboost", n_estimators=2, max_depth=2)).train(df, FEATS)
    ex = TreeExplainer(model)
    from pyspark.sql import functions as F

    bad = df.withColumn("f1", F.when(df.row_id == 3, F.lit(float("nan"))).otherwise(df.f1))
    with pytest.raises(E.ExplainerError):
        ex.attributions(bad)
    with pytest.raises(E.ExplainerError):
        TreeExplainer(None)


def _plain(tree, x, nf):
    """Shapley values of one tree by the sum over leaves and subsets of each path's features."""
    phi = np.zeros(nf)

    def leaf(value, path):
        fs = list(path)
        for k in fs:
            others = [f for f in fs if f != k]
            for r in range(len(others) + 1):
                for sub in itertools.combinations(others, r):
                    weight = math.factorial(r) * math.factorial(len(fs) - r - 1) / math.factorial(len(fs))
                    rest = math.prod(path[f][1] if f in sub else path[f][0] for f in others)
                    phi[k] += weight * value * rest * (path[k][1] - path[k][0])

    def rec(j, path):
        if tree["left"][j] < 0:
            return leaf(tree["value"][j], path)
        f = int(tree["feature"][j])
        goes = x[f] <= tree["threshold"][j]
        for child, own in ((tree["left"][j], goes), (tree["right"][j], not goes)):
            z, o = path.get(f, (1.0, 1))
            rec(child, {**path, f: (z * tree["cover"][child] / tree["cover"][j], o * int(own))})

    rec(0, {})
    return phi


def _random_tree(rng, depth, nf):
    arrays = {c: [] for c in ("left", "right", "feature", "threshold", "value", "cover")}

    def grow(level, cover):
        j = len(arrays["left"])
        for c, v in (("left", -1), ("right", -1), ("feature", -1), ("threshold", 0.0), ("value", float(rng.normal())), ("cover", cover)):
            arrays[c].append(v)
        if level and (level > depth - 3 or rng.random() < 0.6):
            share = rng.uniform(0.05, 0.95)
            arrays["feature"][j], arrays["threshold"][j] = int(rng.integers(nf)), float(rng.normal())
            arrays["left"][j] = grow(level - 1, cover * share)
            arrays["right"][j] = grow(level - 1, cover * (1 - share))
        return j

    grow(depth, 1000.0)
    return {c: np.array(v) for c, v in arrays.items()}


@pytest.mark.parametrize("depth,nf", [(3, 2), (6, 3), (10, 8), (14, 12)])
def test_deep_trees_equal_plain_shapley_values(depth, nf):
    """Paths that meet a feature again, and paths of many features."""
    rng = np.random.default_rng(depth)
    tree = _random_tree(rng, depth, nf)
    x = rng.normal(size=(6, nf))
    phi = np.zeros(x.shape)
    tree_shap(x, tree, phi, 2.0)
    for i in range(len(x)):
        assert np.allclose(phi[i], 2.0 * _plain(tree, x[i], nf), atol=1e-9)
    assert np.allclose(phi.sum(axis=1), 2.0 * (tree_predict(x, tree) - tree_expectation(tree)), atol=1e-9)


def test_quadrature_holds_for_long_paths():
    """58 features on one path: still additive."""
    nf = 58
    size = 2 * nf + 1
    left, right, feature, cover = np.full(size, -1), np.full(size, -1), np.full(size, -1), np.zeros(size)
    cover[0] = 1.0
    for i in range(nf):
        j = 0 if i == 0 else 2 * i
        left[j], right[j], feature[j] = 2 * i + 1, 2 * i + 2, i
        cover[2 * i + 1], cover[2 * i + 2] = cover[j] * 0.1, cover[j] * 0.9
    rng = np.random.default_rng(0)
    tree = {"left": left, "right": right, "feature": feature, "threshold": np.zeros(size), "value": rng.normal(size=size), "cover": cover}
    x = rng.normal(size=(4, nf)) + 1.5
    phi = np.zeros(x.shape)
    tree_shap(x, tree, phi, 1.0)
    assert path_features(tree) == nf
    assert np.allclose(phi.sum(axis=1), tree_predict(x, tree) - tree_expectation(tree), atol=1e-10)


def test_groups_of_trees_sum_to_the_whole(spark):
    df = _frame(spark)
    model = ModelTrainer(ModelFactory.create("random_forest", n_estimators=7, class_weight=None)).train(df, FEATS)
    whole = TreeExplainer(model).attributions(df).orderBy("row_id").toPandas()
    cut = TreeExplainer(model, group_nodes=60)
    assert len(cut.tables.groups) > 1
    parts = cut.attributions(df).orderBy("row_id").toPandas()
    assert np.allclose(whole.to_numpy(), parts.to_numpy(), atol=1e-12)
    with pytest.raises(E.ExplainerError, match="key"):
        cut.attributions(df.drop("row_id"))
