"""Second-order boosting against a plain NumPy version, its penalties, and its persistence."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from txrisk import errors as E
from txrisk.operators import boosting as B
from txrisk.operators import models as M

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a, b, c = float(rng.integers(0, 12)), float(rng.integers(0, 4)), float(rng.integers(0, 2))
        rows.append((i, a, b, c, int(a + 3 * b * c + rng.normal() > 6)))
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, isFraud int").repartition(3)


def plain(x, y, weight, rounds, depth, rate, lam, alpha, gamma, least):
    """The same trees by exhaustive search over all values; returns margins."""
    margin = np.zeros(len(x))
    score = lambda g, h: B.soft(g, alpha) ** 2 / (h + lam)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        step = np.zeros(len(x))

        def grow(rows, level):
            best = (-np.inf, None, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in np.unique(x[:, f])[:-1]:
                        left = rows & (x[:, f] <= cut)
                        right = rows & ~left
                        if not left.any() or not right.any() or min(h[left].sum(), h[right].sum()) < least:
                            continue
                        gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum())
                        if gain > best[0] + 1e-9:
                            best = (gain, left, right)
            if best[0] > max(gamma, 1e-6):
                grow(best[1], level + 1)
                grow(best[2], level + 1)
            else:
                step[rows] = -B.soft(g[rows].sum(), alpha) / (h[rows].sum() + lam) * rate

        grow(np.ones(len(x), bool), 0)
        margin = margin + step
    return margin


@pytest.mark.parametrize("kw", [
    dict(n_estimators=1, max_depth=1),
    dict(n_estimators=7, max_depth=3, learning_rate=0.4, checkpoint_interval=2),
    dict(n_estimators=3, max_depth=4, reg_lambda=5.0, reg_alpha=2.0, gamma=0.5, min_child_weight=4),
    dict(n_estimators=2, max_depth=2, scale_pos_weight=3.0, reg_lambda=0.25),
])
def test_equals_the_plain_version(spark, frame, kw):
    kw = dict(subsample=1.0, colsample_bytree=1.0) | kw
    model = M.ModelTrainer(M.build_boosted_trees(**kw)).train(frame, FEATS)
    rows = frame.orderBy("row_id").toPandas()
    x, y = rows[FEATS].to_numpy(), rows["isFraud"].to_numpy().astype(float)
    weight = np.where(y == 1, kw.get("scale_pos_weight", 1.0), 1.0)
    want = plain(x, y, weight, kw["n_estimators"], kw["max_depth"], kw.get("learning_rate", 0.05), kw.get("reg_lambda", 1.0), kw.get("reg_alpha", 0.0),
                 kw.get("gamma", 0.0), kw.get("min_child_weight", 1))
    got = M.score(model, frame).orderBy("row_id").toPandas()["score"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-want)), atol=1e-7)


def test_partitions_do_not_change_a_model(spark, frame):
    spec = dict(n_estimators=4, max_depth=3)
    one, other = (M.ModelTrainer(M.build_boosted_trees(subsample=1.0, **spec)).train(f, FEATS).stages[-1].nodes for f in (frame, frame.repartition(7)))
    assert one.equals(other)


def test_shares_of_rows_and_features(spark, frame):
    model = M.ModelTrainer(M.build_boosted_trees(n_estimators=6, max_depth=2, subsample=0.5, colsample_bytree=0.34)).train(frame, FEATS).stages[-1]
    used = model.nodes[model.nodes.left >= 0].groupby("tree").feature.nunique()
    assert (used <= 2).all()
    root = model.nodes[(model.nodes.tree == 0) & (model.nodes.id == 0)].cover.iloc[0]
    assert 0.4 * 100 < root < 0.6 * 100  # hessian 0.25 a row of 400, half of them drawn


def test_saved_and_loaded(spark, frame, tmp_path):
    model = M.ModelTrainer(M.build_boosted_trees(n_estimators=5, max_depth=3)).train(frame, FEATS)
    path = M.save_model(model, str(tmp_path / "m"))
    again = M.load_model(path)
    assert isinstance(again, PipelineModel) and again.stages[-1].nodes.equals(model.stages[-1].nodes)
    a, b = (M.score(m, frame).orderBy("row_id").toPandas()["score"] for m in (model, again))
    assert a.equals(b)
    report = M.evaluate(again, frame)
    assert report["metrics"]["accuracy"] > 0.8
    shares = report["feature_importance"].toPandas()
    assert abs(shares["importance"].sum() - 1) < 1e-9 and set(shares["feature"]) == set(FEATS)


def test_quantile_bins_of_many_values(spark):
    df = spark.range(5000).selectExpr("cast(id as double) a", "cast(id % 3 as double) b", "cast(id > 2500 as int) isFraud")
    edges = B.bin_edges(df, ["a", "b"], 16)
    assert len(edges[0]) == 15 and np.all(np.diff(edges[0]) > 200) and edges[1].tolist() == [0.0, 1.0]
    model = M.ModelTrainer(M.build_boosted_trees(n_estimators=3, max_depth=2, max_bins=64)).train(df, ["a", "b"])
    assert M.evaluate(model, df)["metrics"]["accuracy"] > 0.97
    with pytest.raises(E.ModelFactoryError, match="max_bins"):
        M.build_boosted_trees(max_bins=257)


def test_constant_features_give_no_splits(spark):
    df = spark.range(40).selectExpr("1.0d a", "cast(id % 2 as int) isFraud")
    model = M.ModelTrainer(M.build_boosted_trees(n_estimators=3, subsample=1.0, colsample_bytree=1.0)).train(df, ["a"])
    assert {round(r.score, 9) for r in M.score(model, df).collect()} == {0.5}
