"""The forest that knows its bags: against a plain recursion, and its out-of-bag scores against a loop over trees."""

import numpy as np
import pytest

from txrisk import errors as E
from txrisk.operators import forest as H
from txrisk.operators import models as M
from txrisk.operators.explain import TreeExplainer

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b, c = int(rng.integers(0, 8)), int(rng.integers(0, 5)), int(rng.integers(0, 3))
        rows.append((i * 7_000_000_019, float(a), float(b), float(c), int(rng.random() < (0.8 if a > 4 and b < 3 else 0.15))))
    return rows, spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, isFraud int").repartition(3)


def _plain(x, y, times, weights, depth, least_split, least_leaf):
    """Share of class 1 for every row of x, by a tree grown on the rows drawn."""
    use = times > 0
    w = np.where(y == 1, weights[1], weights[0]) * times
    out = np.full(len(x), (w * y)[use].sum() / w[use].sum())
    if depth == 0 or use.sum() < max(least_split, 2 * least_leaf) or len(set(y[use])) < 2:
        return out

    def gini(rows):
        total, p = w[rows].sum(), (w * y)[rows].sum()
        return 2 * p * (total - p) / total if total else 0.0

    best = (1e-9, None)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            left, right = use & (x[:, f] <= cut), use & (x[:, f] > cut)
            if min(left.sum(), right.sum()) >= least_leaf:
                gain = round(gini(use) - gini(left) - gini(right), 9)
                if gain > best[0]:
                    best = (gain, (f, cut))
    if best[1] is None:
        return out
    f, cut = best[1]
    for part in (x[:, f] <= cut, x[:, f] > cut):
        out[part] = _plain(x[part], y[part], times[part], weights, depth - 1, least_split, least_leaf)
    return out


def _reference(rows, trees, seed, **kw):
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    key = np.array([r[0] for r in rows])
    weights = [len(y) / (2 * (y == c).sum()) for c in (0, 1)]
    times = [H.draws(key, t, seed) for t in range(trees)]
    return key, y, times, [_plain(x, y, t, weights, **kw) for t in times]


def test_forest_equals_a_plain_one(spark, table):
    rows, df = table
    spec = M.build_random_forest(n_estimators=6, max_depth=4, max_features=None, oob_score=True, min_samples_split=30, min_samples_leaf=7, random_state=3)
    model = M.ModelTrainer(spec).train(df, FEATS)
    key, y, times, shares = _reference(rows, 6, 3, depth=4, least_split=30, least_leaf=7)
    got = {r["row_id"]: r["score"] for r in M.score(model, df).collect()}
    assert [got[k] for k in key.tolist()] == pytest.approx(np.mean(shares, axis=0).tolist(), abs=1e-12)

    own = model.stages[-1]
    seen = {r["row_id"]: (r["oob_trees"], r["oob_score"]) for r in own.out_of_bag(model.stages[0].transform(df), "row_id").collect()}
    right = n = 0
    for i, k in enumerate(key.tolist()):
        out = [s[i] for t, s in zip(times, shares, strict=True) if t[i] == 0]
        assert seen[k][0] == len(out)
        assert seen[k][1] == (pytest.approx(np.mean(out), abs=1e-12) if out else None)
        if out:
            n, right = n + 1, right + ((np.mean(out) > 0.5) == (y[i] == 1))
    assert own.oob_rows == n and own.oob_score == pytest.approx(right / n)


def test_bags_do_not_depend_on_partitions_or_on_the_size_of_a_job(spark, table):
    _, df = table
    kw = dict(numTrees=4, maxDepth=5, keyCol="row_id", seed=9, featureSubsetStrategy="sqrt", labelCol="isFraud")
    from pyspark.ml.feature import VectorAssembler

    frame = VectorAssembler(inputCols=FEATS, outputCol="features").transform(df)
    nodes = H.HistogramForest(**kw).fit(frame).nodes
    again = H.HistogramForest(**kw).fit(frame.repartition(7)).nodes
    assert nodes.equals(again)
    small = H.HistogramForest(**kw)
    small._set(histogramMb=0)  # one node a job
    assert _paths(small.fit(frame).nodes) == _paths(nodes)


def _paths(nodes):
    """Leaves by tree: path of cuts and value (node numbers may differ)."""
    out = set()
    for t, part in nodes.groupby("tree"):
        at = part.set_index("id")

        def walk(i, path, t=t, at=at):
            r = at.loc[i]
            if r["left"] < 0:
                out.add((t, path, round(r["value"], 12)))
            else:
                cut = (int(r["feature"]), float(r["threshold"]))
                walk(int(r["left"]), (*path, (*cut, "l")), t, at)
                walk(int(r["right"]), (*path, (*cut, "r")), t, at)

        walk(0, ())
    return out


def test_draws_are_poisson():
    times = H.draws(np.arange(200_000), 3, 42)
    assert np.mean(times == 0) == pytest.approx(np.exp(-1), abs=0.005) and times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02)
    both = np.corrcoef(times, H.draws(np.arange(200_000), 4, 42))[0, 1]
    assert abs(both) < 0.01


def test_saved_forest_and_attributions(spark, table, tmp_path):
    _, df = table
    model = M.ModelTrainer(M.build_random_forest(n_estimators=5, max_depth=4, min_samples_split=0.1, oob_score=True)).train(df, FEATS)
    assert model.stages[-1].getOrDefault("minRowsSplit") == 60
    again = M.load_model(M.save_model(model, str(tmp_path / "forest")))
    assert again.stages[-1].oob_score == model.stages[-1].oob_score is not None
    scores = {r["row_id"]: r["score"] for r in M.score(model, df).collect()}
    assert scores == {r["row_id"]: r["score"] for r in M.score(again, df).collect()}
    explainer = TreeExplainer(model)
    assert explainer.scales == [0.2] * 5
    assert sum(r["importance"] for r in M.feature_importance(model).collect()) == pytest.approx(1)


def test_out_of_bag_needs_a_key(spark, table):
    _, df = table
    with pytest.raises(E.ModelTrainingError, match="row_id"):
        M.ModelTrainer(M.build_random_forest(n_estimators=2, oob_score=True)).train(df.drop("row_id"), FEATS)
    model = M.ModelTrainer(M.build_random_forest(n_estimators=2, max_depth=2, min_samples_split=9)).train(df.drop("row_id"), FEATS)
    with pytest.raises(ValueError, match="key"):
        model.stages[-1].out_of_bag(model.stages[0].transform(df))


def test_one_class_and_one_row(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 1)], "row_id bigint, a double, b double, c double, isFraud int")
    model = M.ModelTrainer(M.build_random_forest(n_estimators=3, oob_score=True)).train(df, FEATS)
    (row,) = M.score(model, df).collect()
    times = [int(H.draws(np.array([1]), t, 42)[0]) for t in range(3)]
    assert row["score"] == pytest.approx(sum(t > 0 for t in times) / 3)
