"""Split (L1, L2, V10, V11), metrics closed forms (E1-E8) and exact quantiles (A1, A2)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk import errors as E
from txrisk.operators import metrics as M
from txrisk.operators.quantile import exact_quantiles
from txrisk.operators.split import StratifiedSplitter, largest_remainder


def labeled(spark, n=1000, pos=37):
    rows = [(i, 1 if i % (n // pos) == 0 and i // (n // pos) < pos else 0) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, isFraud int")


def test_exact_stratified_counts(spark):
    df = labeled(spark)
    counts = {r["isFraud"]: r["c"] for r in df.groupBy("isFraud").agg(F.count("*").alias("c")).collect()}
    sp = StratifiedSplitter(test_size=0.2, random_state=42)
    a = sp.assign(df)
    got = {(r["split"], r["isFraud"]): r["n"] for r in a.groupBy("split", "isFraud").agg(F.count("*").alias("n")).collect()}
    n_test = math.ceil(0.2 * 1000)
    assert got[("test", 0)] + got[("test", 1)] == n_test
    kept = largest_remainder(counts, 1000 - n_test)
    assert got[("test", 1)] == counts[1] - kept[1]
    assert got[("train", 1)] > 0 and got[("test", 1)] > 0


def test_split_is_deterministic_and_partition_free(spark):
    df = labeled(spark)
    a = {r["row_id"]: r["split"] for r in StratifiedSplitter().assign(df.repartition(7)).collect()}
    b = {r["row_id"]: r["split"] for r in StratifiedSplitter().assign(df.repartition(1)).collect()}
    assert a == b
    c = {r["row_id"]: r["split"] for r in StratifiedSplitter(random_state=1).assign(df).collect()}
    assert a != c


def test_refinement_path_and_validation_split(spark):
    from txrisk.operators import split as SP

    df = labeled(spark, 3000, 90)
    sp = StratifiedSplitter(test_size=0.2, validation_size=0.1)
    old = SP.DIRECT_ROWS
    SP.DIRECT_ROWS = 3  # force several refinement levels
    try:
        a = sp.assign(df)
        got = {r["split"]: r["n"] for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()}
    finally:
        SP.DIRECT_ROWS = old
    assert got["test"] == math.ceil(0.2 * 3000)
    assert got["validation"] == math.ceil(0.3 * 3000) - math.ceil(0.2 * 3000)


def test_unstratified(spark):
    a = StratifiedSplitter(stratify=False).assign(labeled(spark))
    assert a.where("split = 'test'").count() == 200


@pytest.mark.parametrize("kw,exc", [
    (dict(test_size=0.0), ValueError), (dict(test_size=1.0), ValueError), (dict(random_state=1.5), TypeError)])
def test_split_params(kw, exc):
    with pytest.raises(exc):
        StratifiedSplitter(**kw)


def test_split_preconditions(spark):
    one = spark.createDataFrame([(i, 0) for i in range(10)], "row_id bigint, isFraud int")
    with pytest.raises(E.DataSplitError, match="two classes"):
        StratifiedSplitter().assign(one)
    tiny = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "row_id bigint, isFraud int")
    with pytest.raises(E.DataSplitError):
        StratifiedSplitter().assign(tiny)
    nulls = spark.createDataFrame([(0, None), (1, 1), (2, 0)], "row_id bigint, isFraud int")
    with pytest.raises(E.DataSplitError, match="null"):
        StratifiedSplitter().assign(nulls)


FIX = [(0.9, 1), (0.9, 0), (0.8, 1), (0.4, 0), (0.3, 1), (0.1, 0)]


def test_metric_closed_forms(spark):
    df = spark.createDataFrame(FIX, "score double, isFraud int")
    m = M.evaluate_scores(df)
    for k in ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score"):
        assert m[k] == pytest.approx(2 / 3)
    assert m["mcc"] == pytest.approx(1 / 3)
    assert m["roc_auc"] == pytest.approx(5.5 / 9)
    assert m["pr_auc"] == pytest.approx(0.627778, abs=1e-6)
    assert m["confusion_matrix"] == [[2, 1], [1, 2]]


def test_one_class_gives_null_auc(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0)], "score double, isFraud int")
    assert M.roc_auc(df) is None and M.pr_auc(df) is None


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, isFraud int")
    pos, neg = s[y == 1], s[y == 0]
    want = sum(((p > neg).sum() + 0.5 * (p == neg).sum()) for p in pos) / (len(pos) * len(neg))
    for b in (1, 5, 64):
        assert M.roc_auc(df, buckets=b) == pytest.approx(want, abs=1e-12)
    # PR trapezoid by direct construction
    th = np.unique(s)[::-1]
    tp = np.array([(pos >= t).sum() for t in th], float)
    fp = np.array([(neg >= t).sum() for t in th], float)
    prec = np.r_[1.0, tp / (tp + fp)]
    rec = np.r_[0.0, tp / len(pos)]
    want_pr = float(np.sum(np.diff(rec) * (prec[1:] + prec[:-1]) / 2))
    for b in (1, 7):
        assert M.pr_auc(df, buckets=b) == pytest.approx(want_pr, abs=1e-12)


def test_confusion_normalize_and_report(spark):
    df = spark.createDataFrame(FIX, "score double, isFraud int").withColumn("prediction", M.predict_at("score"))
    v = {(r["true_label"], r["predicted_label"]): r["value"]
         for r in M.confusion_matrix(df, normalize="true").collect()}
    assert v[(0, 0)] == pytest.approx(2 / 3) and v[(1, 1)] == pytest.approx(2 / 3)
    allv = sum(r["value"] for r in M.confusion_matrix(df, normalize="all").collect())
    assert allv == pytest.approx(1.0)
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["1"]["support"] == 3
    with pytest.raises(E.ConfusionMatrixError):
        M.confusion_matrix(df, normalize="rows")
    with pytest.raises(E.MetricsError):
        M.predict_at("score", 1.5)


def test_metric_input_validation(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (1, 1)], "isFraud int, prediction int")
    M.validate_inputs(df.where("prediction < 2"), "isFraud", "prediction")
    three = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "isFraud int, prediction int")
    with pytest.raises(E.MetricsError):
        M.validate_inputs(three, "isFraud", "prediction")


@pytest.mark.parametrize("max_rows,buckets", [(100_000, 1024), (50, 8), (7, 3)])
def test_exact_quantiles_equal_pandas(spark, max_rows, buckets):
    rng = np.random.default_rng(5)
    vals = np.r_[np.round(rng.lognormal(8, 2, 3000), 2), np.full(500, 181.0), [0.0] * 40]
    df = spark.createDataFrame([(float(v),) for v in vals], "amount double")
    qs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = exact_quantiles(df, "amount", qs, buckets=buckets, max_rows=max_rows)
    want = [float(pd.Series(vals).quantile(q)) for q in qs]
    assert got == want


def test_quantile_golden_fixture(spark):
    df = spark.createDataFrame([(100.0,), (5000.0,), (2500.0,), (300.0,), (10000.0,)], "amount double")
    assert exact_quantiles(df, "amount", [0.95]) == [9000.0]


def test_compute_with_and_without_probabilities(spark):
    df = spark.createDataFrame(FIX, "score double, isFraud int").withColumn("prediction", M.predict_at("score"))
    m = M.compute(df)
    assert m["roc_auc"] is None and m["accuracy"] == pytest.approx(2 / 3)
    m = M.compute(df, prob="score")
    assert m["roc_auc"] == pytest.approx(5.5 / 9) and m["pr_auc"] == pytest.approx(0.627778, abs=1e-6)
