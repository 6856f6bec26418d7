"""Nothing is cut, dropped or changed without a word: arguments, offenders, labels, whole numbers in CSV."""

import pytest
from pyspark.sql import functions as F

from txrisk import errors as E
from txrisk.functions.columns import clip_probability
from txrisk.operators import metrics, models, validate


@pytest.mark.parametrize("kw", [{"max_depth": 31}, {"warm_start": True}, {"class_weight": "balanced_subsample"}, {"oob_score": "yes"}, {"nothing": 1}])
def test_forest_refuses(kw):
    with pytest.raises(E.ModelFactoryError, match=next(iter(kw))):
        models.build_random_forest(**kw)


@pytest.mark.parametrize("kw", [{"max_depth": 50}, {"eval_metric": "nonsense"}, {"reg_alpha": -1.0}, {"subsample": 0}])
def test_boosting_refuses(kw):
    with pytest.raises(E.ModelFactoryError, match=next(iter(kw))):
        models.build_boosted_trees(**kw)


@pytest.mark.parametrize("kw", [{"reg_alpha": 1.0}, {"reg_lambda": 2.0}, {"min_child_weight": 0.5}])
def test_spark_boosting_refuses(kw):
    with pytest.raises(E.ModelFactoryError, match=next(iter(kw))):
        models.ModelFactory.create("gbt", **kw)


def test_all_wrong_arguments_are_named():
    with pytest.raises(E.ModelFactoryError, match="n_estimators.*bootstrap"):
        models.build_random_forest(n_estimators=0, bootstrap=1)


def test_offenders_are_all_listed(spark):
    df = spark.range(60).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("type"))
    rule = validate.Rule("known", "type", F.col("type").startswith("T"), E.TxRiskError, "unknown types")
    assert validate.offending_values(df, rule) == (60, [f"T{i:02d}" for i in range(validate.SHOWN)])
    assert [tuple(r) for r in validate.offending_table(df, rule).collect()] == [(f"T{i:02d}", 1) for i in range(60)]


def test_labels_other_than_0_and_1_raise(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "y int, p int")
    with pytest.raises(E.MetricsError):
        metrics.validate_inputs(df, "y", "p")
    assert metrics.binary_metrics(df.limit(0), "y", "p").first()["accuracy"] is None


def test_null_probability_stays_null(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "x double").select(clip_probability("x").alias("x"))
    assert [r.x for r in df.collect()] == [None, 1.0, 0.0]
