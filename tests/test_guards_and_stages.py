"""Guards hold whichever single feature is asked for; stages of users read what stands before them."""

import pytest
from pyspark.sql import functions as F

from tests.test_skew import skewed
from txrisk import schema as S
from txrisk.operators.stages import Stage
from txrisk.plans.chain import FeatureChain


def chain():
    return FeatureChain(risk_large_txn_threshold=500.0, amount_high_value_threshold=500.0, behavior_mode="window")


@pytest.mark.parametrize("feature", ["day", "is_weekend", "hour_sin", "risk_score", "sender_balance_delta"])
def test_negative_step_raises(spark, feature):
    df = skewed(spark, 50).withColumn(S.STEP, F.when(F.col(S.ROW_ID) == 7, -3).otherwise(F.col(S.STEP)))
    with pytest.raises(Exception, match="negative"):
        chain().transform(df).select(feature).collect()


@pytest.mark.parametrize("bad", ["null", "-1", "-5"])
@pytest.mark.parametrize("feature", ["amount_log", "receiver_balance_change", "risk_score"])
def test_bad_amount_raises(spark, feature, bad):
    df = skewed(spark, 50).withColumn(S.AMOUNT, F.expr(f"if(row_id = 7, cast({bad} as double), amount)"))
    with pytest.raises(Exception, match="amount"):
        chain().transform(df).select(feature).collect()


class Twice(Stage):
    name = "Twice"
    outputs = ("twice",)
    required = ("amount_log",)

    def columns(self, df):
        return [(F.col("amount_log") * 2).alias("twice")]


@pytest.mark.parametrize("row_local", [True, False])
@pytest.mark.parametrize("before_risk", [True, False])
def test_user_stage_reads_earlier_features(spark, row_local, before_risk):
    stage = Twice()
    stage.row_local = row_local
    c = chain()
    c.register(stage, before_risk=before_risk)
    out = c.transform(skewed(spark, 50))
    assert out.where("twice <> amount_log * 2 or twice is null").isEmpty()
    names = out.columns
    assert (names.index("twice") < names.index("risk_score")) == before_risk
