"""Golden values for all 58 features on the 8-row edge fixture (FIXTURES.md §4).

Covers step order unlike input order, ties in a step, repeated senders and
receivers, zero balances, bucket edges and the float32 0.9 edge. The result
must not depend on partitioning (invariance) and the plan must stay free of
Python and single-partition operators.
"""

import math

import pytest

from txrisk import schema as S
from txrisk.plans.chain import FeatureChain

ROWS = [
    # row_id, step, type, amount, nameOrig, oldOrg, newOrig, nameDest, oldDest, newDest, isFraud, flagged
    (0, 5, "PAYMENT", 100.0, "C1", 1000.0, 900.0, "M1", 0.0, 0.0, 0, 0),
    (1, 1, "TRANSFER", 181.0, "C2", 181.0, 0.0, "C9", 0.0, 0.0, 1, 0),
    (2, 1, "CASH_OUT", 181.0, "C9", 181.0, 0.0, "C8", 21182.0, 0.0, 1, 0),
    (3, 5, "CASH_IN", 1000.0, "C1", 900.0, 1900.0, "M1", 500.0, 1500.0, 0, 0),
    (4, 6, "DEBIT", 50000.01, "C1", 0.0, 0.0, "M1", 1500.0, 51500.01, 0, 0),
    (5, 30, "TRANSFER", 0.0, "C2", 10.0, 10.0, "C9", 0.0, 0.0, 0, 0),
    (6, 168, "CASH_OUT", 10000.0, "C3", 100000.0, 90000.0, "C9", 0.0, 10000.0, 0, 0),
    (7, 168, "PAYMENT", 10000.01, "C3", 90000.0, 79999.99, "M1", 51500.01, 61500.02, 0, 0),
]
COLUMNS = [S.ROW_ID, S.STEP, S.TYPE, S.AMOUNT, S.NAME_ORIG, S.OLD_ORIG, S.NEW_ORIG,
           S.NAME_DEST, S.OLD_DEST, S.NEW_DEST, S.LABEL, S.FLAGGED]
SCHEMA = ("row_id bigint, step int, type string, amount double, nameOrig string, "
          "oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, "
          "newbalanceDest double, isFraud int, isFlaggedFraud int")

GOLDEN = {
    "amount_log": [4.615121, 5.204007, 5.204007, 6.908755, 10.819798, 0.0, 9.21044, 9.210441],
    "amount_bucket": [0.0, 1.0, 1.0, 1.0, 4.0, 0.0, 2.0, 3.0],
    "is_high_value": [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0],
    "sender_balance_ratio": [0.1, 1.0, 1.0, 1.111111, 0.0, 0.0, 0.1, 0.111111],
    "receiver_balance_change": [0.0, 0.0, -21182.0, 1000.0, 50000.01, 0.0, 10000.0, 10000.01],
    "sender_balance_change": [100.0, 181.0, 181.0, -1000.0, 0.0, 0.0, 10000.0, 10000.01],
    "sender_balance_error": [0.0, 0.0, 0.0, -2000.0, -50000.01, 0.0, 0.0, 0.0],
    "receiver_balance_error": [100.0, 181.0, 21363.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "balance_anomaly": [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0],
    "sender_balance_delta": [100.0, 181.0, 181.0, -1000.0, 0.0, 0.0, 10000.0, 10000.007812],
    "receiver_balance_delta": [0.0, 0.0, -21182.0, 1000.0, 50000.011719, 0.0, 10000.0, 10000.007812],
    "sender_balance_pct_change": [0.1, 1.0, 1.0, -1.111111, 0.0, 0.0, 0.1, 0.111111],
    "receiver_balance_pct_change": [0.0, 0.0, -1.0, 2.0, 33.33334, 0.0, 0.0, 0.194175],
    "remaining_sender_ratio": [0.9, 0.0, 0.0, 2.111111, 0.0, 1.0, 0.9, 0.888889],
    "receiver_growth_ratio": [0.0, 0.0, 0.0, 3.0, 34.33334, 0.0, 0.0, 1.194175],
    "sender_zero_before": [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0],
    "sender_zero_after": [0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0],
    "receiver_zero_before": [1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0],
    "receiver_zero_after": [1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0],
    "negative_balance_flag": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "sender_balance_exhausted": [0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "sender_balance_mismatch": [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0],
    "receiver_balance_mismatch": [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "receiver_zero_balance_anomaly": [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "sender_txn_count": [1.0, 1.0, 1.0, 2.0, 3.0, 2.0, 1.0, 2.0],
    "sender_time_gap": [-1.0, -1.0, -1.0, 0.0, 1.0, 29.0, -1.0, 0.0],
    "sender_avg_amount": [100.0, 181.0, 181.0, 100.0, 550.0, 181.0, 10000.0, 10000.0],
    "sender_amount_deviation": [0.0, 0.0, 0.0, 900.0, 49450.011719, -181.0, 0.0, 0.01],
    "is_first_sender_transaction": [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
    "rapid_sender_activity": [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0],
    "receiver_txn_count": [1.0, 1.0, 1.0, 2.0, 3.0, 2.0, 3.0, 4.0],
    "receiver_time_gap": [-1.0, -1.0, -1.0, 0.0, 1.0, 29.0, 138.0, 162.0],
    "receiver_avg_amount": [100.0, 181.0, 181.0, 100.0, 550.0, 181.0, 90.5, 17033.335938],
    "receiver_amount_deviation": [0.0, 0.0, 0.0, 900.0, 49450.011719, -181.0, 9909.5, -7033.326172],
    "is_first_receiver_transaction": [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "rapid_receiver_activity": [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0],
    "hour": [5.0, 1.0, 1.0, 5.0, 6.0, 6.0, 0.0, 0.0],
    "day": [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 7.0, 7.0],
    "day_of_week": [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0],
    "week": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0],
    "is_weekend": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "is_night": [1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0],
    "is_morning": [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0],
    "is_afternoon": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "is_evening": [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "hour_sin": [0.965926, 0.258819, 0.258819, 0.965926, 1.0, 1.0, 0.0, 0.0],
    "hour_cos": [0.258819, 0.965926, 0.965926, 0.258819, 0.0, 0.0, 1.0, 1.0],
    "day_sin": [0.0, 0.0, 0.0, 0.0, 0.0, 0.781832, 0.0, 0.0],
    "day_cos": [1.0, 1.0, 1.0, 1.0, 1.0, 0.62349, 1.0, 1.0],
    "risk_large_transaction": [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0],
    "risk_balance_drained": [0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "risk_new_receiver": [1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0],
    "risk_rapid_activity": [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0],
    "risk_first_transaction": [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
    "risk_balance_anomaly": [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0],
    "risk_high_balance_usage": [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0],
    "risk_score": [3.0, 3.0, 2.0, 3.0, 3.0, 2.0, 3.0, 1.0],
    "high_risk_transaction": [1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0],
}


def edge_frame(spark, partitions=1):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(partitions)


def _close(got, want):
    if want == 0:
        return abs(got) <= 1e-6
    return abs(got - want) <= 1e-6 * abs(want) + 1e-6


def _run(spark, partitions, **kw):
    df = edge_frame(spark, partitions)
    chain = FeatureChain(**kw).fit(df)
    return chain, {r[S.ROW_ID]: r for r in chain.transform(df).collect()}


def test_thresholds(spark):
    chain, _ = _run(spark, 1)
    assert chain.amount.high_value_threshold == pytest.approx(36000.01)
    assert chain.risk.large_txn_threshold == pytest.approx(36000.01)


@pytest.mark.parametrize("mode,ranges", [("blocked", None), ("window", None), ("blocked", 2)])
def test_all_58_features(spark, mode, ranges):
    _, rows = _run(spark, 3, behavior_mode=mode, behavior_ranges=ranges)
    assert len(GOLDEN) == 58
    for name, want in GOLDEN.items():
        for rid in range(8):
            got = float(rows[rid][name])
            assert _close(got, want[rid]), (name, rid, got, want[rid])


def test_type_and_order_of_columns(spark):
    chain, _ = _run(spark, 1)
    out = chain.transform(edge_frame(spark))
    assert out.columns == COLUMNS + list(S.ALL_FEATURES)
    types = dict(out.dtypes)
    assert types["amount_bucket"] == "tinyint"
    assert types["sender_balance_delta"] == "float"
    assert types["sender_txn_count"] == "int"
    assert types["day"] == "smallint"
    assert types["amount_log"] == "double"


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_invariant_under_partitioning(spark, partitions):
    _, base = _run(spark, 1)
    _, other = _run(spark, partitions)
    for rid in range(8):
        assert base[rid].asDict() == other[rid].asDict()


def test_float32_literal_edge(spark):
    # rows 0 and 6: remaining ratio is float32(0.9); must compare as float32
    _, rows = _run(spark, 1)
    assert rows[0]["risk_high_balance_usage"] == 1
    assert rows[6]["risk_high_balance_usage"] == 1


def test_plan_has_no_python_and_no_single_partition(spark):
    df = edge_frame(spark, 2)
    chain = FeatureChain(risk_large_txn_threshold=1.0, amount_high_value_threshold=1.0, behavior_mode="window")
    plan = chain.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan
    # window mode: exactly one hash exchange per side (plus the repartition of the fixture)
    assert plan.count("Exchange hashpartitioning") == 2


def test_blocked_plan_is_python_free(spark):
    df = edge_frame(spark, 2)
    chain = FeatureChain(risk_large_txn_threshold=1.0, amount_high_value_threshold=1.0)
    plan = chain.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "SinglePartition" not in plan


def test_no_nan_and_finite(spark):
    _, rows = _run(spark, 2)
    for r in rows.values():
        for k, v in r.asDict().items():
            if isinstance(v, float):
                assert math.isfinite(v), k


def test_sorted_output_follows_step_then_input_order(spark):
    chain, _ = _run(spark, 1)
    rows = chain.transform(edge_frame(spark, 4), sort=True).collect()
    assert [r[S.ROW_ID] for r in rows] == [1, 2, 0, 3, 4, 5, 6, 7]


def test_negative_step_fails_time_stage(spark):
    from txrisk.operators.stages import TimeFeatures

    df = spark.createDataFrame([(0, 5), (1, -3)], "row_id bigint, step int")
    with pytest.raises(Exception, match="negative"):
        TimeFeatures().transform(df).collect()
    assert TimeFeatures().transform(df.where("step >= 0")).count() == 1
