"""Hot accounts: one receiver with a third of all rows routes to the blocked plan,
and every plan gives bit-identical behaviour features."""

import pytest
from pyspark.sql import functions as F

from txrisk.operators.behavior import RANGE, BehaviorFeatures, edge_carry, hot_sides, ranged
from txrisk import schema as S


def skewed(spark, n=3000):
    rows = []
    for i in range(n):
        dest = "M_HOT" if i % 3 == 0 else f"M{i % 50}"
        step = (i * 7) % 40          # many rows share a step
        rows.append((i, step, "PAYMENT", float(10 + (i * 37) % 1000) + 0.25, f"C{i % 97}",
                     1000.0, 900.0, dest, 0.0, 0.0, 0, 0))
    return spark.createDataFrame(rows, "row_id bigint, step int, type string, amount double, nameOrig string, "
                                       "oldbalanceOrg double, newbalanceOrig double, nameDest string, "
                                       "oldbalanceDest double, newbalanceDest double, isFraud int, isFlaggedFraud int")


def test_probe_flags_only_the_hot_side(spark):
    df = skewed(spark)
    hot = hot_sides(df, hot_key_rows=500, fraction=1.0)
    assert hot == {"sender": False, "receiver": True}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_blocked_equals_window_on_hot_key(spark, ranges):
    df = skewed(spark).repartition(5)
    auto = BehaviorFeatures("auto", ranges=ranges, hot_key_rows=500, probe_fraction=1.0)
    a = {r[S.ROW_ID]: r for r in auto.transform(df).collect()}
    assert auto.last_plan == {"sender": "window", "receiver": "blocked"}
    w = {r[S.ROW_ID]: r for r in BehaviorFeatures("window").transform(df).collect()}
    assert a.keys() == w.keys()
    for k in a:
        assert a[k].asDict() == w[k].asDict()
    hot = [r for r in w.values() if r[S.NAME_DEST] == "M_HOT"]
    assert max(r["receiver_txn_count"] for r in hot) == 1000


def same_features(got, want):
    a = {r[S.ROW_ID]: r.asDict() for r in got.collect()}
    assert a == {r[S.ROW_ID]: r.asDict() for r in want.collect()}


def test_sparse_ids(spark):
    df = skewed(spark).withColumn(S.ROW_ID, F.col(S.ROW_ID) * 1_000_003 + 17)  # same order, wide gaps
    same_features(BehaviorFeatures("blocked", ranges=9).transform(df), BehaviorFeatures("window").transform(df))


def test_one_account_over_many_steps(spark):
    """One receiver has all rows, in 743 steps: the carry has a row a range, however many steps there are."""
    df = skewed(spark).withColumn(S.NAME_DEST, F.lit("M_ALL")).withColumn(S.STEP, (F.col(S.ROW_ID) * 31 % 743).cast("int"))
    same_features(BehaviorFeatures("blocked", ranges=12).transform(df), BehaviorFeatures("window").transform(df))
    rows = ranged(df, "receiver", 12)
    per = [r["count"] for r in rows.groupBy(RANGE).count().collect()]
    assert len(per) == 12 and max(per) < 2 * 3000 / 12
    assert edge_carry(rows, S.NAME_DEST).count() == 11


def test_carry_is_bounded_by_the_ranges(spark):
    rows = ranged(skewed(spark), "sender", 10)
    assert edge_carry(rows, S.NAME_ORIG).count() <= 2 * 10


def test_null_accounts_are_one_account(spark):
    df = skewed(spark, 400).withColumn(S.NAME_DEST, F.when(F.col(S.ROW_ID) % 2 == 0, F.col(S.NAME_DEST)))
    same_features(BehaviorFeatures("blocked", ranges=8).transform(df), BehaviorFeatures("window").transform(df))


def test_empty_table(spark):
    df = skewed(spark, 5).where("step < 0")
    assert BehaviorFeatures("blocked", ranges=4).transform(df).count() == 0


def test_probe_default_fraction_follows_threshold(spark):
    from txrisk.operators.behavior import probe_fraction

    assert probe_fraction(1 << 20) < 0.001 and probe_fraction(100) == 1.0
    assert hot_sides(skewed(spark), hot_key_rows=500) == {"sender": False, "receiver": True}


def test_chain_skips_probe_for_small_fitted_frame(spark, monkeypatch):
    from txrisk.operators import behavior as B
    from txrisk.plans.chain import FeatureChain

    calls = []
    real = B.hot_sides
    monkeypatch.setattr(B, "hot_sides", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = skewed(spark, 300)
    chain = FeatureChain().fit(df)
    chain.transform(df).count()
    assert calls == []                                  # 300 rows <= hot_key_rows: no account can be hot
    other = df.where("step >= 0")                       # a different frame: the probe runs
    chain.transform(other).count()
    assert calls == [1]
