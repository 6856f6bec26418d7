"""Property test: behaviour features on random frames equal a direct Python
computation of the formulas, in every plan (window, blocked, tiny blocks)."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from txrisk import schema as S
from txrisk.operators.behavior import BehaviorFeatures

ROW = st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 2),
                st.integers(0, 100000).map(lambda c: c / 100))


def expected(rows):
    """rows: (row_id, step, sender, receiver, amount) -> {row_id: features}."""
    out = {rid: {} for rid, *_ in rows}
    for side, idx in (("sender", 2), ("receiver", 3)):
        by = {}
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            by.setdefault(r[idx], []).append(r)
        for acc in by.values():
            total, prev = 0.0, None
            from decimal import Decimal
            dsum = Decimal(0)
            for k, (rid, step, _, _, amt) in enumerate(acc):
                mean = amt if k == 0 else float(dsum) / k
                mean32 = float(np.float32(mean))
                gap = -1.0 if prev is None else float(step - prev)
                f = out[rid]
                f[f"{side}_txn_count"] = k + 1
                f[f"{side}_time_gap"] = gap
                f[f"{side}_avg_amount"] = mean32
                f[f"{side}_amount_deviation"] = float(np.float32(amt - mean32))
                f[f"is_first_{side}_transaction"] = int(k == 0)
                f[f"rapid_{side}_activity"] = int(0 <= gap <= 1)
                prev = step
                dsum += Decimal(str(amt))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=40))
def test_behavior_matches_direct_computation(spark, raw):
    rows = [(i * 3 + 1, step, f"C{s}", f"M{r}", amt) for i, (step, s, r, amt) in enumerate(raw)]
    df = spark.createDataFrame(
        [(rid, step, "PAYMENT", amt, s, 0.0, 0.0, r, 0.0, 0.0, 0, 0) for rid, step, s, r, amt in rows],
        "row_id bigint, step int, type string, amount double, nameOrig string, oldbalanceOrg double, "
        "newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, "
        "isFraud int, isFlaggedFraud int").repartition(3)
    want = expected(rows)
    for stage in (BehaviorFeatures("window"), BehaviorFeatures("blocked"),
                  BehaviorFeatures("blocked", ranges=20)):
        got = {r[S.ROW_ID]: r for r in stage.transform(df).collect()}
        for rid, feats in want.items():
            for k, v in feats.items():
                g = got[rid][k]
                assert math.isclose(g, v, rel_tol=1e-6, abs_tol=1e-6), (stage.mode, rid, k, g, v)
