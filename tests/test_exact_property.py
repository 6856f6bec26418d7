"""Property tests of the exact distributed algorithms against direct computations."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from txrisk.operators import metrics as M
from txrisk.operators.quantile import exact_quantiles
from txrisk.operators.split import StratifiedSplitter, largest_remainder

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300),
       st.lists(st.floats(0, 1), min_size=1, max_size=4),
       st.integers(2, 9), st.integers(3, 40))
def test_quantiles_equal_pandas(spark, ints, qs, buckets, max_rows):
    vals = [i / 4 for i in ints]  # many duplicates
    df = spark.createDataFrame([(v,) for v in vals], "amount double")
    got = exact_quantiles(df, "amount", qs, buckets=buckets, max_rows=max_rows)
    want = [float(pd.Series(vals).quantile(q)) for q in qs]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=2, max_size=200),
       st.integers(1, 6))
def test_aucs_equal_brute_force(spark, rows, buckets):
    df = spark.createDataFrame([(s / 12, int(y)) for s, y in rows], "score double, isFraud int")
    s = np.array([r[0] for r in rows]) / 12
    y = np.array([r[1] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        assert M.roc_auc(df, buckets=buckets) is None and M.pr_auc(df, buckets=buckets) is None
        assert M.score_aucs(df, buckets=buckets) == (None, None)
        return
    roc = sum(((p > neg).sum() + 0.5 * (p == neg).sum()) for p in pos) / (len(pos) * len(neg))
    th = np.unique(s)[::-1]
    tp = np.array([(pos >= t).sum() for t in th], float)
    fp = np.array([(neg >= t).sum() for t in th], float)
    prec, rec = np.r_[1.0, tp / (tp + fp)], np.r_[0.0, tp / len(pos)]
    pr = float(np.sum(np.diff(rec) * (prec[1:] + prec[:-1]) / 2))
    assert math.isclose(M.roc_auc(df, buckets=buckets), roc, abs_tol=1e-12)
    assert math.isclose(M.pr_auc(df, buckets=buckets), pr, abs_tol=1e-12)
    # the shared single pass equals the two separate ones exactly
    assert M.score_aucs(df, buckets=buckets) == (M.roc_auc(df, buckets=buckets), M.pr_auc(df, buckets=buckets))


@SETTINGS
@given(st.integers(2, 60), st.integers(5, 400), st.sampled_from([0.1, 0.2, 0.25, 0.33]),
       st.integers(0, 10_000))
def test_split_quotas_exact(spark, n_pos, n_neg, test_size, seed):
    rows = [(i * 7 + 3, 1 if i < n_pos else 0) for i in range(n_pos + n_neg)]
    df = spark.createDataFrame(rows, "row_id bigint, isFraud int")
    sp = StratifiedSplitter(test_size=test_size, random_state=seed)
    if min(n_pos, n_neg) * test_size < 1:
        return  # rejected by the preconditions (tested elsewhere)
    got = {(r["split"], r["isFraud"]): r["n"]
           for r in sp.assign(df).groupBy("split", "isFraud").count().withColumnRenamed("count", "n").collect()}
    n = n_pos + n_neg
    n_test = math.ceil(test_size * n)
    kept = largest_remainder({0: n_neg, 1: n_pos}, n - n_test)
    assert got.get(("test", 1), 0) == n_pos - kept[1]
    assert got.get(("test", 0), 0) == n_neg - kept[0]
    assert got.get(("test", 0), 0) + got.get(("test", 1), 0) == n_test
