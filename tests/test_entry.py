"""The driver contract: entry() runs on sf0.001; every oracle has a query; names are stable."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["type", "n_rows", "n_high_risk", "n_fraud", "total_risk_score", "avg_risk_score"]
    assert sum(r["n_rows"] for r in rows) == 1500


def test_registry_consistency():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 48 and len(sql) >= 42
    rows_only = {n for n in set(q) - set(sql) if not n.startswith(("op", "pipeline", "language_id"))}
    assert rows_only == {"gbt_scores", "rf_scores", "feature_importance", "top_features",
                         "attributions", "attribution_summary"}
