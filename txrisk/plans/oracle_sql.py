"""DuckDB SQL that recomputes the engine's results independently.

Used only as the correctness oracle: the driver (and ``tools/check_oracle.py``)
run each query here and in Spark and compare. Every query starts from the
same ``tx`` rows (see ``sources.adapter``).
"""

from __future__ import annotations

from ..sources.adapter import oracle_with_tx

# All 58 features of the default chain (q = 0.95 for both thresholds), as CTEs
# appended after ``tx``.
FEATURE_CTES = """
, thr AS (SELECT quantile_cont(amount, 0.95) AS t FROM tx)
, w AS (
  SELECT tx.*,
    row_number() OVER (PARTITION BY nameOrig ORDER BY step, row_id) AS s_n,
    lag(step) OVER (PARTITION BY nameOrig ORDER BY step, row_id) AS s_prev,
    sum(CAST(amount AS DECIMAL(38,6))) OVER (PARTITION BY nameOrig ORDER BY step, row_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_ps,
    row_number() OVER (PARTITION BY nameDest ORDER BY step, row_id) AS r_n,
    lag(step) OVER (PARTITION BY nameDest ORDER BY step, row_id) AS r_prev,
    sum(CAST(amount AS DECIMAL(38,6))) OVER (PARTITION BY nameDest ORDER BY step, row_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r_ps,
    CAST(amount AS FLOAT) AS a32, CAST(oldbalanceOrg AS FLOAT) AS so32,
    CAST(newbalanceOrig AS FLOAT) AS sn32, CAST(oldbalanceDest AS FLOAT) AS ro32,
    CAST(newbalanceDest AS FLOAT) AS rn32
  FROM tx)
, w2 AS (
  SELECT w.*,
    CAST(CASE WHEN s_prev IS NULL THEN -1 ELSE step - s_prev END AS FLOAT) AS sg,
    CAST(CASE WHEN r_prev IS NULL THEN -1 ELSE step - r_prev END AS FLOAT) AS rg,
    CAST(CASE WHEN s_n = 1 THEN amount ELSE CAST(s_ps AS DOUBLE) / CAST(s_n - 1 AS DOUBLE) END AS FLOAT) AS sa,
    CAST(CASE WHEN r_n = 1 THEN amount ELSE CAST(r_ps AS DOUBLE) / CAST(r_n - 1 AS DOUBLE) END AS FLOAT) AS ra,
    CASE WHEN so32 = 0 THEN NULL ELSE CAST((so32 - sn32) / so32 AS FLOAT) END AS q1,
    CASE WHEN ro32 = 0 THEN NULL ELSE CAST((rn32 - ro32) / ro32 AS FLOAT) END AS q2,
    CASE WHEN so32 = 0 THEN NULL ELSE CAST(sn32 / so32 AS FLOAT) END AS q3,
    CASE WHEN ro32 = 0 THEN NULL ELSE CAST(rn32 / ro32 AS FLOAT) END AS q4,
    step % 24 AS h, step // 24 AS d
  FROM w)
, feat AS (
  SELECT row_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
    oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud,
    ln(1 + amount) AS amount_log,
    CAST(CASE WHEN amount <= 100 THEN 0 WHEN amount <= 1000 THEN 1 WHEN amount <= 10000 THEN 2
              WHEN amount <= 50000 THEN 3 ELSE 4 END AS TINYINT) AS amount_bucket,
    CAST(amount >= (SELECT t FROM thr) AS TINYINT) AS is_high_value,
    CASE WHEN oldbalanceOrg = 0 THEN CAST(0 AS DOUBLE) ELSE amount / oldbalanceOrg END AS sender_balance_ratio,
    newbalanceDest - oldbalanceDest AS receiver_balance_change,
    oldbalanceOrg - newbalanceOrig AS sender_balance_change,
    (oldbalanceOrg - amount) - newbalanceOrig AS sender_balance_error,
    (oldbalanceDest + amount) - newbalanceDest AS receiver_balance_error,
    CAST(abs((oldbalanceOrg - amount) - newbalanceOrig) > 1
         OR abs((oldbalanceDest + amount) - newbalanceDest) > 1 AS TINYINT) AS balance_anomaly,
    CAST(so32 - sn32 AS FLOAT) AS sender_balance_delta,
    CAST(rn32 - ro32 AS FLOAT) AS receiver_balance_delta,
    CAST(CASE WHEN q1 IS NULL OR isinf(q1) THEN 0 ELSE q1 END AS FLOAT) AS sender_balance_pct_change,
    CAST(CASE WHEN q2 IS NULL OR isinf(q2) THEN 0 ELSE q2 END AS FLOAT) AS receiver_balance_pct_change,
    CAST(CASE WHEN q3 IS NULL OR isinf(q3) THEN 0 ELSE q3 END AS FLOAT) AS remaining_sender_ratio,
    CAST(CASE WHEN q4 IS NULL OR isinf(q4) THEN 0 ELSE q4 END AS FLOAT) AS receiver_growth_ratio,
    CAST(so32 = 0 AS TINYINT) AS sender_zero_before,
    CAST(sn32 = 0 AS TINYINT) AS sender_zero_after,
    CAST(ro32 = 0 AS TINYINT) AS receiver_zero_before,
    CAST(rn32 = 0 AS TINYINT) AS receiver_zero_after,
    CAST(sn32 < 0 OR rn32 < 0 AS TINYINT) AS negative_balance_flag,
    CAST(so32 > 0 AND sn32 = 0 AS TINYINT) AS sender_balance_exhausted,
    CAST(abs(sn32 - (so32 - a32)) > CAST(0.01 AS FLOAT) AS TINYINT) AS sender_balance_mismatch,
    CAST(abs(rn32 - (ro32 + a32)) > CAST(0.01 AS FLOAT) AS TINYINT) AS receiver_balance_mismatch,
    CAST(ro32 = 0 AND rn32 = 0 AND a32 > 0 AS TINYINT) AS receiver_zero_balance_anomaly,
    CAST(s_n AS INTEGER) AS sender_txn_count,
    CAST(r_n AS INTEGER) AS receiver_txn_count,
    sg AS sender_time_gap, rg AS receiver_time_gap,
    sa AS sender_avg_amount, ra AS receiver_avg_amount,
    CAST(amount - CAST(sa AS DOUBLE) AS FLOAT) AS sender_amount_deviation,
    CAST(amount - CAST(ra AS DOUBLE) AS FLOAT) AS receiver_amount_deviation,
    CAST(s_n = 1 AS TINYINT) AS is_first_sender_transaction,
    CAST(r_n = 1 AS TINYINT) AS is_first_receiver_transaction,
    CAST(sg >= 0 AND sg <= 1 AS TINYINT) AS rapid_sender_activity,
    CAST(rg >= 0 AND rg <= 1 AS TINYINT) AS rapid_receiver_activity,
    CAST(h AS TINYINT) AS hour,
    CAST(d AS SMALLINT) AS day,
    CAST(d % 7 AS TINYINT) AS day_of_week,
    CAST(d // 7 AS SMALLINT) AS week,
    CAST(d % 7 >= 5 AS TINYINT) AS is_weekend,
    CAST(h // 6 = 0 AS TINYINT) AS is_night,
    CAST(h // 6 = 1 AS TINYINT) AS is_morning,
    CAST(h // 6 = 2 AS TINYINT) AS is_afternoon,
    CAST(h // 6 = 3 AS TINYINT) AS is_evening,
    CAST(sin(CAST(2 * pi() * h / 24 AS FLOAT)) AS FLOAT) AS hour_sin,
    CAST(cos(CAST(2 * pi() * h / 24 AS FLOAT)) AS FLOAT) AS hour_cos,
    CAST(sin(CAST(2 * pi() * (d % 7) / 7 AS FLOAT)) AS FLOAT) AS day_sin,
    CAST(cos(CAST(2 * pi() * (d % 7) / 7 AS FLOAT)) AS FLOAT) AS day_cos
  FROM w2)
, risk AS (
  SELECT feat.*,
    CAST(amount >= (SELECT t FROM thr) AS TINYINT) AS risk_large_transaction,
    CAST(oldbalanceOrg > 0 AND newbalanceOrig = 0 AS TINYINT) AS risk_balance_drained,
    CAST(oldbalanceDest = 0 AS TINYINT) AS risk_new_receiver,
    rapid_sender_activity AS risk_rapid_activity,
    is_first_sender_transaction AS risk_first_transaction,
    sender_balance_mismatch AS risk_balance_anomaly,
    CAST(remaining_sender_ratio >= CAST(0.9 AS FLOAT) AS TINYINT) AS risk_high_balance_usage
  FROM feat)
, scored AS (
  SELECT risk.*,
    CAST(risk_large_transaction + risk_balance_drained + risk_new_receiver + risk_rapid_activity
         + risk_first_transaction + risk_balance_anomaly + risk_high_balance_usage AS TINYINT) AS risk_score,
    CAST(risk_large_transaction + risk_balance_drained + risk_new_receiver + risk_rapid_activity
         + risk_first_transaction + risk_balance_anomaly + risk_high_balance_usage >= 3 AS TINYINT)
      AS high_risk_transaction
  FROM risk)
"""


def with_features(body: str) -> str:
    """Oracle query over ``scored`` (all raw columns + 58 features)."""
    return oracle_with_tx(FEATURE_CTES + "\n" + body.strip())
