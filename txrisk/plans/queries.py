"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator family, each with its DuckDB oracle (or ``None`` where only a
rows check is possible). Every query reads the driver tables through the
``tx`` adapter and runs over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.adapter import transactions
from .chain import FeatureChain
from .oracle_sql import with_features

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def engineered(spark: SparkSession, sf_dir: str, **chain_kwargs) -> DataFrame:
    """tx + all 58 features, thresholds fitted on tx (q = 0.95)."""
    tx = transactions(spark, sf_dir)
    return FeatureChain(**chain_kwargs).fit(tx).transform(tx)


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------- features ---
@query("flagship_risk_by_type", with_features("""
SELECT type, count(*) AS n_rows, sum(high_risk_transaction)::BIGINT AS n_high_risk,
  sum(isFraud)::BIGINT AS n_fraud, sum(risk_score)::BIGINT AS total_risk_score,
  round(CAST(sum(risk_score) AS DOUBLE) / count(*), 6) AS avg_risk_score
FROM scored GROUP BY type
"""))
def flagship_risk_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk profile per transaction type over the fully engineered table."""
    df = engineered(spark, sf_dir)
    return df.groupBy(S.TYPE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("high_risk_transaction").cast("bigint").alias("n_high_risk"),
        F.sum(S.LABEL).cast("bigint").alias("n_fraud"),
        F.sum("risk_score").cast("bigint").alias("total_risk_score"),
        F.round(F.sum("risk_score").cast("double") / F.count(F.lit(1)), 6).alias("avg_risk_score"),
    )


_AMOUNT_COLS = [c for c in S.AMOUNT_FEATURES if c != "amount_log"]


@query("amount_features", with_features(
    "SELECT row_id, round(amount_log, 6) AS amount_log, "
    + ", ".join(_AMOUNT_COLS) + " FROM scored"))
def amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F9 per row (log rounded to 6 dp: engines' ln differ in the last bit)."""
    df = engineered(spark, sf_dir)
    return df.select(S.ROW_ID, _r6("amount_log"), *_AMOUNT_COLS)


@query("balance_features", with_features(
    "SELECT row_id, " + ", ".join(S.BALANCE_FEATURES) + " FROM scored"))
def balance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B15 per row, float32 arithmetic."""
    return engineered(spark, sf_dir).select(S.ROW_ID, *S.BALANCE_FEATURES)


_SENDER = [c for c in S.BEHAVIOR_FEATURES if "sender" in c]
_RECEIVER = [c for c in S.BEHAVIOR_FEATURES if "receiver" in c]


@query("behavior_sender", with_features("SELECT row_id, " + ", ".join(_SENDER) + " FROM scored"))
def behavior_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender running history (auto plan: one window per side
    unless an account may be hot, then the blocked plan; see behavior_blocked)."""
    return engineered(spark, sf_dir).select(S.ROW_ID, *_SENDER)


@query("behavior_receiver", with_features("SELECT row_id, " + ", ".join(_RECEIVER) + " FROM scored"))
def behavior_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver running history (auto plan, as behavior_sender)."""
    return engineered(spark, sf_dir).select(S.ROW_ID, *_RECEIVER)


@query("time_features", with_features("SELECT row_id, " + ", ".join(S.TIME_FEATURES) + " FROM scored"))
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D13 per row."""
    return engineered(spark, sf_dir).select(S.ROW_ID, *S.TIME_FEATURES)


@query("risk_features", with_features("SELECT row_id, " + ", ".join(S.RISK_FEATURES) + " FROM scored"))
def risk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R9 per row."""
    return engineered(spark, sf_dir).select(S.ROW_ID, *S.RISK_FEATURES)


@query("high_risk_top_accounts", with_features("""
SELECT nameOrig, count(*) AS n_txn, sum(risk_score)::BIGINT AS total_risk_score,
  sum(high_risk_transaction)::BIGINT AS n_high_risk
FROM scored GROUP BY nameOrig
ORDER BY total_risk_score DESC, n_txn DESC, nameOrig LIMIT 20
"""))
def high_risk_top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 senders by summed risk score (top-k report, full tiebreak)."""
    df = engineered(spark, sf_dir)
    per = df.groupBy(S.NAME_ORIG).agg(
        F.count(F.lit(1)).alias("n_txn"),
        F.sum("risk_score").cast("bigint").alias("total_risk_score"),
        F.sum("high_risk_transaction").cast("bigint").alias("n_high_risk"),
    )
    return per.orderBy(F.desc("total_risk_score"), F.desc("n_txn"), S.NAME_ORIG).limit(20)


# ------------------------------------------------- cleaning and checks ---
# Stand-in inputs derived from tx: every row once more under a new row id
# (exact duplicates), with nulls / rule violations planted by category.
DUP_OFFSET = 1_000_000_000_000

DIRTY_SQL = f"""
SELECT * FROM tx
UNION ALL
SELECT row_id + {DUP_OFFSET} AS row_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
  CASE WHEN type = 'CASH_IN' THEN CAST(NULL AS DOUBLE) ELSE oldbalanceDest END AS oldbalanceDest,
  newbalanceDest, isFraud, isFlaggedFraud
FROM tx
"""

VIOLATIONS_SQL = f"""
SELECT * FROM tx
UNION ALL
SELECT row_id + {DUP_OFFSET} AS row_id,
  CASE WHEN type = 'DEBIT' THEN -step ELSE step END AS step,
  CASE WHEN type = 'PAYMENT' THEN 'REFUND' ELSE type END AS type,
  CASE WHEN type = 'CASH_OUT' THEN -amount ELSE amount END AS amount,
  nameOrig,
  CASE WHEN type = 'TRANSFER' THEN -oldbalanceOrg ELSE oldbalanceOrg END AS oldbalanceOrg,
  newbalanceOrig, nameDest,
  CASE WHEN type = 'CASH_IN' THEN CAST(NULL AS DOUBLE) ELSE oldbalanceDest END AS oldbalanceDest,
  newbalanceDest,
  CASE WHEN isFlaggedFraud = 1 THEN 2 ELSE isFraud END AS isFraud,
  isFlaggedFraud
FROM tx
"""

PII_SALT = "txrisk-salt"
_TX_COLS = [S.ROW_ID, *S.REQUIRED_COLUMNS]


def _dirty(spark: SparkSession, sf_dir: str, sql: str = DIRTY_SQL) -> DataFrame:
    transactions(spark, sf_dir)
    return spark.sql(sql)


def _oracle_tx(body: str) -> str:
    from ..sources.adapter import oracle_with_tx

    return oracle_with_tx(body)


def _dirty_cte(sql: str = DIRTY_SQL) -> str:
    return f", dirty AS ({sql})"


_PSEUDO = lambda c, salt: f"substr(sha256('{salt}' || CAST({c} AS VARCHAR)), 1, 16) AS {c}"
_SRC_NO_ID = [c for c in S.REQUIRED_COLUMNS]


@query("preprocess_clean", _oracle_tx(_dirty_cte() + f"""
, kept AS (
  SELECT min(row_id) AS row_id, {", ".join(_SRC_NO_ID)}
  FROM dirty WHERE {" AND ".join(c + " IS NOT NULL" for c in _TX_COLS)}
  GROUP BY {", ".join(_SRC_NO_ID)})
SELECT row_id, step,
  CAST(CASE type WHEN 'PAYMENT' THEN 0 WHEN 'TRANSFER' THEN 1 WHEN 'CASH_OUT' THEN 2
       WHEN 'DEBIT' THEN 3 WHEN 'CASH_IN' THEN 4 END AS TINYINT) AS type,
  amount, {_PSEUDO("nameOrig", PII_SALT)}, oldbalanceOrg, newbalanceOrig, {_PSEUDO("nameDest", PII_SALT)},
  oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud
FROM kept
"""))
def preprocess_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P4-P8 on tx plus planted duplicates and nulls: drop nulls, check, dedup, encode, pseudonymize."""
    from ..operators.preprocess import Preprocessor

    return Preprocessor(salt=PII_SALT).process(_dirty(spark, sf_dir))


@query("pseudonymize", _oracle_tx(
    f"SELECT row_id, {_PSEUDO('nameOrig', '')}, {_PSEUDO('nameDest', '')} FROM tx"))
def pseudonymize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 with the unsalted default: 16-hex SHA-256 pseudonyms of both id columns."""
    from ..operators.preprocess import pseudonymize

    tx = transactions(spark, sf_dir)
    return pseudonymize(tx, "").select(S.ROW_ID, S.NAME_ORIG, S.NAME_DEST)


def _check_oracle() -> str:
    parts = []
    for c in S.NON_NEGATIVE_COLUMNS:
        parts.append(f"SELECT 'negative_{c}' AS rule, '{c}' AS \"column\", count(*) FILTER (WHERE {c} < 0) AS violations FROM v")
    types = ", ".join(f"'{t}'" for t in S.TRANSACTION_TYPES)
    parts.append(f"SELECT 'unknown_type', 'type', count(*) FILTER (WHERE type IS NOT NULL AND type NOT IN ({types})) FROM v")
    parts.append("SELECT 'bad_label', 'isFraud', count(*) FILTER (WHERE isFraud IS NOT NULL AND isFraud NOT IN (0, 1)) FROM v")
    parts.append("SELECT 'negative_step', 'step', count(*) FILTER (WHERE step < 0) FROM v")
    for c in _TX_COLS:
        parts.append(f"SELECT 'null', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM v")
    for c in S.MONEY_COLUMNS:
        parts.append(f"SELECT 'non_finite', '{c}', count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR isinf({c})) FROM v")
    return _oracle_tx(_dirty_cte(VIOLATIONS_SQL).replace("dirty AS", "v AS") + "\n" + "\nUNION ALL\n".join(parts))


@query("check_report", _check_oracle())
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V0 fused check (P2, P5, V5, V6, V8, V12, nulls) on tx plus planted violations: one aggregate job."""
    from ..operators import validate as V

    df = _dirty(spark, sf_dir, VIOLATIONS_SQL)
    return V.violation_table(df, V.check_rules(df))


@query("dataset_summary", _oracle_tx("""
SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns, sum(isFraud)::BIGINT AS fraud_cases,
  round(CAST(sum(isFraud) AS DOUBLE) * 100.0 / count(*), 6) AS fraud_rate_pct FROM tx
"""))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: rows, columns, fraud count and rate (%)."""
    from ..operators.profile import dataset_summary as summ

    return summ(transactions(spark, sf_dir)).withColumn("fraud_rate_pct", F.round("fraud_rate_pct", 6))


def _missing_oracle(filtered: bool) -> str:
    parts = [f"SELECT '{c}' AS \"column\", {i} AS position, count(*) FILTER (WHERE {c} IS NULL"
             + (f" OR isnan({c})" if c in S.MONEY_COLUMNS else "") + ") AS null_count, count(*) AS n_rows FROM dirty"
             for i, c in enumerate(_TX_COLS)]
    body = "\nUNION ALL\n".join(parts)
    if not filtered:
        return _oracle_tx(_dirty_cte() + ", m AS (" + body + ") SELECT \"column\", CAST(position AS INTEGER) AS position, "
                          "null_count, n_rows FROM m")
    return _oracle_tx(_dirty_cte() + ", m AS (" + body + ") SELECT \"column\", null_count AS missing_count, "
                      "round(null_count * 100.0 / n_rows, 2) AS missing_percent FROM m WHERE null_count > 0")


@query("profile_nulls", _missing_oracle(False))
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: null count of every column of tx plus planted nulls (one job)."""
    from ..operators.profile import null_counts

    return null_counts(_dirty(spark, sf_dir))


@query("profile_missing", _missing_oracle(True))
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing-value table (count, percent 2 dp, only > 0, worst first)."""
    from ..operators.profile import missing_value_summary

    return missing_value_summary(_dirty(spark, sf_dir))


@query("profile_duplicates", _oracle_tx(_dirty_cte() + f"""
SELECT 'all_columns' AS subset, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS c FROM dirty GROUP BY {", ".join(_SRC_NO_ID)}) a
UNION ALL
SELECT 'nameOrig,step', CAST(sum(c - 1) AS BIGINT)
FROM (SELECT count(*) AS c FROM dirty GROUP BY nameOrig, step) b
"""))
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate-row counts over all source columns and over (nameOrig, step)."""
    from ..operators.profile import duplicate_counts

    return duplicate_counts(_dirty(spark, sf_dir), {"all_columns": None, "nameOrig,step": [S.NAME_ORIG, S.STEP]})


@query("class_counts", _oracle_tx("SELECT isFraud, count(*) AS n FROM tx GROUP BY isFraud"))
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class."""
    from ..operators.profile import class_counts as cc

    return cc(transactions(spark, sf_dir))


@query("safe_divide_clip", _oracle_tx("""
SELECT row_id,
  amount / CASE WHEN abs(newbalanceOrig) < 1e-6 THEN 1e-6 ELSE newbalanceOrig END AS safe_ratio,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), newbalanceOrig / (oldbalanceOrg + 1))) AS clipped_share
FROM tx
"""))
def safe_divide_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 guarded division and K4 probability clipping, per row."""
    from ..functions.columns import clip_probability, safe_divide

    tx = transactions(spark, sf_dir)
    return tx.select(
        S.ROW_ID,
        safe_divide(S.AMOUNT, S.NEW_ORIG).alias("safe_ratio"),
        clip_probability(F.col(S.NEW_ORIG) / (F.col(S.OLD_ORIG) + 1)).alias("clipped_share"),
    )


@query("amount_thresholds", _oracle_tx("\nUNION ALL\n".join(
    f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(amount, {q}), 6) AS threshold FROM tx"
    for q in (0.5, 0.9, 0.95, 0.99))))
def amount_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: exact (pandas-equal) amount quantiles by distributed refinement, rounded to 6 dp."""
    from ..operators.quantile import exact_quantiles

    tx = transactions(spark, sf_dir)
    qs = [0.5, 0.9, 0.95, 0.99]
    vals = exact_quantiles(tx, S.AMOUNT, qs)
    return spark.createDataFrame([(q, round(v, 6)) for q, v in zip(qs, vals)], "q double, threshold double")



# ---------------------------------------------------------------- split ---
_SPLIT_SQL = """
, c AS (SELECT isFraud, count(*) AS cnt FROM tx GROUP BY isFraud)
, tot AS (SELECT sum(cnt) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(cnt)) AS BIGINT) AS n_test FROM c)
, q AS (SELECT isFraud, cnt, (cnt * (n - n_test)) // n AS fl, (cnt * (n - n_test)) % n AS rem, n, n_test FROM c, tot)
, q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, isFraud) AS rk,
                (n - n_test) - sum(fl) OVER () AS need FROM q)
, quota AS (SELECT isFraud, cnt - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS n_test_c FROM q2)
, ranked AS (SELECT row_id, isFraud,
    row_number() OVER (PARTITION BY isFraud ORDER BY md5(CAST(row_id AS VARCHAR) || '|42')) AS r FROM tx)
, assigned AS (SELECT row_id, ranked.isFraud,
    CASE WHEN r <= n_test_c THEN 'test' ELSE 'train' END AS split
  FROM ranked JOIN quota ON ranked.isFraud = quota.isFraud)
"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.split import StratifiedSplitter

    return StratifiedSplitter(test_size=0.2, random_state=42).assign(transactions(spark, sf_dir))


@query("stratified_split_counts", _oracle_tx(_SPLIT_SQL + """
SELECT split, isFraud, count(*) AS n FROM assigned GROUP BY split, isFraud
"""))
def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + A8/A9: exact per-class test quotas (largest remainder of ceil(0.2 n)), rows per split and class."""
    a = _assigned(spark, sf_dir)
    return a.groupBy("split", S.LABEL).agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split_rows", _oracle_tx(_SPLIT_SQL + "SELECT row_id, split FROM assigned"))
def stratified_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: split membership of every row (md5(row_id|seed) order inside each class)."""
    return _assigned(spark, sf_dir).select(S.ROW_ID, "split")


@query("unstratified_split_counts", _oracle_tx("""
, tot AS (SELECT CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM tx)
, ranked AS (SELECT row_id, isFraud, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || '|7')) AS r FROM tx)
SELECT CASE WHEN r <= (SELECT n_test FROM tot) THEN 'test' ELSE 'train' END AS split, isFraud, count(*) AS n
FROM ranked GROUP BY ALL
"""))
def unstratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: seeded split without strata (exact ceil(0.2 n) test rows)."""
    from ..operators.split import StratifiedSplitter

    a = StratifiedSplitter(test_size=0.2, random_state=7, stratify=False).assign(transactions(spark, sf_dir))
    return a.groupBy("split", S.LABEL).agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- metrics ---
# Rule-based stand-in score in [0, 1): the risk score, refined by the amount's
# cents so there are many distinct scores and ties. Exact in both engines.
_SCORE_SQL = ("CAST(CAST(risk_score AS BIGINT) * 100000 + CAST(round(amount * 100) AS BIGINT) % 100000 AS DOUBLE)"
              " / CAST(800000 AS DOUBLE)")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import PRED, SCORE, predict_at

    df = engineered(spark, sf_dir)
    score = ((F.col("risk_score").cast("bigint") * 100000
              + F.round(F.col(S.AMOUNT) * 100).cast("bigint") % 100000).cast("double") / F.lit(800000.0))
    return df.select(S.ROW_ID, S.LABEL, score.alias(SCORE)).withColumn(PRED, predict_at(SCORE, 0.5))


_SCORED_SQL = f"""
, sc AS (SELECT row_id, isFraud, {_SCORE_SQL} AS score FROM scored)
, pr AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM sc)
, cm AS (SELECT count(*) FILTER (WHERE isFraud = 1 AND prediction = 1) AS tp,
                count(*) FILTER (WHERE isFraud = 0 AND prediction = 1) AS fp,
                count(*) FILTER (WHERE isFraud = 1 AND prediction = 0) AS fn,
                count(*) FILTER (WHERE isFraud = 0 AND prediction = 0) AS tn FROM pr)
"""


def _r9_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("confusion", with_features(_SCORED_SQL + """
SELECT 0 AS true_label, 0 AS predicted_label, tn AS value FROM cm UNION ALL
SELECT 0, 1, fp FROM cm UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm
"""))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 + P9: 2x2 confusion counts at threshold 0.5 of the rule-based score."""
    from ..operators.metrics import confusion_matrix

    return confusion_matrix(_scored(spark, sf_dir))


@query("confusion_normalized", with_features(_SCORED_SQL + """
, d AS (SELECT *, CAST(tn + fp AS DOUBLE) AS t0, CAST(fn + tp AS DOUBLE) AS t1 FROM cm)
SELECT 0 AS true_label, 0 AS predicted_label, round(CASE WHEN t0 = 0 THEN 0 ELSE tn / t0 END, 9) AS value FROM d
UNION ALL SELECT 0, 1, round(CASE WHEN t0 = 0 THEN 0 ELSE fp / t0 END, 9) FROM d
UNION ALL SELECT 1, 0, round(CASE WHEN t1 = 0 THEN 0 ELSE fn / t1 END, 9) FROM d
UNION ALL SELECT 1, 1, round(CASE WHEN t1 = 0 THEN 0 ELSE tp / t1 END, 9) FROM d
"""))
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 normalized over the true class (rows sum to 1; 0/0 -> 0)."""
    from ..operators.metrics import confusion_matrix

    return _r9_all(confusion_matrix(_scored(spark, sf_dir), normalize="true"))


@query("binary_metrics", with_features(_SCORED_SQL + """
, d AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
               CAST(tn AS DOUBLE) AS tn FROM cm)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
  round((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END)
        / ((CASE WHEN tp + fn = 0 THEN 0 ELSE 1 END) + (CASE WHEN tn + fp = 0 THEN 0 ELSE 1 END)), 9) AS balanced_accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1_score,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
        ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc
FROM d
"""))
def binary_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E4 from one aggregate of the confusion counts (0/0 -> 0), rounded to 9 dp."""
    from ..operators.metrics import binary_metrics

    return _r9_all(binary_metrics(_scored(spark, sf_dir)))


def _report_sql() -> str:
    cls = lambda name, a, b, d: (
        f"SELECT '{name}' AS label, CASE WHEN {a} + {b} = 0 THEN 0 ELSE {a} / ({a} + {b}) END AS precision, "
        f"CASE WHEN {a} + {d} = 0 THEN 0 ELSE {a} / ({a} + {d}) END AS recall, "
        f"CASE WHEN 2 * {a} + {b} + {d} = 0 THEN 0 ELSE 2 * {a} / (2 * {a} + {b} + {d}) END AS f1_score, "
        f"CAST({a} + {d} AS BIGINT) AS support FROM d WHERE {a} + {b} + {d} > 0")
    return _SCORED_SQL + f"""
, d AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
               CAST(tn AS DOUBLE) AS tn FROM cm)
, per AS ({cls('0', 'tn', 'fn', 'fp')} UNION ALL {cls('1', 'tp', 'fp', 'fn')})
, rep AS (
  SELECT * FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + fp + fn + tn), CAST(tp + fp + fn + tn AS BIGINT) FROM d
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support
FROM rep
"""


@query("classification_report", with_features(_report_sql()))
def classification_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: per-class precision/recall/F1/support plus accuracy, macro and weighted averages."""
    from ..operators.metrics import classification_report

    return _r9_all(classification_report(_scored(spark, sf_dir)))


_TABLE_SQL = _SCORED_SQL + """
, t AS (SELECT score, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM sc GROUP BY score)
, tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM t)
"""


@query("roc_auc", with_features(_TABLE_SQL + """
, r AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM t)
SELECT round(CAST(sum(CAST(pos AS HUGEINT) * (2 * (cum_neg - neg) + neg)) AS DOUBLE)
             / (CAST(2 AS DOUBLE) * (SELECT P FROM tot) * (SELECT N FROM tot)), 9) AS roc_auc FROM r
"""))
def roc_auc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ROC AUC (ties half) via range-bucketed running sums, rounded to 9 dp."""
    from ..operators.metrics import roc_auc

    v = roc_auc(_scored(spark, sf_dir))
    return spark.createDataFrame([(None if v is None else round(v, 9),)], "roc_auc double")


@query("pr_auc", with_features(_TABLE_SQL + """
, r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
                  sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM t)
, x AS (SELECT pos, CAST(cum_pos AS DOUBLE) AS tp, CAST(cum_neg AS DOUBLE) AS fp,
               CAST(cum_pos - pos AS DOUBLE) AS tp0, CAST(cum_neg - neg AS DOUBLE) AS fp0 FROM r)
SELECT round(CAST(sum(CAST(CAST(pos AS DOUBLE) * (tp / (tp + fp)
         + CASE WHEN tp0 + fp0 = 0 THEN CAST(1 AS DOUBLE) ELSE tp0 / (tp0 + fp0) END)
         / (CAST(2 AS DOUBLE) * (SELECT P FROM tot)) AS DECIMAL(38,18))) AS DOUBLE), 9) AS pr_auc FROM x
"""))
def pr_auc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoid PR AUC from (recall 0, precision 1), distributed running sums, 9 dp."""
    from ..operators.metrics import pr_auc

    v = pr_auc(_scored(spark, sf_dir))
    return spark.createDataFrame([(None if v is None else round(v, 9),)], "pr_auc double")


def _evaluation_sql() -> str:
    """The flat evaluation: the metric, confusion, report and area queries side by side."""
    report = _report_sql()[len(_SCORED_SQL):]
    report = report[:report.index("SELECT label, round(precision, 9)")].replace(", d AS", ", dd AS").replace("FROM d", "FROM dd")
    lines = " UNION ALL ".join(f"SELECT label || ' {c}' AS metric, CAST({c} AS DOUBLE) AS value FROM rep" for c in ("precision", "recall", "f1_score", "support"))
    return _TABLE_SQL + """
, e AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM cm)
, up AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM t)
, down AS (SELECT pos, CAST(sum(pos) OVER w AS DOUBLE) AS a, CAST(sum(neg) OVER w AS DOUBLE) AS b, CAST(sum(pos) OVER w - pos AS DOUBLE) AS a0,
    CAST(sum(neg) OVER w - neg AS DOUBLE) AS b0 FROM t WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""" + report + f""", flat AS (
SELECT 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn) AS value FROM e
UNION ALL SELECT 'balanced_accuracy', (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END)
  / ((CASE WHEN tp + fn = 0 THEN 0 ELSE 1 END) + (CASE WHEN tn + fp = 0 THEN 0 ELSE 1 END)) FROM e
UNION ALL SELECT 'precision', CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END FROM e
UNION ALL SELECT 'recall', CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END FROM e
UNION ALL SELECT 'f1_score', CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END FROM e
UNION ALL SELECT 'mcc', CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
  ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END FROM e
UNION ALL SELECT 'confusion_00', tn FROM e UNION ALL SELECT 'confusion_01', fp FROM e
UNION ALL SELECT 'confusion_10', fn FROM e UNION ALL SELECT 'confusion_11', tp FROM e
UNION ALL SELECT 'roc_auc', CAST(sum(CAST(pos AS HUGEINT) * (2 * (below - neg) + neg)) AS DOUBLE) / (CAST(2 AS DOUBLE) * (SELECT P FROM tot) * (SELECT N FROM tot)) FROM up
UNION ALL SELECT 'pr_auc', sum(pos * (a / (a + b) + CASE WHEN a0 + b0 = 0 THEN CAST(1 AS DOUBLE) ELSE a0 / (a0 + b0) END)) / (CAST(2 AS DOUBLE) * (SELECT P FROM tot)) FROM down
UNION ALL {lines})
SELECT metric, round(value, 9) AS value FROM flat
"""


@query("evaluation_report", with_features(_evaluation_sql()))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 of the rule-based score: every metric, the confusion cells, both areas and the report by class, from one pass over the rows."""
    from ..operators.metrics import evaluate_scores, flat_report

    rows = flat_report(evaluate_scores(_scored(spark, sf_dir), threshold=0.5))
    return spark.createDataFrame(rows, "metric string, value double").select("metric", F.round("value", 9).alias("value"))


@query("class_weights", _oracle_tx("""
SELECT isFraud, count(*) AS n,
  round((SELECT count(*) FROM tx) / (CAST(2 AS DOUBLE) * count(*)), 9) AS weight
FROM tx GROUP BY isFraud
"""))
def class_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: 'balanced' class weights n / (2 n_c) from one grouped count."""
    from ..operators.models import class_weights

    w = class_weights(transactions(spark, sf_dir), S.LABEL)
    return w.select(S.LABEL, "n", F.round("weight", 9).alias("weight"))



# --------------------------------------------------------- end to end ---
@query("pipeline_split_balance", _oracle_tx(_SPLIT_SQL + """
SELECT split, isFraud, count(*) AS n FROM assigned GROUP BY split, isFraud
"""))
def pipeline_split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 end to end (clean -> write -> fit + features -> write -> split -> write), then
    S7: the class balance read back from the written, split-partitioned table."""
    from .jobs import run_data_pipeline, scratch_dir

    out = run_data_pipeline(spark, transactions(spark, sf_dir), scratch_dir(spark, "pipeline"))
    written = spark.read.parquet(out["split"])
    return written.groupBy("split", S.LABEL).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- models ---
# Model queries train on the train side of the cleaned, engineered tx and
# score the test side. Tree scores depend on Spark's learners, so these are
# row-count checked only (no SQL oracle).
_MODEL_CACHE: dict = {}


def _once(spark: SparkSession, key: tuple, make):
    """``make()`` once per Spark application: tables and models of a stopped one are of no use."""
    if key not in _MODEL_CACHE or _MODEL_CACHE[key][0] is not spark.sparkContext:
        _MODEL_CACHE[key] = (spark.sparkContext, make())
    return _MODEL_CACHE[key][1]


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned (type-encoded, ids pseudonymized) tx + 58 features + split column, written in parts by split
    and read back, so that training, scoring and explaining do not prepare the rows again."""
    from ..operators.preprocess import Preprocessor
    from ..operators.split import StratifiedSplitter
    from ..sources.io import write_split
    from .jobs import scratch_dir

    def write() -> str:
        path = scratch_dir(spark, "model")
        Preprocessor(salt="").process(transactions(spark, sf_dir)).write.parquet(f"{path}/clean")
        clean = spark.read.parquet(f"{path}/clean")
        return write_split(StratifiedSplitter().assign(FeatureChain().fit(clean).transform(clean)), f"{path}/split")

    return spark.read.parquet(_once(spark, (sf_dir, "split"), write))


def trained(spark: SparkSession, sf_dir: str, name: str):
    """(model, frame) for a small fixed configuration."""
    from ..operators.models import ModelFactory, ModelTrainer, feature_columns

    df = model_frame(spark, sf_dir)
    kw = (dict(n_estimators=20, max_depth=4, learning_rate=0.1) if name == "gbt"
          else dict(n_estimators=20, max_depth=6))
    train = df.where(F.col("split") == "train")

    def fit():
        return ModelTrainer(ModelFactory.create(name, **kw)).train(train, feature_columns(train))

    return _once(spark, (sf_dir, name), fit), df


def _scores(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..operators.models import score

    model, df = trained(spark, sf_dir, name)
    return score(model, df.where(F.col("split") == "test")).select(S.ROW_ID, S.LABEL, "score", "prediction")


@query("gbt_scores", None)
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (20 rounds, depth 4) trained on the train side; test scores."""
    return _scores(spark, sf_dir, "gbt")


@query("rf_scores", None)
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M4, M5, M7: balanced random forest (20 trees, depth 6); test scores."""
    return _scores(spark, sf_dir, "random_forest")


@query("feature_importance", None)
def feature_importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the 66 model inputs of the boosted trees, descending."""
    from ..operators.models import feature_importance

    model, _ = trained(spark, sf_dir, "gbt")
    return feature_importance(model)


@query("top_features", None)
def top_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the 20 most important inputs (a top-k report)."""
    from ..operators.models import feature_importance, top_features

    model, _ = trained(spark, sf_dir, "gbt")
    return top_features(feature_importance(model), 20)


@query("attributions", None)
def attributions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact TreeSHAP attributions of every test row (mapInPandas over the rows)."""
    from ..operators.explain import TreeExplainer

    model, df = trained(spark, sf_dir, "gbt")
    return TreeExplainer(model).attributions(df.where(F.col("split") == "test"))


@query("attribution_summary", None)
def attribution_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean |attribution| per input over all test rows, descending."""
    from ..operators.explain import TreeExplainer, summarize

    model, df = trained(spark, sf_dir, "gbt")
    ex = TreeExplainer(model)
    return summarize(ex.attributions(df.where(F.col("split") == "test")), ex.features)



# ------------------------------------------------------- plan variants ---
@query("behavior_blocked", with_features("SELECT row_id, " + ", ".join(S.BEHAVIOR_FEATURES) + " FROM scored"))
def behavior_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W12 through the skew-safe plan on both sides (ranges of rows with carries), which the
    automatic probe picks for hot accounts; must equal the plain windows."""
    df = engineered(spark, sf_dir, behavior_mode="blocked", behavior_ranges=16)
    return df.select(S.ROW_ID, *S.BEHAVIOR_FEATURES)


_B_DOUBLE_SQL = """
, d AS (SELECT row_id, amount AS a, oldbalanceOrg AS so, newbalanceOrig AS sn, oldbalanceDest AS ro,
               newbalanceDest AS rn FROM tx)
SELECT row_id, so - sn AS sender_balance_delta, rn - ro AS receiver_balance_delta,
  CASE WHEN so = 0 THEN CAST(0 AS DOUBLE) ELSE (so - sn) / so END AS sender_balance_pct_change,
  CASE WHEN ro = 0 THEN CAST(0 AS DOUBLE) ELSE (rn - ro) / ro END AS receiver_balance_pct_change,
  CASE WHEN so = 0 THEN CAST(0 AS DOUBLE) ELSE sn / so END AS remaining_sender_ratio,
  CASE WHEN ro = 0 THEN CAST(0 AS DOUBLE) ELSE rn / ro END AS receiver_growth_ratio,
  CAST(so = 0 AS TINYINT) AS sender_zero_before, CAST(sn = 0 AS TINYINT) AS sender_zero_after,
  CAST(ro = 0 AS TINYINT) AS receiver_zero_before, CAST(rn = 0 AS TINYINT) AS receiver_zero_after,
  CAST(sn < 0 OR rn < 0 AS TINYINT) AS negative_balance_flag,
  CAST(so > 0 AND sn = 0 AS TINYINT) AS sender_balance_exhausted,
  CAST(abs(sn - (so - a)) > 0.01 AS TINYINT) AS sender_balance_mismatch,
  CAST(abs(rn - (ro + a)) > 0.01 AS TINYINT) AS receiver_balance_mismatch,
  CAST(ro = 0 AND rn = 0 AND a > 0 AS TINYINT) AS receiver_zero_balance_anomaly
FROM d
"""


@query("balance_features_double", _oracle_tx(_B_DOUBLE_SQL))
def balance_features_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B15 with precision="double" (the intended tolerance semantics, SURVEY T3)."""
    from ..operators.stages import BalanceFeatures

    tx = transactions(spark, sf_dir)
    return BalanceFeatures(precision="double").transform(tx).select(S.ROW_ID, *S.BALANCE_FEATURES)


_MODEL_INPUTS = [S.STEP, S.AMOUNT, S.OLD_ORIG, S.NEW_ORIG, S.OLD_DEST, S.NEW_DEST, S.FLAGGED,
                 *S.ALL_FEATURES]


@query("feature_finite_check", with_features("\nUNION ALL\n".join(
    f"SELECT 'non_finite' AS rule, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL "
    f"OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE))) AS violations FROM scored"
    for c in _MODEL_INPUTS)))
def feature_finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 over the engineered table: null / NaN / inf count of every numeric model input (one job)."""
    from ..operators import validate as V

    df = engineered(spark, sf_dir).select(*_MODEL_INPUTS)
    return V.violation_table(df, V.non_finite_rules(df))



def _train_fit_sql() -> str:
    from .oracle_sql import FEATURE_CTES

    all_rows = "thr AS (SELECT quantile_cont(amount, 0.95) AS t FROM tx)"
    train_rows = ("thr AS (SELECT quantile_cont(tx.amount, 0.95) AS t FROM tx "
                  "JOIN assigned a ON a.row_id = tx.row_id WHERE a.split = 'train')")
    assert all_rows in FEATURE_CTES
    body = "SELECT row_id, is_high_value, " + ", ".join(S.RISK_FEATURES) + " FROM scored"
    return _oracle_tx(_SPLIT_SQL + FEATURE_CTES.replace(all_rows, train_rows) + "\n" + body)


@query("risk_features_train_fit", _train_fit_sql())
def risk_features_train_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 option fit_scope="train": thresholds fitted on the train side of the stratified split
    only, then F3 and R1-R9 computed for every row."""
    from ..operators.split import SPLIT_COL, StratifiedSplitter

    assigned = StratifiedSplitter(test_size=0.2, random_state=42).assign(transactions(spark, sf_dir))
    chain = FeatureChain().fit(assigned.where(F.col(SPLIT_COL) == "train"))
    return chain.transform(assigned).select(S.ROW_ID, "is_high_value", *S.RISK_FEATURES)


from . import model_checks  # noqa: E402,F401  (registers its queries here)


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
