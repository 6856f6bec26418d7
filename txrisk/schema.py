"""Transaction schema, fixed codes and feature names.

Everything in the "fixed values" blocks must equal the behaviour being
reproduced (column names, type codes, thresholds); they are stated plainly
and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw transaction columns, in source order -----------------
STEP = "step"
TYPE = "type"
AMOUNT = "amount"
NAME_ORIG = "nameOrig"
OLD_ORIG = "oldbalanceOrg"
NEW_ORIG = "newbalanceOrig"
NAME_DEST = "nameDest"
OLD_DEST = "oldbalanceDest"
NEW_DEST = "newbalanceDest"
LABEL = "isFraud"
FLAGGED = "isFlaggedFraud"

REQUIRED_COLUMNS = (
    STEP, TYPE, AMOUNT, NAME_ORIG, OLD_ORIG, NEW_ORIG,
    NAME_DEST, OLD_DEST, NEW_DEST, LABEL, FLAGGED,
)
ID_COLUMNS = (NAME_ORIG, NAME_DEST)
CATEGORICAL_COLUMNS = (TYPE,)
NUMERIC_COLUMNS = (STEP, AMOUNT, OLD_ORIG, NEW_ORIG, OLD_DEST, NEW_DEST)
MONEY_COLUMNS = (AMOUNT, OLD_ORIG, NEW_ORIG, OLD_DEST, NEW_DEST)
NON_NEGATIVE_COLUMNS = (AMOUNT, OLD_ORIG, OLD_DEST)

# --- fixed values: transaction type codes (the encoding actually applied) ---
TYPE_CODES = {
    "PAYMENT": 0,
    "TRANSFER": 1,
    "CASH_OUT": 2,
    "DEBIT": 3,
    "CASH_IN": 4,
}
TRANSACTION_TYPES = ("PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT")
FRAUD_PRONE_TYPES = ("TRANSFER", "CASH_OUT")
LABEL_VALUES = (0, 1)

# --- fixed values: defaults ------------------------------------------------
RANDOM_STATE = 42
TEST_SIZE = 0.20
VALIDATION_SIZE = 0.20
DEFAULT_QUANTILE = 0.95
DEFAULT_THRESHOLD = 0.50
EPSILON = 1e-6
HIGH_BALANCE_USAGE = 0.90
HIGH_RISK_SCORE = 3
RAPID_GAP = 1
NO_PRIOR_GAP = -1
MISMATCH_TOLERANCE = 0.01
ANOMALY_TOLERANCE = 1.0
AMOUNT_BUCKET_EDGES = (-1, 100, 1000, 10000, 50000)  # right-closed bins, last is open
HOURS_PER_DAY = 24
DAYS_PER_WEEK = 7
HOURS_PER_BUCKET = 6
SUPPORTED_DATA_FILES = (".csv", ".parquet")

# Row identity column (input order tiebreak); our addition.
ROW_ID = "row_id"

RAW_SCHEMA = T.StructType([
    T.StructField(STEP, T.IntegerType()),
    T.StructField(TYPE, T.StringType()),
    T.StructField(AMOUNT, T.DoubleType()),
    T.StructField(NAME_ORIG, T.StringType()),
    T.StructField(OLD_ORIG, T.DoubleType()),
    T.StructField(NEW_ORIG, T.DoubleType()),
    T.StructField(NAME_DEST, T.StringType()),
    T.StructField(OLD_DEST, T.DoubleType()),
    T.StructField(NEW_DEST, T.DoubleType()),
    T.StructField(LABEL, T.IntegerType()),
    T.StructField(FLAGGED, T.IntegerType()),
])

# --- fixed values: engineered feature names, by stage, in output order ------
AMOUNT_FEATURES = (
    "amount_log", "amount_bucket", "is_high_value", "sender_balance_ratio",
    "receiver_balance_change", "sender_balance_change", "sender_balance_error",
    "receiver_balance_error", "balance_anomaly",
)
BALANCE_FEATURES = (
    "sender_balance_delta", "receiver_balance_delta",
    "sender_balance_pct_change", "receiver_balance_pct_change",
    "remaining_sender_ratio", "receiver_growth_ratio",
    "sender_zero_before", "sender_zero_after",
    "receiver_zero_before", "receiver_zero_after",
    "negative_balance_flag", "sender_balance_exhausted",
    "sender_balance_mismatch", "receiver_balance_mismatch",
    "receiver_zero_balance_anomaly",
)
BEHAVIOR_FEATURES = (
    "sender_txn_count", "receiver_txn_count",
    "sender_time_gap", "receiver_time_gap",
    "sender_avg_amount", "receiver_avg_amount",
    "sender_amount_deviation", "receiver_amount_deviation",
    "is_first_sender_transaction", "is_first_receiver_transaction",
    "rapid_sender_activity", "rapid_receiver_activity",
)
TIME_FEATURES = (
    "hour", "day", "day_of_week", "week", "is_weekend",
    "is_night", "is_morning", "is_afternoon", "is_evening",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
)
RISK_FLAGS = (
    "risk_large_transaction", "risk_balance_drained", "risk_new_receiver",
    "risk_rapid_activity", "risk_first_transaction", "risk_balance_anomaly",
    "risk_high_balance_usage",
)
RISK_FEATURES = RISK_FLAGS + ("risk_score", "high_risk_transaction")

ALL_FEATURES = (
    AMOUNT_FEATURES + BALANCE_FEATURES + BEHAVIOR_FEATURES + TIME_FEATURES + RISK_FEATURES
)

# Upstream columns the risk stage reads, and the stage that makes each.
RISK_DEPENDENCIES = {
    "rapid_sender_activity": "BehaviorFeatures",
    "is_first_sender_transaction": "BehaviorFeatures",
    "sender_balance_mismatch": "BalanceFeatures",
    "remaining_sender_ratio": "BalanceFeatures",
}

# Columns removed before a model sees the frame.
NON_MODEL_COLUMNS = (LABEL, NAME_ORIG, NAME_DEST)
