"""Feature stages: amount, balance, time and risk are per-row projections.

Each stage is a pure ``DataFrame -> DataFrame`` step that issues ONE
``select`` (never a loop of ``withColumn``), so Catalyst fuses all of them
into a single whole-stage-codegen projection above the behaviour windows.
The behaviour stage (windows) lives in ``behavior.py``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..functions.columns import f32, f32_ratio_or_zero, flag, lit_f32, ratio_or_zero


def _or_raise(ok: Column, message: str) -> Column:
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


class Stage:
    """A feature stage. ``row_local`` stages are pure per-row projections."""

    name = "Stage"
    row_local = True
    outputs: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    error = E.FeatureError

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise self.error(f"Missing required column(s) for {self.name}: {missing}")

    def columns(self, df: DataFrame) -> list[Column]:
        raise NotImplementedError

    def guarded(self, df: DataFrame) -> DataFrame:
        """``df`` with the rows checked; a filter, which no choice of output columns prunes away."""
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        self.check(df)
        df = self.guarded(df)
        new = self.columns(df)
        keep = [F.col(c) for c in df.columns if c not in self.outputs]
        return df.select(*keep, *new)


# ---------------------------------------------------------------- amount ---
class AmountFeatures(Stage):
    """F1-F9. Needs a fitted high-value threshold (fit -> exact quantile)."""

    name = "AmountFeatures"
    outputs = S.AMOUNT_FEATURES
    required = (S.AMOUNT, S.OLD_ORIG, S.NEW_ORIG, S.OLD_DEST, S.NEW_DEST)
    error = E.AmountFeatureError

    def __init__(self, high_value_percentile: float = S.DEFAULT_QUANTILE,
                 high_value_threshold: float | None = None):
        self.high_value_percentile = high_value_percentile
        self.high_value_threshold = high_value_threshold

    def fit(self, df: DataFrame) -> "AmountFeatures":
        from .quantile import exact_quantiles

        self.high_value_threshold = exact_quantiles(df, S.AMOUNT, [self.high_value_percentile])[0]
        return self

    def guarded(self, df: DataFrame) -> DataFrame:
        lowest = S.AMOUNT_BUCKET_EDGES[0]
        return df.where(_or_raise(F.col(S.AMOUNT) > lowest, "amount_bucket: amount must be > -1 and not null"))

    def columns(self, df: DataFrame) -> list[Column]:
        if self.high_value_threshold is None:
            raise E.AmountFeatureError("AmountFeatures does not know which amounts are high yet: fit() it.")
        amount = F.col(S.AMOUNT)
        old_o, new_o = F.col(S.OLD_ORIG), F.col(S.NEW_ORIG)
        old_d, new_d = F.col(S.OLD_DEST), F.col(S.NEW_DEST)
        e = S.AMOUNT_BUCKET_EDGES
        # right-closed bins (-1,100], (100,1000], ... ; <= -1 or null does not pass the guard
        bucket = F.when(amount <= e[1], 0).when(amount <= e[2], 1).when(amount <= e[3], 2).when(amount <= e[4], 3).otherwise(4)
        sender_error = (old_o - amount) - new_o
        receiver_error = (old_d + amount) - new_d
        return [
            F.log1p(amount).alias("amount_log"),
            bucket.cast("tinyint").alias("amount_bucket"),
            flag(amount >= F.lit(float(self.high_value_threshold))).alias("is_high_value"),
            ratio_or_zero(amount, old_o).alias("sender_balance_ratio"),
            (new_d - old_d).alias("receiver_balance_change"),
            (old_o - new_o).alias("sender_balance_change"),
            sender_error.alias("sender_balance_error"),
            receiver_error.alias("receiver_balance_error"),
            flag((F.abs(sender_error) > S.ANOMALY_TOLERANCE)
                 | (F.abs(receiver_error) > S.ANOMALY_TOLERANCE)).alias("balance_anomaly"),
        ]


# --------------------------------------------------------------- balance ---
class BalanceFeatures(Stage):
    """B1-B15, computed in float32 like the original (see SURVEY T3)."""

    name = "BalanceFeatures"
    outputs = S.BALANCE_FEATURES
    required = (S.AMOUNT, S.OLD_ORIG, S.NEW_ORIG, S.OLD_DEST, S.NEW_DEST)
    error = E.BalanceFeatureError

    def __init__(self, precision: str = "float"):
        if precision not in ("float", "double"):
            raise ValueError("precision must be 'float' or 'double'")
        self.precision = precision

    def columns(self, df: DataFrame) -> list[Column]:
        cast = f32 if self.precision == "float" else (lambda c: F.col(c).cast("double"))
        lit = lit_f32 if self.precision == "float" else F.lit
        amount = cast(S.AMOUNT)
        s_old, s_new = cast(S.OLD_ORIG), cast(S.NEW_ORIG)
        r_old, r_new = cast(S.OLD_DEST), cast(S.NEW_DEST)
        zero = lit(0.0)
        s_delta = s_old - s_new
        r_delta = r_new - r_old
        s_zero_after = s_new == zero
        r_zero_before = r_old == zero
        r_zero_after = r_new == zero
        tol = lit(S.MISMATCH_TOLERANCE)
        out_t = "float" if self.precision == "float" else "double"
        return [
            s_delta.cast(out_t).alias("sender_balance_delta"),
            r_delta.cast(out_t).alias("receiver_balance_delta"),
            f32_ratio_or_zero(s_delta, s_old, out_t).alias("sender_balance_pct_change"),
            f32_ratio_or_zero(r_delta, r_old, out_t).alias("receiver_balance_pct_change"),
            f32_ratio_or_zero(s_new, s_old, out_t).alias("remaining_sender_ratio"),
            f32_ratio_or_zero(r_new, r_old, out_t).alias("receiver_growth_ratio"),
            flag(s_old == zero).alias("sender_zero_before"),
            flag(s_zero_after).alias("sender_zero_after"),
            flag(r_zero_before).alias("receiver_zero_before"),
            flag(r_zero_after).alias("receiver_zero_after"),
            flag((s_new < zero) | (r_new < zero)).alias("negative_balance_flag"),
            flag((s_old > zero) & s_zero_after).alias("sender_balance_exhausted"),
            flag(F.abs(s_new - (s_old - amount)) > tol).alias("sender_balance_mismatch"),
            flag(F.abs(r_new - (r_old + amount)) > tol).alias("receiver_balance_mismatch"),
            flag(r_zero_before & r_zero_after & (amount > zero)).alias("receiver_zero_balance_anomaly"),
        ]


# ------------------------------------------------------------------ time ---
class TimeFeatures(Stage):
    """D1-D13 from the integer hour ``step`` (1 step = 1 hour)."""

    name = "TimeFeatures"
    outputs = S.TIME_FEATURES
    required = (S.STEP,)
    error = E.TimeFeatureError

    def guarded(self, df: DataFrame) -> DataFrame:
        """A negative step fails the job (no extra pass)."""
        ok = F.col(S.STEP).isNull() | (F.col(S.STEP) >= 0)
        return df.where(_or_raise(ok, "'step' holds negative values; hours are counted from 0"))

    def columns(self, df: DataFrame) -> list[Column]:
        step = F.col(S.STEP).cast("int")
        hour = step % S.HOURS_PER_DAY
        # step >= 0 (guarded), so integer division equals floor division
        day = F.expr(f"CAST({S.STEP} AS INT) div {S.HOURS_PER_DAY}").cast("int")
        dow = day % S.DAYS_PER_WEEK
        week = F.expr(f"(CAST({S.STEP} AS INT) div {S.HOURS_PER_DAY}) div {S.DAYS_PER_WEEK}").cast("int")
        tod = F.expr(f"(CAST({S.STEP} AS INT) % {S.HOURS_PER_DAY}) div {S.HOURS_PER_BUCKET}")
        hour_angle = (F.lit(2 * math.pi) * hour / S.HOURS_PER_DAY).cast("float")
        day_angle = (F.lit(2 * math.pi) * dow / S.DAYS_PER_WEEK).cast("float")
        return [
            hour.cast("tinyint").alias("hour"),
            day.cast("smallint").alias("day"),
            dow.cast("tinyint").alias("day_of_week"),
            week.cast("smallint").alias("week"),
            flag(dow >= 5).alias("is_weekend"),
            flag(tod == 0).alias("is_night"),
            flag(tod == 1).alias("is_morning"),
            flag(tod == 2).alias("is_afternoon"),
            flag(tod == 3).alias("is_evening"),
            F.sin(hour_angle).cast("float").alias("hour_sin"),
            F.cos(hour_angle).cast("float").alias("hour_cos"),
            F.sin(day_angle).cast("float").alias("day_sin"),
            F.cos(day_angle).cast("float").alias("day_cos"),
        ]


# ------------------------------------------------------------------ risk ---
class RiskFeatures(Stage):
    """R1-R9. Reads behaviour and balance outputs; missing ones warn and give 0."""

    name = "RiskFeatures"
    outputs = S.RISK_FEATURES
    required = (S.AMOUNT, S.OLD_ORIG, S.NEW_ORIG, S.OLD_DEST)
    error = E.RiskFeatureError

    def __init__(self, large_txn_threshold: float | None = None, allow_batch_threshold: bool = False):
        self.large_txn_threshold = large_txn_threshold
        self.allow_batch_threshold = allow_batch_threshold

    def fit_threshold(self, df: DataFrame, quantile: float = S.DEFAULT_QUANTILE) -> "RiskFeatures":
        from .quantile import exact_quantiles

        self.check(df)
        self.large_txn_threshold = exact_quantiles(df, S.AMOUNT, [quantile])[0]
        return self

    def _threshold(self, df: DataFrame) -> float:
        if self.large_txn_threshold is not None:
            return float(self.large_txn_threshold)
        if not self.allow_batch_threshold:
            raise E.RiskFeatureError(
                "RiskFeatures has no fitted large-transaction threshold; call fit_threshold() "
                "or pass allow_batch_threshold=True to use this batch's 95th percentile.")
        from .quantile import exact_quantiles

        warnings.warn("RiskFeatures: falling back to this batch's 95th percentile.", stacklevel=3)
        return exact_quantiles(df, S.AMOUNT, [S.DEFAULT_QUANTILE])[0]

    @staticmethod
    def _pull(df: DataFrame, c: str) -> Column:
        if c in df.columns:
            return F.col(c).cast("tinyint")
        warnings.warn(f"'{c}' not found; run the upstream stage first. Defaulting this risk flag to 0.",
                      stacklevel=4)
        return F.lit(0).cast("tinyint")

    def columns(self, df: DataFrame) -> list[Column]:
        thr = self._threshold(df)
        amount = F.col(S.AMOUNT)
        # R7 keeps the original's meaning: despite the name "usage", it fires when
        # at least 90 % of the sender's balance REMAINS (remaining ratio >= 0.9).
        if "remaining_sender_ratio" in df.columns:
            usage = flag(F.col("remaining_sender_ratio") >= lit_f32(S.HIGH_BALANCE_USAGE))
        else:
            warnings.warn("'remaining_sender_ratio' not found; 'risk_high_balance_usage' defaulting to 0.",
                          stacklevel=3)
            usage = F.lit(0).cast("tinyint")
        flags = {
            "risk_large_transaction": flag(amount >= F.lit(thr)),
            "risk_balance_drained": flag((F.col(S.OLD_ORIG) > 0) & (F.col(S.NEW_ORIG) == 0)),
            "risk_new_receiver": flag(F.col(S.OLD_DEST) == 0),
            "risk_rapid_activity": self._pull(df, "rapid_sender_activity"),
            "risk_first_transaction": self._pull(df, "is_first_sender_transaction"),
            "risk_balance_anomaly": self._pull(df, "sender_balance_mismatch"),
            "risk_high_balance_usage": usage,
        }
        score = sum((v.cast("int") for v in flags.values()), F.lit(0))
        return [
            *[v.alias(k) for k, v in flags.items()],
            score.cast("tinyint").alias("risk_score"),
            flag(score >= S.HIGH_RISK_SCORE).alias("high_risk_transaction"),
        ]
