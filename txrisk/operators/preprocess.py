"""Preprocessing.

Order: schema checks (no job) -> drop rows with any null (P1, a filter the
scan can take) -> one fused check job on the remaining rows (P2 negatives,
P5 unknown types) -> exact-duplicate removal keeping the first row (P4) ->
type encoding (P6) -> pseudonymized ids (P7). Everything but the check job
is lazy.

Duplicate removal groups on all source columns and keeps ``min(row_id)``:
partial aggregation collapses repeats map-side before the shuffle, so even a
row repeated a billion times costs one row per map task.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..functions.columns import encode_type, pseudonym
from . import validate as V

log = logging.getLogger(__name__)

PREPROCESS_NUMERIC = (S.AMOUNT, S.OLD_ORIG, S.NEW_ORIG, S.OLD_DEST, S.NEW_DEST)


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows holding a null (or NaN) in any column."""
    return df.na.drop(how="any")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (over the source columns), keep the first."""
    cols = [c for c in df.columns if c != S.ROW_ID]
    if S.ROW_ID not in df.columns:
        return df.dropDuplicates(cols)
    kept = df.groupBy(*cols).agg(F.min(S.ROW_ID).alias(S.ROW_ID))
    return kept.select(*df.columns)


def encode_transaction_type(df: DataFrame) -> DataFrame:
    """PAYMENT 0, TRANSFER 1, CASH_OUT 2, DEBIT 3, CASH_IN 4 (int8)."""
    return df.withColumn(S.TYPE, encode_type(S.TYPE))


def pseudonymize(df: DataFrame, salt: str) -> DataFrame:
    """Both id columns -> first 16 hex chars of SHA-256(salt + id)."""
    return df.select(*[pseudonym(c, salt).alias(c) if c in S.ID_COLUMNS else F.col(c) for c in df.columns])


def summary(df: DataFrame) -> dict:
    """A4: rows, columns, fraud count and rate (%), one aggregate job."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(S.LABEL).alias("f")).first()
    n, f = int(r["n"]), int(r["f"] or 0)
    return {"rows": n, "columns": len(df.columns), "fraud_cases": f,
            "fraud_rate": (100.0 * f / n) if n else float("nan")}


class Preprocessor:
    """The whole cleaning chain."""

    def __init__(self, salt: str | None = None):
        self._salt = salt

    def checks(self, df: DataFrame) -> None:
        """Schema (no job) then one fused job: non-empty, P2, P5."""
        V.validate_required_columns(df)
        V.validate_numeric_columns(df, PREPROCESS_NUMERIC)

    @staticmethod
    def inline_rules() -> list:
        """The row rules :meth:`process` guards inline with ``checks="inline"``."""
        return [*V.negative_rules(), V.categorical_rule()]

    def process(self, df: DataFrame, pseudonymize_pii: bool = True, report: bool = False,
                strict: bool = False, checks: str = "eager") -> DataFrame:
        """``strict=True`` adds the full schema validation (V7: duplicate names,
        ``step`` numeric, labels in {0, 1}) -- label checks ride in the same job.

        ``checks="inline"`` runs no check job: P2/P5 become ``raise_error``
        guards inside the columns the deduplication groups on, so the job
        that consumes the result (a table write) fails on the first bad row
        and the input is scanned once instead of twice. The caller maps that
        failure with :func:`validate.raise_from_guard` and checks emptiness
        on the written table. Error messages then name the column but not the
        offending values.
        :meth:`raise_as_eager` counts all rules after such a failure instead, and
        raises exactly what the eager mode raises.
        """
        if checks not in ("eager", "inline"):
            raise ValueError("checks must be 'eager' or 'inline'")
        self.checks(df)
        if strict:
            V.validate_duplicate_columns(df)
            V.validate_numeric_columns(df)
        clean = drop_missing(df)
        integrity = [*V.negative_rules(), V.categorical_rule()]
        labels = [V.target_rule()] if strict else []
        if checks == "inline":
            out = encode_transaction_type(remove_duplicates(V.guard_columns(clean, integrity + labels)))
            return self._finish(out, pseudonymize_pii, report)
        self._enforce(clean, integrity, labels, V.count_violations(clean, integrity + labels))  # one job for all rules
        return self._finish(encode_transaction_type(remove_duplicates(clean)), pseudonymize_pii, report)

    @staticmethod
    def _enforce(clean: DataFrame, integrity: list, labels: list, counts: dict) -> None:
        if counts["rows"] == 0:
            raise E.SchemaValidationError("Input dataframe is empty (after dropping missing values).")
        try:
            V.enforce(clean, integrity, counts)
        except E.DataValidationError as exc:  # unknown types are an integrity error here
            raise E.DataIntegrityError(f"Unknown transaction type(s): {exc}") from exc
        V.enforce(clean, labels, counts)

    def raise_as_eager(self, exc: Exception, df: DataFrame, strict: bool = False) -> None:
        """After a job over ``process(df, checks="inline")`` failed with ``exc``: the eager mode's error if a guard did it, else ``exc``."""
        if V.is_guard_failure(exc):
            self.process(df, pseudonymize_pii=False, strict=strict)
        raise exc

    @staticmethod
    def raise_inline_failure(exc: Exception, strict: bool = False) -> None:
        """Map a job failure from ``checks="inline"`` to the eager mode's errors."""
        rules = [*V.negative_rules(), V.categorical_rule()] + ([V.target_rule()] if strict else [])
        try:
            V.raise_from_guard(exc, rules)
        except E.DataValidationError as err:
            if V.categorical_rule().message in str(err):
                raise E.DataIntegrityError(f"Unknown transaction type(s): {err}") from exc
            raise

    def _finish(self, out: DataFrame, pseudonymize_pii: bool, report: bool) -> DataFrame:
        if pseudonymize_pii:
            if self._salt is None:
                raise E.SchemaValidationError("pseudonymize_pii=True needs an explicit salt (may be '')")
            out = pseudonymize(out, self._salt)
        if report:
            log.info("Dataset summary: %s", summary(out))
        return out
