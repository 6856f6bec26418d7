"""Validation.

Schema rules (V2, V3, V4) read only the schema: no job. Row rules are fused
into ONE aggregate job (V0): each rule is a ``count_if`` column of a single
``df.agg``; only counts come back. When a rule fails, at most 20 sorted
offending values are fetched by a second, bounded job for the message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from .. import schema as S

#: Values spelled out in an error message; the message says how many there are in all.
SHOWN = 20


@dataclass(frozen=True)
class Rule:
    """One row-level rule: ``bad`` marks violating rows of ``column``."""

    name: str
    column: str
    bad: Column
    error: type
    message: str
    show_values: bool = False


# ------------------------------------------------------------ schema rules ---
def validate_duplicate_columns(df: DataFrame) -> None:
    """V2."""
    seen, dupes = set(), []
    for c in df.columns:
        if c in seen and c not in dupes:
            dupes.append(c)
        seen.add(c)
    if dupes:
        raise E.DataValidationError(f"Duplicate column names found: {dupes}")


def validate_required_columns(df: DataFrame, required=S.REQUIRED_COLUMNS) -> None:
    """V3."""
    missing = set(required) - set(df.columns)
    if missing:
        raise E.MissingColumnError(f"Missing required columns: {sorted(missing)}")


def validate_numeric_columns(df: DataFrame, columns=S.NUMERIC_COLUMNS) -> None:
    """V4: numeric columns have a numeric type (the preprocessing variant omits ``step``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in columns if c in types and not isinstance(types[c], T.NumericType)]
    if bad:
        raise E.InvalidDataTypeError(f"Expected numeric columns: {bad}")


# --------------------------------------------------------------- row rules ---
def not_in(column: str, allowed) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~c.isin(*allowed)


def categorical_rule() -> Rule:
    """V5 / P5: transaction types outside the known set (nulls ignored)."""
    return Rule("unknown_type", S.TYPE, not_in(S.TYPE, S.TRANSACTION_TYPES), E.DataValidationError,
                f"Invalid values in '{S.TYPE}'", show_values=True)


def target_rule(label: str = S.LABEL) -> Rule:
    """V6 / V9: labels outside {0, 1} (nulls ignored)."""
    return Rule("bad_label", label, not_in(label, S.LABEL_VALUES), E.DataValidationError,
                "Unexpected target values", show_values=True)


def negative_rules() -> list[Rule]:
    """Negative amount / old balances (new balances are not checked)."""
    return [Rule(f"negative_{c}", c, F.col(c) < 0, E.DataIntegrityError, "Negative values found in")
            for c in S.NON_NEGATIVE_COLUMNS]


def step_rule() -> Rule:
    """``step`` must be >= 0."""
    return Rule("negative_step", S.STEP, F.col(S.STEP) < 0, E.TimeFeatureError,
                "'step' contains negative values; expected non-negative simulation steps.")


def null_rules(df: DataFrame) -> list[Rule]:
    return [Rule("null", c, F.col(c).isNull(), E.DataValidationError, "Null values in") for c in df.columns]


def non_finite_rules(df: DataFrame, columns=None) -> list[Rule]:
    """V8: null, NaN or +-inf in numeric columns."""
    out = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        elif isinstance(f.dataType, T.NumericType):
            bad = c.isNull()
        else:
            continue
        out.append(Rule("non_finite", f.name, bad, E.DataValidationError,
                        "Feature matrix contains NaN or infinite values."))
    return out


def count_violations(df: DataFrame, rules: list[Rule], with_rows: bool = True,
                     extra: dict | None = None) -> dict:
    """V0: one aggregate job; returns {'rows': n, (rule, column): count}.

    ``extra`` maps names to further aggregate columns computed in the same job.
    """
    extra = extra or {}
    aggs = violation_columns(rules, with_rows) + [a.alias(f"__x{i}") for i, a in enumerate(extra.values())]
    row = df.agg(*aggs).first()
    out = read_counts(row.asDict(), rules)
    for i, name in enumerate(extra):
        out[name] = row[f"__x{i}"]
    return out


def violation_columns(rules: list[Rule], with_rows: bool = True) -> list[Column]:
    """Aggregate columns that count the rows and the failing rows of each rule (for an aggregation or an observation)."""
    return ([F.count(F.lit(1)).alias("__rows")] if with_rows else []) + [F.count_if(r.bad).alias(f"__r{i}") for i, r in enumerate(rules)]


def read_counts(row: dict, rules: list[Rule]) -> dict:
    """The values of :func:`violation_columns` by (rule, column), with 'rows'."""
    out = {"rows": row["__rows"]} if "__rows" in row else {}
    return out | {(r.name, r.column): int(row[f"__r{i}"]) for i, r in enumerate(rules)}


def violation_table(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """V0 as a DataFrame: (rule, column, violations), still one aggregate job."""
    aggs = [F.count_if(r.bad).cast("bigint").alias(f"__r{i}") for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"__r{i}").alias("violations"))
        for i, r in enumerate(rules)
    ])).alias("e")
    return wide.select(stacked).select("e.rule", "e.column", "e.violations")


def offending_table(df: DataFrame, rule: Rule) -> DataFrame:
    """All distinct offending values of a rule (``value``) with their row counts, sorted."""
    return (df.where(rule.bad).groupBy(F.col(rule.column).alias("value"))
            .agg(F.count("*").alias("n_rows")).orderBy("value"))


def offending_values(df: DataFrame, rule: Rule, shown: int = SHOWN) -> tuple[int, list]:
    """The exact number of distinct offending values, and the first ``shown`` of them for a message."""
    table = offending_table(df, rule)
    first = [r["value"] for r in table.limit(shown + 1).collect()]
    return (len(first) if len(first) <= shown else table.count()), first[:shown]


def enforce(df: DataFrame, rules: list[Rule], counts: dict) -> None:
    """Raise for the first failing rule, in the given order."""
    for r in rules:
        if not counts[(r.name, r.column)]:
            continue
        if r.show_values:
            n, first = offending_values(df, r)
            more = f" and {n - len(first)} more of {n} (offending_table() lists all)" if n > len(first) else ""
            raise r.error(f"{r.message}: {first}{more}")
        cols = [q.column for q in rules
                if q.error is r.error and q.message == r.message and counts[(q.name, q.column)]]
        raise r.error(f"{r.message}: {cols}")


GUARD_TAG = "txrisk-guard"


def guard_columns(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rules as ``raise_error`` guards inside the columns they test.

    No job runs here: the first task that meets a violating row fails the job
    that consumes the frame (a write then commits nothing). The guarded
    columns must reach that job's output or a grouping key, or the optimizer
    prunes the check with the column.
    """
    by_col: dict[str, list[Rule]] = {}
    for r in rules:
        by_col.setdefault(r.column, []).append(r)
    cols = []
    for c in df.columns:
        e = F.col(c)
        for r in by_col.get(c, []):
            e = F.when(r.bad, F.raise_error(F.lit(f"[{GUARD_TAG}:{r.name}:{c}]"))).otherwise(e)
        cols.append(e.alias(c) if c in by_col else e)
    return df.select(*cols)


def is_guard_failure(exc: Exception) -> bool:
    """Whether a job failed by a :func:`guard_columns` guard."""
    return f"[{GUARD_TAG}:" in str(exc)


def raise_from_guard(exc: Exception, rules: list[Rule]) -> None:
    """Re-raise a job failure caused by :func:`guard_columns` as the rule's error."""
    text = str(exc)
    for r in rules:
        if f"[{GUARD_TAG}:{r.name}:{r.column}]" in text:
            raise r.error(f"{r.message}: ['{r.column}']") from exc
    raise exc


# --------------------------------------------------------------- composites ---
def validate_not_empty(df: DataFrame) -> None:
    """V1."""
    if df.isEmpty():
        raise E.EmptyDatasetError("Dataset contains no rows.")


def validate_schema(df: DataFrame) -> None:
    """V7: V2, V3, V4 on the schema (no job), then V1 + V5 + V6 in one job."""
    validate_duplicate_columns(df)
    validate_required_columns(df)
    validate_numeric_columns(df)
    rules = [categorical_rule(), target_rule()]
    counts = count_violations(df, rules)
    if counts["rows"] == 0:
        raise E.EmptyDatasetError("Dataset contains no rows.")
    enforce(df, rules, counts)


def validate_feature_matrix(df: DataFrame, exclude=(S.LABEL, S.ROW_ID)) -> None:
    """V8: non-empty, all numeric, all finite (one job)."""
    cols = [c for c in df.columns if c not in exclude]
    types = {f.name: f.dataType for f in df.schema.fields}
    non_num = [c for c in cols if not isinstance(types[c], T.NumericType)]
    if non_num:
        raise E.InvalidDataTypeError(
            f"Feature matrix must be fully numeric (non-numeric: {non_num}); encode categorical columns first.")
    rules = non_finite_rules(df, cols)
    counts = count_violations(df, rules)
    if counts["rows"] == 0:
        raise E.EmptyDatasetError("Feature matrix is empty.")
    enforce(df, rules, counts)


def validate_training_frame(df: DataFrame, label: str = S.LABEL) -> dict:
    """V8 on the features and V9 on the label, in ONE aggregate job.

    Returns the row count per label value present ({0: n0, 1: n1}), counted
    in the same job (class weights and leaf sizes need no further pass).
    """
    cols = [c for c in df.columns if c != label]
    types = {f.name: f.dataType for f in df.schema.fields}
    non_num = [c for c in cols if not isinstance(types[c], T.NumericType)]
    if non_num:
        raise E.InvalidDataTypeError(f"Feature matrix must be fully numeric (non-numeric: {non_num}).")
    rules = non_finite_rules(df, cols) + [target_rule(label)]
    per_class = {v: F.count_if(F.col(label) == F.lit(v)) for v in S.LABEL_VALUES}
    counts = count_violations(df, rules, extra=per_class)
    if counts["rows"] == 0:
        raise E.EmptyDatasetError("Feature matrix is empty.")
    enforce(df, rules, counts)
    return {v: int(counts[v]) for v in S.LABEL_VALUES if counts[v]}


def validate_target_vector(df: DataFrame, label: str = S.LABEL) -> None:
    """V9."""
    rule = target_rule(label)
    counts = count_violations(df, [rule])
    if counts["rows"] == 0:
        raise E.EmptyDatasetError("Target vector is empty.")
    enforce(df, [rule], counts)


def check_rules(df: DataFrame) -> list[Rule]:
    """The standard data-check set used by the ``check_report`` query."""
    return [
        *negative_rules(), categorical_rule(), target_rule(), step_rule(),
        *null_rules(df), *non_finite_rules(df, list(S.MONEY_COLUMNS)),
    ]
