"""Column-expression helpers. All JVM-side built-ins; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# Running money sums use exact decimals, so a sum does not depend on the
# order rows are added in (partitioning, blocks, partial aggregation).
MONEY_DECIMAL = "decimal(38,6)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f32(c: str | Column) -> Column:
    """Cast to single precision (the balance stage computes in float32)."""
    return col(c).cast("float")


def lit_f32(value: float) -> Column:
    """A float32 literal; comparing float32 with a double literal widens the column."""
    return F.lit(value).cast("float")


def flag(cond: Column) -> Column:
    """Boolean -> int8 flag (null stays null)."""
    return cond.cast("tinyint")


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0 (pandas replace(0, nan) ... fillna(0))."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def f32_ratio_or_zero(num: Column, den: Column, dtype: str = "float") -> Column:
    """num / den in ``dtype``; NaN (den 0) and +-inf map to 0, as nan_to_num does."""
    q = F.try_divide(num, den).cast(dtype)
    zero = F.lit(0.0).cast(dtype)
    return (
        F.when(q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf")).cast(dtype)), zero)
        .otherwise(q)
    )


def safe_divide(num: str | Column, den: str | Column, epsilon: float = S.EPSILON) -> Column:
    """Guarded division: a denominator with |d| < epsilon is replaced by +epsilon."""
    d = col(den)
    return col(num) / F.when(F.abs(d) < F.lit(epsilon), F.lit(epsilon)).otherwise(d)


def clip_probability(c: str | Column) -> Column:
    """Clip to [0, 1]; NaN and null pass through (numpy.clip keeps NaN)."""
    x = col(c)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def encode_type(c: str | Column = S.TYPE) -> Column:
    """Transaction type string -> int8 code (fixed mapping, not a fitted index)."""
    mapping = F.create_map(*[x for k, v in S.TYPE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return mapping[col(c)].cast("tinyint")


def pseudonym(c: str | Column, salt: str = "") -> Column:
    """First 16 hex chars of SHA-256(salt + str(id)); deterministic, so ids still join."""
    return F.substring(F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256), 1, 16)


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY_DECIMAL)


def prior_mean(prior_sum: Column, prior_count: Column, current: Column) -> Column:
    """Mean of strictly earlier amounts; the current amount when there are none."""
    return F.when(prior_count == 0, current).otherwise(
        prior_sum.cast("double") / prior_count.cast("double")
    )
