"""Profiling (A4-A7, A9, A10): each is one aggregate job with a small result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def dataset_summary(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """A4: one row -- rows, columns, fraud count, fraud rate in percent."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("fraud_cases"),
        F.try_divide(F.sum(label).cast("double") * 100.0, n).alias("fraud_rate_pct"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """A5: rows and null count per column (one job): (column, position, null_count, n_rows)."""
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"__m{i}") for i, c in enumerate(names)])
    structs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                        F.col(f"__m{i}").alias("null_count"), F.col("__n").alias("n_rows"))
               for i, c in enumerate(names)]
    return wide.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


def missing_value_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent (2 dp), worst first.

    Missing = null, or NaN in a floating column (pandas ``isna``).
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def missing(c: str):
        x = F.col(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            return x.isNull() | F.isnan(x)
        return x.isNull()

    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(missing(c)).cast("bigint").alias(f"__m{i}") for i, c in enumerate(names)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("missing_count"), F.col("__n").alias("n"))
               for i, c in enumerate(names)]
    long = wide.select(F.explode(F.array(*structs)).alias("e")).select("e.*")
    pct = F.when(F.col("n") > 0, F.round(F.col("missing_count") * 100.0 / F.col("n"), 2)).otherwise(F.lit(0.0))
    return (long.where(F.col("missing_count") > 0)
            .select("column", "missing_count", pct.alias("missing_percent"))
            .orderBy(F.desc("missing_count"), "column"))


def duplicate_count(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Rows beyond the first of each repeated (subset) value; one row.

    Partial aggregation collapses repeats before the shuffle.
    """
    cols = list(subset) if subset is not None else [c for c in df.columns if c != S.ROW_ID]
    per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_counts(df: DataFrame, key_sets: dict[str, list[str] | None]) -> DataFrame:
    """A7 for several key sets in one scan: (subset, duplicates); None means all columns but the row id.

    The sets are GROUPING SETS of one aggregation, told apart by their grouping id, so a null key is not taken for
    a column that its set leaves out.
    """
    sets = {name: list(cols) if cols is not None else [c for c in df.columns if c != S.ROW_ID] for name, cols in key_sets.items()}
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    ids = {}
    for name, cols in sets.items():  # the bit of a column is set where the set leaves it out
        code = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in cols)
        ids.setdefault(code, []).append(name)
    distinct = [sets[names[0]] for names in ids.values()]
    per = df.groupingSets([[F.col(c) for c in cols] for cols in distinct], *[F.col(c) for c in every]).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__c"))
    one = per.groupBy("__set").agg(F.sum(F.col("__c") - 1).cast("bigint").alias("n"))
    # a set without rows has no group: one aggregated row holds a number for each
    wide = one.agg(*[F.coalesce(F.sum(F.when(F.col("__set") == code, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n{i}") for i, code in enumerate(ids)])
    cells = [F.struct(F.lit(name).alias("subset"), F.col(f"n{i}").alias("duplicates")) for i, names in enumerate(ids.values()) for name in names]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.subset", "e.duplicates")


def class_counts(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Value counts per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def schema_profile(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A10: name, position, type and kind of every column (from the schema, no job)."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        numeric = isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.BooleanType)
        rows.append((f.name, i, f.dataType.simpleString(), int(numeric), int(isinstance(f.dataType, T.StringType))))
    return spark.createDataFrame(rows, "column string, position int, data_type string, is_numeric int, is_string int")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """P10: first rows in input order."""
    order = [S.ROW_ID] if S.ROW_ID in df.columns else []
    return (df.orderBy(*order) if order else df).limit(n)
