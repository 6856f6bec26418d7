"""Preprocessing (P1-P8), validation rules (V1-V12) and profiling."""

import pytest

from txrisk import errors as E
from txrisk import schema as S
from txrisk.operators import preprocess as P
from txrisk.operators import profile as A
from txrisk.operators import validate as V

SCHEMA = ("row_id bigint, step int, type string, amount double, nameOrig string, oldbalanceOrg double, "
          "newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, "
          "isFraud int, isFlaggedFraud int")
BASE = [
    (0, 1, "PAYMENT", 100.0, "C1", 1000.0, 900.0, "M1", 0.0, 0.0, 0, 0),
    (1, 10, "TRANSFER", 5000.0, "C2", 6000.0, 1000.0, "C3", 1000.0, 6000.0, 1, 0),
    (2, 20, "CASH_OUT", 2500.0, "C3", 3000.0, 500.0, "C4", 500.0, 3000.0, 1, 1),
    (3, 30, "DEBIT", 300.0, "C4", 500.0, 200.0, "M2", 200.0, 500.0, 0, 0),
    (4, 40, "CASH_IN", 10000.0, "C5", 1000.0, 11000.0, "C6", 1000.0, 11000.0, 0, 0),
]


def frame(spark, rows=BASE):
    return spark.createDataFrame(rows, SCHEMA)


def test_process_drops_nulls_dedups_encodes_pseudonymizes(spark):
    dup = (9,) + BASE[1][1:]                     # exact duplicate of row 1 (later row id)
    null = (7, 5, "PAYMENT", None, "C9", 1.0, 1.0, "M9", 0.0, 0.0, 0, 0)
    out = P.Preprocessor(salt="").process(frame(spark, BASE + [dup, null]))
    rows = {r["row_id"]: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]       # null row dropped, first duplicate kept
    assert [rows[i]["type"] for i in range(5)] == [0, 1, 2, 3, 4]
    import hashlib
    assert rows[0]["nameOrig"] == hashlib.sha256(b"C1").hexdigest()[:16]
    assert dict(out.dtypes)["type"] == "tinyint"


def test_salted_pseudonyms_differ_and_join(spark):
    a = P.pseudonymize(frame(spark), "s1").collect()
    b = P.pseudonymize(frame(spark), "s2").collect()
    assert a[0]["nameOrig"] != b[0]["nameOrig"]
    # same account -> same pseudonym (C3 receives in row 1 and sends in row 2)
    m = {r["row_id"]: r for r in a}
    assert m[1]["nameDest"] == m[2]["nameOrig"]


def test_negative_values_rejected(spark):
    rows = [BASE[0][:3] + (-5.0,) + BASE[0][4:]] + BASE[1:]
    with pytest.raises(E.DataIntegrityError, match="amount"):
        P.Preprocessor(salt="").process(frame(spark, rows))


def test_unknown_type_rejected(spark):
    rows = [BASE[0][:2] + ("REFUND",) + BASE[0][3:]] + BASE[1:]
    with pytest.raises(E.DataIntegrityError, match="REFUND"):
        P.Preprocessor(salt="").process(frame(spark, rows))


def test_nulls_do_not_trip_checks(spark):
    rows = BASE + [(8, 1, None, -1.0, "C1", 1.0, 1.0, "M1", 0.0, 0.0, 0, 0)]
    assert P.Preprocessor(salt="").process(frame(spark, rows)).count() == 5


def test_missing_column_and_types(spark):
    with pytest.raises(E.MissingColumnError):
        V.validate_required_columns(frame(spark).drop("amount"))
    df = frame(spark)
    bad = df.withColumn("amount", df.amount.cast("string"))
    with pytest.raises(E.InvalidDataTypeError):
        V.validate_numeric_columns(bad)


def test_validate_schema_rules(spark):
    V.validate_schema(frame(spark))
    with pytest.raises(E.EmptyDatasetError):
        V.validate_schema(frame(spark).limit(0))
    rows = [BASE[0][:10] + (2, 0)] + BASE[1:]
    with pytest.raises(E.DataValidationError, match=r"\[2\]"):
        V.validate_schema(frame(spark, rows))


def test_feature_matrix_rules(spark):
    from pyspark.sql import functions as F

    df = frame(spark).select("amount", "step")
    V.validate_feature_matrix(df)
    with pytest.raises(E.DataValidationError):
        V.validate_feature_matrix(df.withColumn("amount", F.when(F.col("step") == 1, F.lit(float("inf")))
                                                .otherwise(F.col("amount"))))
    with pytest.raises(E.InvalidDataTypeError):
        V.validate_feature_matrix(frame(spark).select("amount", "type"))


def test_violation_table_one_job(spark):
    rows = BASE + [(9, -1, "X", -1.0, "C1", -1.0, 1.0, "M1", -2.0, 0.0, 3, 0)]
    df = frame(spark, rows)
    t = {(r["rule"], r["column"]): r["violations"] for r in V.violation_table(df, V.check_rules(df)).collect()}
    assert t[("negative_amount", "amount")] == 1
    assert t[("negative_oldbalanceDest", "oldbalanceDest")] == 1
    assert t[("unknown_type", "type")] == 1
    assert t[("bad_label", "isFraud")] == 1
    assert t[("negative_step", "step")] == 1
    assert t[("null", "amount")] == 0


def test_profiles(spark):
    from pyspark.sql import functions as F

    df = frame(spark, BASE + [(9,) + BASE[0][1:]]).withColumn(
        "oldbalanceDest", F.when(F.col("row_id") == 3, F.lit(None)).otherwise(F.col("oldbalanceDest")))
    s = A.dataset_summary(df).first()
    assert (s["n_rows"], s["fraud_cases"]) == (6, 2)
    assert s["fraud_rate_pct"] == pytest.approx(100 * 2 / 6)
    miss = A.missing_value_summary(df).collect()
    assert [(r["column"], r["missing_count"], r["missing_percent"]) for r in miss] == [("oldbalanceDest", 1, 16.67)]
    assert A.duplicate_count(df).first()["duplicates"] == 1
    assert A.duplicate_count(df, [S.NAME_ORIG]).first()["duplicates"] == 1
    nulls = {r["column"]: r["null_count"] for r in A.null_counts(df).collect()}
    assert nulls["oldbalanceDest"] == 1 and nulls["amount"] == 0
    prof = {r["column"]: r for r in A.schema_profile(spark, df).collect()}
    assert prof["type"]["is_string"] == 1 and prof["amount"]["is_numeric"] == 1
    assert [r["row_id"] for r in A.preview(df, 3).collect()] == [0, 1, 2]


def test_strict_mode_checks_labels(spark):
    rows = [BASE[0][:10] + (3, 0)] + BASE[1:]
    assert P.Preprocessor(salt="").process(frame(spark, rows)).count() == 5
    with pytest.raises(E.DataValidationError, match=r"\[3\]"):
        P.Preprocessor(salt="").process(frame(spark, rows), strict=True)
    with pytest.raises(E.SchemaValidationError):
        P.Preprocessor().process(frame(spark))  # pseudonymizing needs an explicit salt


def _inline(spark, rows, path):
    """Consume an inline-checked result the way the data job does: one write."""
    pre = P.Preprocessor(salt="")
    try:
        pre.process(frame(spark, rows), checks="inline").write.mode("overwrite").parquet(path)
    except Exception as exc:  # noqa: BLE001
        pre.raise_inline_failure(exc)
    return spark.read.parquet(path)


def test_inline_checks_equal_eager_result(spark, tmp_path):
    dup = (9,) + BASE[1][1:]
    null = (7, 5, "PAYMENT", None, "C9", 1.0, 1.0, "M9", 0.0, 0.0, 0, 0)
    rows = BASE + [dup, null, (8, 1, None, -1.0, "C1", 1.0, 1.0, "M1", 0.0, 0.0, 0, 0)]
    eager = P.Preprocessor(salt="").process(frame(spark, rows))
    inline = _inline(spark, rows, str(tmp_path / "ok"))
    assert sorted(inline.collect()) == sorted(eager.collect())


def test_inline_checks_fail_the_write(spark, tmp_path):
    neg = [BASE[0][:5] + (-1.0,) + BASE[0][6:]] + BASE[1:]
    with pytest.raises(E.DataIntegrityError, match="oldbalanceOrg"):
        _inline(spark, neg, str(tmp_path / "neg"))
    unknown = [BASE[0][:2] + ("REFUND",) + BASE[0][3:]] + BASE[1:]
    with pytest.raises(E.DataIntegrityError, match="type"):
        _inline(spark, unknown, str(tmp_path / "unknown"))


def test_inline_guard_survives_in_the_plan(spark):
    plan = P.Preprocessor(salt="").process(frame(spark), checks="inline")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "raise_error" in plan
