"""End-to-end jobs (G5, G6, G7, M6), CSV ingest (S1-S3) and stream scoring."""

import os

import pytest
from pyspark.sql import functions as F

from txrisk import errors as E
from txrisk.plans import jobs
from txrisk.sources import io
from txrisk.sources.adapter import transactions
from tests.conftest import SF


@pytest.fixture(scope="module")
def pipeline(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipe"))
    res = jobs.run_data_pipeline(spark, transactions(spark, SF), out, salt="")
    return out, res


def test_data_pipeline_outputs(spark, pipeline):
    out, res = pipeline
    tx = transactions(spark, SF)
    n = tx.count()
    assert spark.read.parquet(res["cleaned"]).count() == n
    eng = spark.read.parquet(res["engineered"])
    assert eng.count() == n and len(eng.columns) == 12 + 58
    train = io.read_split(spark, res["split"], "train")
    test = io.read_split(spark, res["split"], "test")
    assert train.count() + test.count() == n
    plan = test.select("amount")._jdf.queryExecution().executedPlan().toString()
    import re

    assert re.search(r"PartitionFilters: \[isnotnull\(split#\d+\), \(split#\d+ = test\)\]", plan)
    assert "ReadSchema: struct<amount:double>" in plan                                 # column pruning
    x, y = io.features_and_label(test)
    assert "isFraud" not in x.columns and "nameOrig" not in x.columns
    assert y.count() == test.count()
    assert res["feature_params"]["risk_large_txn_threshold"] is not None


def test_training_pipeline_and_batch_scoring(spark, pipeline, tmp_path):
    out, res = pipeline
    rep = jobs.run_training(spark, res["split"], str(tmp_path), model_type="xgboost",
                            n_estimators=5, max_depth=3)
    assert rep["training_time"] > 0
    assert os.path.isdir(tmp_path / "model")
    assert spark.read.parquet(str(tmp_path / "attribution_summary")).count() == 66
    imp = spark.read.option("header", True).csv(str(tmp_path / "feature_importance"))
    assert imp.count() == 66
    params = f"{out}/feature_params"  # written by the data pipeline
    clean = spark.read.parquet(res["cleaned"])
    scored = jobs.score_batch(spark, clean, params, str(tmp_path / "model"))
    assert scored.count() == clean.count()
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_stream_scoring(spark, pipeline, tmp_path):
    from txrisk.streaming import score_stream

    out, res = pipeline
    rep_dir = str(tmp_path / "m")
    jobs.run_training(spark, res["split"], rep_dir, model_type="random_forest", n_estimators=3,
                      max_depth=3, explain=False)
    src = str(tmp_path / "in")
    clean = spark.read.parquet(res["cleaned"])
    clean.write.parquet(src)
    stream = spark.readStream.schema(clean.schema).parquet(src)
    q = score_stream(stream, res["feature_params"], f"{rep_dir}/model", str(tmp_path / "sink"),
                     str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == clean.count()


@pytest.mark.parametrize("cuts", [[3, 40, 41, 400], [100, 500]])
def test_stream_in_any_batches_equals_one_batch(spark, pipeline, tmp_path, cuts, monkeypatch):
    """Account history goes on from batch to batch, through snapshots, and a repeated batch changes nothing."""
    from txrisk.streaming import scoring

    out, res = pipeline
    jobs.run_training(spark, res["split"], str(tmp_path), model_type="random_forest", n_estimators=3, max_depth=3, explain=False)
    # few accounts, so that every one goes on in later batches
    clean = spark.read.parquet(res["cleaned"]).withColumns({"nameOrig": F.concat(F.lit("C"), F.col("row_id") % 17), "nameDest": F.when(
        F.col("row_id") % 5 > 0, F.concat(F.lit("M"), F.col("row_id") % 23))})
    monkeypatch.setattr(scoring, "SNAPSHOT_EVERY", 2)
    state = scoring.AccountState(spark, str(tmp_path / "state"), snapshot_every=2)
    edges = [-1, *cuts, 10_000]
    want = jobs.score_batch(spark, clean, f"{out}/feature_params", str(tmp_path / "model"))
    from txrisk.operators.behavior import BehaviorFeatures
    from txrisk.operators.models import load_model, score
    from txrisk.plans.chain import FeatureChain

    model, parts = load_model(str(tmp_path / "model")), []
    for batch_id, (lo, hi) in enumerate(zip(edges, edges[1:])):
        batch = clean.where((F.col("step") > lo) & (F.col("step") <= hi))
        for _ in range(2 if batch_id == 1 else 1):  # a batch that is retried
            chain = FeatureChain.from_params(res["feature_params"], behavior_mode="blocked" if batch_id == 2 else "window", behavior_ranges=3)
            for stage in chain.stages:
                if isinstance(stage, BehaviorFeatures):
                    stage.history = state.before(batch_id)
            part = score(model, chain.transform(batch))
            state.add(batch_id, batch)
        parts.append(part.toPandas())
    import pandas as pd

    got = pd.concat(parts).sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.toPandas().sort_values("row_id").reset_index(drop=True)[list(got.columns)])


def test_csv_ingest_na_strings_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
        "1,PAYMENT,100.5,C1,1000,899.5,M1,0,0,0,0\n"
        "2,TRANSFER,NA,C2,10,0,C3,0,0,1,0\n"
        "3,CASH_OUT,n/a,C3,10,0,C4,,0,0,0\n")
    df = io.load_transactions(spark, str(p))
    rows = df.orderBy("row_id").collect()
    assert [r["amount"] for r in rows] == [100.5, None, None]
    assert rows[2]["oldbalanceDest"] is None
    assert dict(df.dtypes)["step"] == "int" and "row_id" in df.columns
    bad = tmp_path / "b.csv"
    bad.write_text(p.read_text().replace("100.5", "abc"))
    with pytest.raises(E.InvalidDataTypeError):
        io.load_transactions(spark, str(bad))
    with pytest.raises(E.DataLoadError):
        io.load_transactions(spark, str(tmp_path / "missing.csv"))
    prof = jobs.profile(spark, str(p))
    assert prof["preview"].count() == 3


def test_chain_params_roundtrip_and_registry(spark, tmp_path):
    from txrisk.plans.chain import FeatureChain

    tx = transactions(spark, SF)
    ch = FeatureChain().fit(tx)
    again = FeatureChain.from_params(ch.get_params())
    assert again.is_fitted
    a = ch.transform(tx).orderBy("row_id").limit(50).collect()
    b = again.transform(tx).orderBy("row_id").limit(50).collect()
    assert a == b
    ch.register(lambda d: d.withColumn("amount_x2", F.col("amount") * 2), name="double")
    assert ch.list_stages() == ["AmountFeatures", "BalanceFeatures", "BehaviorFeatures", "TimeFeatures",
                                "double", "RiskFeatures"]
    out = ch.transform(tx)
    assert "amount_x2" in out.columns and out.columns[-1] == "high_risk_transaction"
    with pytest.raises(E.FeatureRegistryError):
        FeatureChain().transform(tx)


def test_cli_profile(tmp_path, capsys):
    from txrisk.__main__ import main

    p = tmp_path / "t.csv"
    p.write_text("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,"
                 "newbalanceDest,isFraud,isFlaggedFraud\n1,PAYMENT,1.5,C1,10,8.5,M1,0,0,0,0\n")
    main(["profile", "--source", str(p)])
    assert "nameOrig" in capsys.readouterr().out


def test_parquet_ingest_types(spark, tmp_path):
    from pyspark.sql import functions as F

    tx = transactions(spark, SF)
    good = str(tmp_path / "good.parquet")
    tx.drop("row_id").write.parquet(good)
    df = io.load_transactions(spark, good)
    assert df.count() == tx.count() and "row_id" in df.columns
    keyed = io.load_transactions(spark, good, row_id="step")  # any existing unique column may serve
    assert keyed.columns[0] == "row_id"
    bad = str(tmp_path / "bad.parquet")
    tx.withColumn("amount", F.col("amount").cast("string")).write.parquet(bad)
    with pytest.raises(E.InvalidDataTypeError):
        io.load_transactions(spark, bad)
    with pytest.raises(E.DataLoadError):
        io.load_transactions(spark, str(tmp_path / "x.json"), fmt="json")


def test_row_local_features_on_a_stream(spark, pipeline, tmp_path):
    from txrisk import schema as S
    from txrisk.streaming import row_local_features

    out, res = pipeline
    clean = spark.read.parquet(res["cleaned"])
    src = str(tmp_path / "stream_in")
    clean.write.parquet(src)
    stream = spark.readStream.schema(clean.schema).parquet(src)
    feats = row_local_features(stream, res["feature_params"])
    assert feats.isStreaming
    q = (feats.writeStream.format("memory").queryName("txrisk_rowlocal")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("txrisk_rowlocal")
    assert got.count() == clean.count()
    for c in (*S.AMOUNT_FEATURES, *S.BALANCE_FEATURES, *S.TIME_FEATURES):
        assert c in got.columns
    batch = row_local_features(clean, res["feature_params"])
    diff = got.select(*batch.columns).exceptAll(batch)
    assert diff.count() == 0


def test_data_pipeline_rejects_bad_rows_inside_the_write(spark, tmp_path):
    tx = transactions(spark, SF)
    bad = tx.withColumn("amount", F.when(F.col("row_id") == 3, F.lit(-1.0)).otherwise(F.col("amount")))
    with pytest.raises(E.DataIntegrityError, match="amount"):
        jobs.run_data_pipeline(spark, bad, str(tmp_path / "bad"), salt="")
    assert not os.path.exists(tmp_path / "bad" / "cleaned" / "_SUCCESS")
    with pytest.raises(E.SchemaValidationError, match="empty"):
        jobs.run_data_pipeline(spark, tx.where("false"), str(tmp_path / "empty"), salt="")
    worse = bad.withColumn("oldbalanceOrg", F.lit(-1.0))
    with pytest.raises(E.DataIntegrityError, match=r"\['amount', 'oldbalanceOrg'\]"):
        jobs.run_data_pipeline(spark, worse, str(tmp_path / "bad"), salt="")


def test_outputs_by_side_and_format(spark, tmp_path):
    res = jobs.run_data_pipeline(spark, transactions(spark, SF), str(tmp_path), salt="", formats=("csv",), combined=True)
    assert {"cleaned.csv", "engineered.csv", "X_train.csv", "y_test.csv", "train.csv", "test.csv"} <= set(res)
    x, y, whole = (spark.read.option("header", True).csv(res[f"{n}.csv"]) for n in ("X_test", "y_test", "test"))
    assert x.count() == y.count() == whole.count() > 0
    assert "isFraud" not in x.columns and y.columns == ["row_id", "isFraud"] and {"isFraud", "risk_score"} <= set(whole.columns)
    with pytest.raises(E.DataPersistenceError, match="xml"):
        io.write_split_sides(spark, res["split"], str(tmp_path), ("xml",))


def test_csv_inline_type_check_fails_the_data_job(spark, tmp_path):
    header = ("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,"
              "newbalanceDest,isFraud,isFlaggedFraud\n")
    good = "1,PAYMENT,100.5,C1,1000,899.5,M1,0,0,0,0\n2,TRANSFER,NA,C2,10,0,C3,0,0,1,0\n"
    p = tmp_path / "t.csv"
    p.write_text(header + good)
    lazy = io.load_transactions(spark, str(p), check_types="inline")
    assert sorted(lazy.collect()) == sorted(io.load_transactions(spark, str(p)).collect())
    bad = tmp_path / "b.csv"
    bad.write_text(header + good.replace("899.5", "x").replace("TRANSFER,NA", "TRANSFER,y"))
    io.load_transactions(spark, str(bad), check_types="inline")          # no job: no error yet
    with pytest.raises(E.InvalidDataTypeError, match="amount.*newbalanceOrig"):  # all bad columns
        jobs.run_data_pipeline(spark, str(bad), str(tmp_path / "out"), salt="")


def test_csv_outputs_are_packed(spark, tmp_path):
    """The CSV outputs of the data job take less than half of their text, and hold the rows of the Parquet outputs."""
    import glob
    import gzip

    res = jobs.run_data_pipeline(spark, transactions(spark, SF), str(tmp_path), formats=("parquet", "csv"), sides=True)
    for name in ("cleaned", "engineered", "X_train", "X_test", "y_train", "y_test"):
        files = glob.glob(f"{res[name + '.csv']}/part-*")
        text = sum(len(gzip.open(f).read()) for f in files if f.endswith(".csv.gz"))
        assert 0 < 2 * sum(os.path.getsize(f) for f in files) < text
        table = spark.read.parquet(res[name])
        back = spark.read.schema(table.schema).option("header", True).csv(res[name + ".csv"])
        assert back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()
