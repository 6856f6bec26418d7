"""Row ids follow the order of the files, however Spark packs them into tasks."""

import pytest

from txrisk import schema as S
from txrisk.sources.io import load_transactions

HEADER = ",".join(S.REQUIRED_COLUMNS)


def write_parts(folder, sizes):
    at = 0
    for part, n in enumerate(sizes):
        lines = [HEADER] + [f"{i},PAYMENT,{i}.5,C{i},10.0,9.0,M{i},0.0,0.0,0,0.0" for i in range(at, at + n)]
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
        at += n
    return at


@pytest.mark.parametrize("split_bytes", ["128m", "64k"])
def test_csv_parts_keep_their_order(spark, tmp_path, split_bytes):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    n = write_parts(folder, [3, 9000, 20])
    conf = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = load_transactions(spark, str(folder))
        assert df.count() == n
        assert df.where(f"{S.ROW_ID} <> step or amount <> step + 0.5").isEmpty()
        df.write.parquet(str(tmp_path / "one.parquet"))
        back = load_transactions(spark, str(tmp_path / "one.parquet"))
        assert back.count() == n and back.where(f"{S.ROW_ID} <> step").isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_parquet_parts_keep_their_order(spark, tmp_path):
    folder = str(tmp_path / "in.parquet")
    rows = spark.range(5000).selectExpr("cast(id as int) as step", "cast(id as double) as amount")
    rows.where("step < 10").coalesce(1).write.parquet(f"{folder}/a")
    rows.where("step between 10 and 4000").coalesce(1).write.parquet(f"{folder}/b")
    rows.where("step > 4000").coalesce(1).write.parquet(f"{folder}/c")
    paths = spark.read.option("recursiveFileLookup", True).parquet(folder)
    from txrisk.sources.io import with_file_order_id

    out = with_file_order_id(paths)
    assert out.count() == 5000 and out.where("row_id <> step").isEmpty()


def test_empty_parts(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    write_parts(folder, [0, 0])
    df = load_transactions(spark, str(folder))
    assert S.ROW_ID in df.columns and df.count() == 0


@pytest.mark.parametrize("files,split_bytes", [(1, "128m"), (1, "32k"), (3, "128m"), (3, "8k")])
@pytest.mark.parametrize("most", [100_000, 0])  # offsets shipped, or joined
def test_ids_are_dense_for_any_pieces(spark, tmp_path, files, split_bytes, most):
    from txrisk.sources.io import with_file_order_id

    folder = str(tmp_path / "in")
    rows = spark.range(6000).selectExpr("id", "concat('row of text ', id) as t")
    rows.repartitionByRange(files, "id").sortWithinPartitions("id").write.option("header", True).csv(folder)
    conf = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = with_file_order_id(spark.read.option("header", True).csv(folder), most_pieces=most)
        assert out.count() == 6000 and out.where("row_id <> cast(id as long)").isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shipped_offsets_do_not_shuffle_the_rows(spark, tmp_path):
    from txrisk.sources.io import with_file_order_id

    folder = str(tmp_path / "p")
    spark.range(100).repartition(3).write.parquet(folder)
    plan = with_file_order_id(spark.read.parquet(folder))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
