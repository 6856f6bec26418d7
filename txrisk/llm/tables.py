"""Reading the corpus tables, and tables kept in the cluster's shared folder between jobs."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import ensure_checkpoint_dir, ship_package


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch sent to Python: ten thousand long texts at once would not fit a worker.
BATCH_BYTES = 16 << 20


def ready(spark: SparkSession) -> None:
    """What Python stages need: the package on the executors, and Arrow batches of bounded size."""
    ship_package(spark)
    now = spark.conf.get(_BATCH).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder that all executors and the driver see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, executors may go."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Remove tables written by :func:`keep` that are no longer needed."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/llm-" in name:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def column(df: DataFrame, name: str, kind: str):
    """Column ``name`` of ``df`` cast to ``kind``; a null literal when the table lacks it."""
    ready(df.sparkSession)  # every operator asks for its columns before it runs Python
    match = [c for c in df.columns if c.lower() == name.lower()]
    return (F.col(f"`{match[0]}`") if match else F.lit(None)).cast(kind)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
