"""Session helpers: a local session for tests and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "txrisk") -> SparkSession:
    """Local session with the settings the engine assumes (UTC, ANSI, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset under a local master (tests) do we create a scratch
    folder; on a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="txrisk-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_txrisk_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="txrisk-zip-")  # read by the driver only, which serves it to executors
    path = os.path.join(folder, "txrisk.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("txrisk", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._txrisk_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def persist_adaptive(df, level=None):
    """Persist ``df`` letting AQE size the cached output by the measured data.

    By default AQE may not change a cached plan's output partitioning, so a
    small frame keeps every shuffle partition (200+) and each pass over the
    cache (e.g. every boosting round) pays for all those tasks. Allowing it
    while the cache is defined makes AQE coalesce to its advisory partition
    size (64 MB): few partitions for small data, many for large data.
    """
    from pyspark import StorageLevel

    conf = df.sparkSession.conf
    key = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    old = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return df.persist(level or StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(key, old)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Suggested settings for a large run (pass to ``SparkSession.builder.config``).

    Shuffle partitions follow the data (about ``target_partition_bytes`` of
    shuffle input each, at least 3 per core) so a task's share fits in
    executor memory; AQE then coalesces small ones and splits skewed join
    partitions at runtime.
    """
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


_HEAVY_NODES = ("Join", "Window", "Aggregate", "Union", "Generate", "Expand", "Sort", "Sample",
                "MapInPandas", "LocalRelation", "LogicalRDD")


def is_plain_scan(df) -> bool:
    """True when ``df`` only projects/filters files (re-reading it is cheap)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(n in plan for n in _HEAVY_NODES)
