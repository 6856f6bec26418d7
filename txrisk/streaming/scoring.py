"""Score a transaction stream with a fitted feature chain and model.

Account history goes on from batch to batch: each micro-batch is engineered with the count, sum and last step that every
account had before it, so any cut of the input into batches (in the order of ``(step, row_id)``) gives the scores of one
batch inference call (M6) over all rows.

The state is a table of increments: a batch writes the history of its own rows under its batch id, and every
``SNAPSHOT_EVERY`` batches one merged table. A batch reads the last snapshot before it and the increments since, joined
with its own accounts only. Both outputs of a batch replace themselves when it is retried, and a retried batch never reads
its own increment, so results are the same after a failure; the stream's checkpoint location records progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.behavior import HISTORY, BehaviorFeatures, account_history, merge_histories
from ..operators.models import load_model, score
from ..plans.chain import FeatureChain
from ..sources.io import remove_table

BATCH_COL = "batch_id"
#: Batches between merged histories.
SNAPSHOT_EVERY = 16


def row_local_features(stream: DataFrame, params: dict) -> DataFrame:
    """Amount, balance and time features directly on a streaming frame (no state)."""
    chain = FeatureChain.from_params(params)
    out = stream
    for stage in chain.stages:
        if getattr(stage, "row_local", False) and stage is not chain.risk:
            out = stage.transform(out)
    return out


class AccountState:
    """Histories of all accounts by batch, under one folder."""

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), snapshot_every

    def _batches(self, kind: str) -> list[int]:
        """Ids of the batches that have written a table of this kind."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def before(self, batch_id: int) -> DataFrame | None:
        """The history of all batches before ``batch_id``; None without any."""
        snapshots = [b for b in self._batches("snapshot") if b < batch_id]
        since = snapshots[-1] if snapshots else -1
        paths = [f"{self.path}/increment/{b}" for b in self._batches("increment") if since < b < batch_id]
        paths += [f"{self.path}/snapshot/{since}"] if snapshots else []
        return merge_histories(self.spark.read.schema(HISTORY).parquet(*paths)) if paths else None

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Record the batch's own rows, and now and then all so far."""
        account_history(rows).write.mode("overwrite").parquet(f"{self.path}/increment/{batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.before(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot/{batch_id}")
            # a retry starts after the snapshot before this one: what is older is no longer read
            older = [b for b in self._batches("snapshot") if b < batch_id]
            for b in self._batches("increment") if older else []:
                if b <= older[-1]:
                    remove_table(self.spark, f"{self.path}/increment/{b}")
            for b in older[:-1]:
                remove_table(self.spark, f"{self.path}/snapshot/{b}")


def score_stream(stream: DataFrame, params: dict, model_path: str, sink_path: str,
                 checkpoint_path: str, trigger_once: bool = False, state_path: str | None = None) -> StreamingQuery:
    """Start a query that scores every micro-batch and appends it under ``sink_path``.

    The account state lies under ``state_path`` (by default beside the checkpoint).
    """
    model = load_model(model_path)
    state = AccountState(stream.sparkSession, state_path or f"{checkpoint_path.rstrip('/')}-accounts")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        chain = FeatureChain.from_params(params)
        for stage in chain.stages:
            if isinstance(stage, BehaviorFeatures):
                stage.history = state.before(batch_id)
        scored = score(model, chain.transform(batch)).withColumn(BATCH_COL, F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BATCH_COL).parquet(sink_path))
        state.add(batch_id, batch)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
