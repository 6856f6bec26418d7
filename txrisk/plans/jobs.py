"""End-to-end jobs.

Every intermediate table is written and read back: that cuts lineage (a
lost executor recomputes from the last written table, never from the raw
source) and pins the ``row_id`` assigned at ingest.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..operators.models import ModelFactory, ModelTrainer, evaluate, feature_columns, save_model, score
from ..operators.preprocess import Preprocessor
from ..operators.profile import null_counts, preview
from ..operators.split import SPLIT_COL, StratifiedSplitter
from ..session import ensure_checkpoint_dir
from ..sources.io import is_type_failure, load_transactions, read_split, write_importance_csv, write_split, write_split_sides, write_table
from .chain import FeatureChain

log = logging.getLogger(__name__)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def run_data_pipeline(spark: SparkSession, source, out_dir: str, salt: str = "",
                      test_size: float = S.TEST_SIZE, seed: int = S.RANDOM_STATE,
                      fit_scope: str = "all", quantile: float = S.DEFAULT_QUANTILE,
                      chain_kwargs: dict | None = None, formats: tuple[str, ...] = ("parquet",),
                      sides: bool = False, combined: bool = False) -> dict:
    """Load -> clean -> write -> fit + 58 features -> write -> stratified split -> write.

    With ``formats`` of ``"csv"`` the cleaned and engineered tables are also written as CSV (packed by gzip: as plain text the
    CSV outputs were three fifths of all that the job writes and shuffles). ``sides`` writes the split as
    ``X_*`` and ``y_*`` tables in those formats, ``combined`` also as whole ``train`` and ``test`` tables.

    ``fit_scope="all"`` fits the thresholds on all cleaned rows before the
    split (as the original pipeline does); ``"train"`` fits on the train
    side only.
    """
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope must be 'all' or 'train'")
    # Type and row checks ride inside the write (one scan of the source, not two or three).
    raw = load_transactions(spark, source, check_types="inline") if isinstance(source, str) else source
    pre = Preprocessor(salt=salt)
    try:
        write_table(pre.process(raw, checks="inline"), f"{out_dir}/cleaned")
    except E.DataPersistenceError as exc:  # nothing is committed; what failed is counted now, so that the error names all of it
        if isinstance(source, str) and is_type_failure(exc):
            load_transactions(spark, source)
        pre.raise_as_eager(exc, raw)
    clean = spark.read.parquet(f"{out_dir}/cleaned")
    if clean.isEmpty():
        raise E.SchemaValidationError("Input dataframe is empty (after dropping missing values).")
    splitter = StratifiedSplitter(test_size=test_size, random_state=seed)
    chain = FeatureChain(**(chain_kwargs or {}))
    if fit_scope == "train":
        assigned = splitter.assign(clean)
        chain.fit(assigned.where(F.col(SPLIT_COL) == "train"), quantile)
        eng = chain.transform(assigned)
    else:
        chain.fit(clean, quantile)
        eng = chain.transform(clean)
    write_table(eng, f"{out_dir}/engineered")
    chain.save_params(f"{out_dir}/feature_params", spark)
    eng = spark.read.parquet(f"{out_dir}/engineered")
    assigned = eng if SPLIT_COL in eng.columns else splitter.assign(eng)
    write_split(assigned, f"{out_dir}/split")
    out = {"cleaned": f"{out_dir}/cleaned", "engineered": f"{out_dir}/engineered",
           "split": f"{out_dir}/split", "feature_params": chain.get_params(),
           "test_quotas": splitter.quotas}
    if "csv" in formats:
        for name, table in (("cleaned", clean), ("engineered", eng)):
            out[f"{name}.csv"] = write_table(table, f"{out_dir}/{name}.csv", "csv", packed=True)
    if sides or combined:
        out |= write_split_sides(spark, f"{out_dir}/split", out_dir, formats, combined)
    return out


def run_training(spark: SparkSession, split_dir: str, out_dir: str, model_type: str = "xgboost",
                 explain: bool = True, explain_rows: DataFrame | None = None, **model_kwargs) -> dict:
    """Train on the train side, save, evaluate on the test side, write reports.

    A failure of the attribution step is logged and skipped, as in the original.
    """
    train = read_split(spark, split_dir, "train")
    test = read_split(spark, split_dir, "test")
    trainer = ModelTrainer(ModelFactory.create(model_type, **model_kwargs))
    model = trainer.train(train, feature_columns(train))
    save_model(model, f"{out_dir}/model")
    report = evaluate(model, test)
    if report["feature_importance"] is not None:
        write_importance_csv(report["feature_importance"], f"{out_dir}/feature_importance")
    cm = report["confusion_matrix"]
    spark.createDataFrame([(t, p, cm[t][p]) for t in (0, 1) for p in (0, 1)],
                          "true_label int, predicted_label int, value long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/confusion_matrix")
    if explain:
        try:
            from ..operators.explain import TreeExplainer, summarize

            ex = TreeExplainer(model)
            attr = ex.attributions(explain_rows if explain_rows is not None else test)
            summarize(attr, ex.features).write.mode("overwrite").parquet(f"{out_dir}/attribution_summary")
        except Exception as exc:  # noqa: BLE001  (explanation failure is a warning only)
            log.warning("Attribution step skipped: %s", exc)
    report["training_time"] = trainer.get_training_time()
    report["predictions"].unpersist()
    return report


def score_batch(spark: SparkSession, df: DataFrame, params_path: str, model_path: str) -> DataFrame:
    """M6: batch inference with reloaded thresholds (S11) and model."""
    from ..operators.models import load_model

    chain = FeatureChain.load_params(params_path, spark)
    model = load_model(model_path)
    return score(model, chain.transform(df))


def profile(spark: SparkSession, source) -> dict:
    """Load, per-column null counts and a first-rows preview."""
    df = load_transactions(spark, source) if isinstance(source, str) else source
    if not df.columns:
        raise E.EmptyDatasetError("no columns")
    return {"rows_and_nulls": null_counts(df), "preview": preview(df)}
