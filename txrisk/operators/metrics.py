"""Classification metrics (E1-E9, P9, V17), exact and distributed.

* E1-E5, E8 come from the four confusion counts: one aggregate job.
* E6 ROC AUC is exact (ties count half): scores are grouped to distinct
  values with positive/negative counts, a range-bucketed running sum gives
  the negatives below each score, and
  ``AUC = sum(pos * (2 * neg_below + neg)) / (2 * P * N)`` is summed as an
  exact decimal and divided once on the driver.
* E7 PR AUC is the trapezoid area under the precision-recall curve starting
  at (recall 0, precision 1), one point per distinct score -- the rule of
  ``auc(recall, precision)`` over ``precision_recall_curve``, not Spark's
  ``areaUnderPR`` (which starts at the first point's precision). Each point's
  predecessor is its own cumulative counts minus its group counts, so no
  lag over a global order is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..session import persist_adaptive
from .prefix import running_sums

PRED = "prediction"
SCORE = "score"


def predict_at(score: str | Column, threshold: float = S.DEFAULT_THRESHOLD) -> Column:
    """Label 1 where score >= threshold (threshold in (0, 1))."""
    if not 0.0 < threshold < 1.0:
        raise E.MetricsError("threshold must be in (0, 1)")
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(float(threshold))).cast("int")


def positive_probability(col: str = "probability") -> Column:
    """Score of class 1 from a Spark ML probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))[1]


# ------------------------------------------------------------ validation ---
def validate_inputs(df: DataFrame, label: str, pred: str, score: str | None = None) -> dict:
    """Non-empty, finite, at most two classes in truth and prediction (one job).

    The returned dict also holds the confusion counts ``tp, fp, fn, tn``.
    """
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.col(label)).alias("k_true"),
        F.count_distinct(F.col(pred)).alias("k_pred"),
        F.count_if(F.col(label).isNull() | F.col(pred).isNull()).alias("nulls"),
    ]
    y, p = F.col(label), F.col(pred)  # confusion counts ride in the same job
    aggs += [F.count_if((y == a) & (p == b)).alias(k)
             for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    if score is not None:
        s = F.col(score)
        aggs.append(F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))).alias("bad_score"))
    r = df.agg(*aggs).first().asDict()
    if r["n"] == 0:
        raise E.MetricsError("y_true is empty.")
    if r["nulls"]:
        raise E.MetricsError("y_true / y_pred contain null values.")
    if r["tp"] + r["fp"] + r["fn"] + r["tn"] != r["n"]:
        raise E.MetricsError("labels and predictions must be binary, 0 or 1.")
    if r["k_true"] > 2:
        raise E.MetricsError(f"y_true must be binary; found {r['k_true']} distinct classes.")
    if r["k_pred"] > 2:
        raise E.MetricsError(f"y_pred must be binary; found {r['k_pred']} distinct classes.")
    if score is not None and r["bad_score"]:
        raise E.MetricsError("y_prob contains NaN or infinite values.")
    return r


# -------------------------------------------------------- confusion based ---
def confusion_counts(df: DataFrame, label: str = S.LABEL, pred: str = PRED) -> DataFrame:
    """One row: tp, fp, fn, tn (bigint)."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
    )


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts_frame(spark, counts: dict) -> DataFrame:
    """The one-row (tp, fp, fn, tn) frame from counts already collected."""
    return spark.createDataFrame([tuple(int(counts[k]) for k in ("tp", "fp", "fn", "tn"))],
                                 "tp bigint, fp bigint, fn bigint, tn bigint")


def binary_metrics(df: DataFrame, label: str = S.LABEL, pred: str = PRED,
                   counts: DataFrame | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1, MCC (0/0 -> 0).

    ``counts`` (a :func:`confusion_counts` row) skips the pass over ``df``.
    """
    c = confusion_counts(df, label, pred) if counts is None else counts
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rec1 = F.try_divide(tp, tp + fn)
    rec0 = F.try_divide(tn, tn + fp)
    present = F.when(rec1.isNull(), 0).otherwise(1) + F.when(rec0.isNull(), 0).otherwise(1)
    bal = F.try_divide(F.coalesce(rec1, F.lit(0.0)) + F.coalesce(rec0, F.lit(0.0)), present)  # null without rows
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)
    return c.select(
        F.try_divide(tp + tn, n).alias("accuracy"),
        bal.alias("balanced_accuracy"),
        _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_score"),
        mcc.alias("mcc"),
    )


def classification_report(df: DataFrame, label: str = S.LABEL, pred: str = PRED,
                          counts: DataFrame | None = None) -> DataFrame:
    """E5: per class precision/recall/F1/support, accuracy, macro and weighted averages."""
    c = confusion_counts(df, label, pred) if counts is None else counts
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    # class 1: (tp, fp, fn); class 0 mirrors it: (tn, fn, fp)
    def cls(name, a, b, d):
        prec = _div0(a, a + b)
        rec = _div0(a, a + d)
        f1 = _div0(2 * a, 2 * a + b + d)
        present = (a + b + d) > 0  # class seen in truth or prediction
        return F.struct(F.lit(name).alias("label"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1_score"), (a + d).cast("bigint").alias("support"), present.alias("present"))
    n = tp + fp + fn + tn
    rows = c.select(F.explode(F.array(cls("0", tn, fn, fp), cls("1", tp, fp, fn))).alias("e"), n.alias("n"))
    per = rows.select("e.*", "n").where("present").drop("present")
    k = F.count(F.lit(1))
    avgs = per.groupBy().agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("bigint").alias("s"), k.alias("k"),
    )
    acc = c.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   ((tp + tn).cast("double") / n).alias("f1_score"), n.cast("bigint").alias("support"))
    macro = avgs.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                        F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("s").alias("support"))
    weighted = avgs.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                           F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), F.col("s").alias("support"))
    return per.drop("n").unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, label: str = S.LABEL, pred: str = PRED,
                     normalize: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Always 2x2 in order (0, 1): rows (true_label, predicted_label, value)."""
    if normalize not in (None, "true", "pred", "all"):
        raise E.ConfusionMatrixError("normalize must be one of None, 'true', 'pred', 'all'")
    c = confusion_counts(df, label, pred) if counts is None else counts
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    t0 = F.col("tn") + F.col("fp")
    t1 = F.col("fn") + F.col("tp")
    p0 = F.col("tn") + F.col("fn")
    p1 = F.col("fp") + F.col("tp")
    total = t0 + t1

    def value(t, p, name):
        v = F.col(name)
        if normalize is None:
            return v.cast("bigint")
        den = {"true": t0 if t == 0 else t1, "pred": p0 if p == 0 else p1, "all": total}[normalize]
        return _div0(v, den)

    structs = [F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"),
                        value(t, p, n).alias("value")) for t, p, n in cells]
    return c.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


# ------------------------------------------------------------ score based ---
def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with positive and negative counts (partial aggregation first)."""
    y = F.col(label).cast("bigint")
    return df.groupBy(F.col(score).cast("double").alias(SCORE)).agg(
        F.sum(y).alias("pos"), (F.count(F.lit(1)) - F.sum(y)).alias("neg"))


def roc_auc(df: DataFrame, label: str = S.LABEL, score: str = SCORE, buckets: int | None = None) -> float | None:
    """Exact ROC AUC with ties counted half; None for one class."""
    t = persist_adaptive(score_table(df, label, score))
    try:
        tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
        P, N = int(tot["P"] or 0), int(tot["N"] or 0)
        if P == 0 or N == 0:
            return None
        r = running_sums(t, SCORE, ["neg"], buckets=buckets)
        term = (F.col("pos").cast("decimal(38,0)")
                * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")).cast("decimal(38,0)"))
        num = r.agg(F.sum(term).alias("s")).first()["s"]
        return int(num) / (2 * P * N)
    finally:
        t.unpersist()


def pr_curve_terms(t: DataFrame, P: int, buckets: int | None = None) -> DataFrame:
    """Per distinct score (descending): precision, recall and its trapezoid term."""
    r = running_sums(t, SCORE, ["pos", "neg"], descending=True, buckets=buckets)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prev = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    return r.select(SCORE, "pos", "neg", "cum_pos", "cum_neg", prec.alias("precision"),
                    (tp / F.lit(float(P))).alias("recall"),
                    (F.col("pos").cast("double") * (prec + prev) / F.lit(2.0 * P)).alias("term"))


def pr_auc(df: DataFrame, label: str = S.LABEL, score: str = SCORE, buckets: int | None = None) -> float | None:
    """Trapezoid area under the PR curve from (0, 1); None for one class."""
    t = persist_adaptive(score_table(df, label, score))
    try:
        tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
        P, N = int(tot["P"] or 0), int(tot["N"] or 0)
        if P == 0 or N == 0:
            return None
        terms = pr_curve_terms(t, P, buckets)
        s = terms.agg(F.sum(F.col("term").cast("decimal(38,18)")).alias("s")).first()["s"]
        return float(s)
    finally:
        t.unpersist()


def score_aucs(df: DataFrame, label: str = S.LABEL, score: str = SCORE,
               buckets: int | None = None) -> tuple[float | None, float | None]:
    """(E6, E7) from ONE score table and ONE ascending running-sum pass."""
    t = persist_adaptive(score_table(df, label, score))
    try:
        return table_aucs(t, buckets)
    finally:
        t.unpersist()


def table_aucs(t: DataFrame, buckets: int | None = None) -> tuple[float | None, float | None]:
    """(E6, E7) of a :func:`score_table`.

    Descending sums come from the ascending ones: ``P - cum_pos + pos`` and
    ``N - cum_neg + neg``, so both areas equal :func:`roc_auc` and
    :func:`pr_auc` exactly (same integer counts, same exact decimal sums).
    """
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = int(tot["P"] or 0), int(tot["N"] or 0)
    if P == 0 or N == 0:
        return None, None
    r = running_sums(t, SCORE, ["pos", "neg"], buckets=buckets)
    roc = (F.col("pos").cast("decimal(38,0)")
           * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")).cast("decimal(38,0)"))
    tp = (F.lit(P) - F.col("cum_pos") + F.col("pos")).cast("double")
    fp = (F.lit(N) - F.col("cum_neg") + F.col("neg")).cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prev = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    pr = F.col("pos").cast("double") * (prec + prev) / F.lit(2.0 * P)
    row = r.agg(F.sum(roc).alias("roc"), F.sum(pr.cast("decimal(38,18)")).alias("pr")).first()
    return int(row["roc"]) / (2 * P * N), float(row["pr"])


def checked_score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """:func:`score_table` that also counts rows with a null label (``unlabelled``) and other labels (``other``): all that an
    evaluation needs, mergeable from any partitioning, in one pass over the rows."""
    y = F.col(label)
    return df.groupBy(F.col(score).cast("double").alias(SCORE)).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count_if(y.isNull()).alias("unlabelled"),
        F.count_if(~y.isin(0, 1)).alias("other"))


# ------------------------------------------------------------ consolidated ---
def compute(df: DataFrame, label: str = S.LABEL, pred: str = PRED, prob: str | None = None) -> dict:
    """E1-E7 for given predicted labels and, optionally, class-1 probabilities.

    ``roc_auc`` / ``pr_auc`` are None without probabilities or with one class.
    """
    counts = counts_frame(df.sparkSession, validate_inputs(df, label, pred, prob))
    out = binary_metrics(df, label, pred, counts).first().asDict()
    out["classification_report"] = [r.asDict() for r in classification_report(df, label, pred, counts).collect()]
    if prob is None:
        out["roc_auc"] = out["pr_auc"] = None
    else:
        out["roc_auc"], out["pr_auc"] = score_aucs(df, label, prob)
    return out



def evaluate_scores(df: DataFrame, label: str = S.LABEL, score: str = SCORE,
                    threshold: float = S.DEFAULT_THRESHOLD) -> dict:
    """E9 core: all metrics of a scored frame (label + positive-class score)."""
    t = persist_adaptive(checked_score_table(df, label, score))  # the one pass over the scored rows
    try:
        rows, s = F.col("pos") + F.col("neg") + F.col("unlabelled") + F.col("other"), F.col(SCORE)
        hit = predict_at(SCORE, threshold) == 1
        sums = {"n": rows, "unlabelled": F.col("unlabelled"), "other": F.col("other"),
                "bad_score": F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), rows),
                "tp": F.when(hit, F.col("pos")), "fp": F.when(hit, F.col("neg")), "fn": F.when(~hit, F.col("pos")), "tn": F.when(~hit, F.col("neg"))}
        r = t.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]).first().asDict()
        for wrong, text in ((r["n"] == 0, "there are no rows to evaluate"), (r["unlabelled"], f"null in {label}"),
                            (r["other"], f"{label} must be 0 or 1"), (r["bad_score"], f"null, NaN or infinite {score}")):
            if wrong:
                raise E.MetricsError(text)
        counts = counts_frame(df.sparkSession, r)
        m = binary_metrics(df, label, PRED, counts).first().asDict()
        m["classification_report"] = [x.asDict() for x in classification_report(df, label, PRED, counts).collect()]
        m["confusion_matrix"] = [[int(r["tn"]), int(r["fp"])], [int(r["fn"]), int(r["tp"])]]
        m["roc_auc"], m["pr_auc"] = table_aucs(t)
    finally:
        t.unpersist()
    return m


def flat_report(report: dict) -> list[tuple[str, float | None]]:
    """(metric, value) rows of :func:`evaluate_scores`: scalars, confusion cells and the report by class."""
    rows = [(k, v) for k, v in report.items() if not isinstance(v, list)]
    rows += [(f"confusion_{t}{p}", float(report["confusion_matrix"][t][p])) for t in (0, 1) for p in (0, 1)]
    for line in report["classification_report"]:
        rows += [(f"{line['label']} {k}", None if line[k] is None else float(line[k])) for k in ("precision", "recall", "f1_score", "support")]
    return rows
