"""Registered queries that hold the model half, the written tables and the failure reports against SQL.

Tree learners differ between engines, so what can be stated exactly is: a forest of one stump (its split is
the best weighted Gini gain), the identities that any model's scores and attributions obey, and rankings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.forest import MIX, POISSON_LIMITS, TREE_STEP
from ..sources.adapter import oracle_with_tx, transactions
from .oracle_sql import FEATURE_CTES, with_features
from .queries import _SPLIT_SQL, _SRC_NO_ID, engineered, query, trained

_CLEAN_SQL = f"""
, clean AS (SELECT min(row_id) AS row_id, {", ".join(_SRC_NO_ID)} FROM tx
  WHERE {" AND ".join(c + " IS NOT NULL" for c in [S.ROW_ID, *_SRC_NO_ID])} GROUP BY {", ".join(_SRC_NO_ID)})
"""
_CLEAN_SPLIT_SQL = _CLEAN_SQL + _SPLIT_SQL.replace("FROM tx", "FROM clean")


# ------------------------------------------------------------------ stump ---
STUMP_INPUTS = ("is_weekend", "is_night", "risk_large_transaction", "risk_balance_drained", "risk_new_receiver",
                "risk_rapid_activity", "risk_first_transaction", "risk_high_balance_usage")


def _stump_sql(body: str) -> str:
    """Gini gain of each two-valued input under balanced class weights; ``best`` is the split."""
    sides = "\nUNION ALL\n".join(
        f"SELECT {i} AS i, '{c}' AS feature, sum(w * isFraud) FILTER (WHERE {c} = 1) AS p1, sum(w) FILTER (WHERE {c} = 1) AS n1, "
        f"sum(w * isFraud) FILTER (WHERE {c} = 0) AS p0, sum(w) FILTER (WHERE {c} = 0) AS n0 FROM tr"
        for i, c in enumerate(STUMP_INPUTS))
    return oracle_with_tx(_SPLIT_SQL + FEATURE_CTES + f"""
, side AS (SELECT s.*, a.split FROM scored s JOIN assigned a ON a.row_id = s.row_id)
, tr AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY isFraud)) AS w
         FROM side WHERE split = 'train')
, g AS ({sides})
, gain AS (SELECT *, n1 / (n1 + n0) * 2 * (p1 / n1) * (1 - p1 / n1) + n0 / (n1 + n0) * 2 * (p0 / n0) * (1 - p0 / n0) AS rest
           FROM g WHERE n1 > 0 AND n0 > 0)
, best AS (SELECT * FROM gain ORDER BY round(rest, 12), i LIMIT 1)
""" + body)


def _stump(spark: SparkSession, sf_dir: str):
    from ..operators.models import ModelTrainer, build_random_forest
    from ..operators.split import SPLIT_COL, StratifiedSplitter

    df = StratifiedSplitter(test_size=0.2, random_state=42).assign(engineered(spark, sf_dir))
    spec = build_random_forest(n_estimators=1, max_depth=1, max_features=None, bootstrap=False, class_weight="balanced")
    return ModelTrainer(spec).train(df.where(F.col(SPLIT_COL) == "train"), list(STUMP_INPUTS)), df


@query("stump_scores", _stump_sql(f"""
SELECT row_id, round(CASE CASE best.feature {" ".join(f"WHEN '{c}' THEN side.{c}" for c in STUMP_INPUTS)} END
  WHEN 1 THEN p1 / n1 ELSE p0 / n0 END, 9) AS score
FROM side, best WHERE split = 'test'
"""))
def stump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3, M4, M5, M7: a balanced forest of one stump (no bootstrap, all inputs), trained on the train side; test scores."""
    from ..operators.models import score

    model, df = _stump(spark, sf_dir)
    return score(model, df.where("split = 'test'")).select(S.ROW_ID, F.round("score", 9).alias("score"))


@query("stump_importance", _stump_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST((SELECT feature FROM best) = '{c}' AS DOUBLE) AS importance" for c in STUMP_INPUTS)))
def stump_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 of the stump: all importance is with the input it splits by."""
    from ..operators.models import feature_importance

    return feature_importance(_stump(spark, sf_dir)[0])


BAGS = 7


def _out_of_bag_sql() -> str:
    """Bags by the hash of (row, tree), the best stump of each bag, and the mean of those trees that did not draw a row."""
    sides = "\nUNION ALL\n".join(
        f"SELECT t, {i} AS i, sum(w * k * isFraud) FILTER (WHERE {c} = 1) AS p1, sum(w * k) FILTER (WHERE {c} = 1) AS n1, "
        f"sum(w * k * isFraud) FILTER (WHERE {c} = 0) AS p0, sum(w * k) FILTER (WHERE {c} = 0) AS n0, "
        f"count(*) AS seen, count(*) FILTER (WHERE {c} = 1) AS seen1 FROM bag WHERE k > 0 GROUP BY t" for i, c in enumerate(STUMP_INPUTS))
    low = f"((CAST(row_id % 4294967296 AS UBIGINT) + CAST((42 + (t + 1) * {TREE_STEP}) % 4294967296 AS UBIGINT)) % 4294967296)"
    steps = [f"h0 AS (SELECT tr.*, t, {low} AS x FROM tr, range({BAGS}) AS trees(t))"]
    for n, (shift, factor) in enumerate(MIX * 2):
        if n == len(MIX):
            steps.append("h_high AS (SELECT * REPLACE (xor(x, CAST(row_id >> 32 AS UBIGINT)) AS x) FROM h3)")
        source = "h_high" if n == len(MIX) else f"h{n}"
        steps.append(f"h{n + 1} AS (SELECT * REPLACE ((xor(x, x >> {shift}) * {factor}) % 4294967296 AS x) FROM {source})")
    drawn = " + ".join(f"CAST(x >= {limit} AS INT)" for limit in POISSON_LIMITS)
    return oracle_with_tx(_SPLIT_SQL + FEATURE_CTES + f"""
, side AS (SELECT s.*, a.split FROM scored s JOIN assigned a ON a.row_id = s.row_id)
, tr AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY isFraud)) AS w
         FROM side WHERE split = 'train')
, {", ".join(steps)}
, bag AS (SELECT *, {drawn} AS k FROM h{2 * len(MIX)})
, g AS ({sides})
, gain AS (SELECT *, n1 / (n1 + n0) * 2 * (p1 / n1) * (1 - p1 / n1) + n0 / (n1 + n0) * 2 * (p0 / n0) * (1 - p0 / n0) AS rest
           FROM g WHERE seen1 >= 40 AND seen - seen1 >= 40)
, best AS (SELECT * FROM gain QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(rest, 12), i) = 1)
, vote AS (SELECT bag.row_id, CASE CASE best.i {" ".join(f"WHEN {i} THEN bag.{c}" for i, c in enumerate(STUMP_INPUTS))} END
  WHEN 1 THEN p1 / n1 ELSE p0 / n0 END AS p FROM bag JOIN best ON best.t = bag.t WHERE k = 0)
, votes AS (SELECT row_id, count(*) AS n, avg(p) AS p FROM vote GROUP BY row_id)
, score AS (SELECT avg(CAST((v.p > 0.5) = (tr.isFraud = 1) AS DOUBLE)) AS s FROM votes v JOIN tr ON tr.row_id = v.row_id)
SELECT tr.row_id, CAST(coalesce(v.n, 0) AS INT) AS oob_trees, round(v.p, 9) AS oob_score, round((SELECT s FROM score), 9) AS forest_oob_score
FROM tr LEFT JOIN votes v ON v.row_id = tr.row_id
""")


@query("forest_out_of_bag", _out_of_bag_sql())
def forest_out_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with ``oob_score`` and least sizes: a balanced forest of stumps on bags drawn by hash; the out-of-bag score of every
    training row, and the forest's (the share of rows with one that are classed right)."""
    from ..operators.models import ModelTrainer, build_random_forest
    from ..operators.split import SPLIT_COL, StratifiedSplitter

    df = StratifiedSplitter(test_size=0.2, random_state=42).assign(engineered(spark, sf_dir))
    train = df.where(F.col(SPLIT_COL) == "train")
    spec = build_random_forest(n_estimators=BAGS, max_depth=1, max_features=None, oob_score=True, min_samples_split=50, min_samples_leaf=40)
    model = ModelTrainer(spec).train(train, list(STUMP_INPUTS))
    rows = model.stages[-1].out_of_bag(model.stages[0].transform(train), S.ROW_ID)
    return rows.select(S.ROW_ID, "oob_trees", F.round("oob_score", 9).alias("oob_score"),
                       F.round(F.lit(model.stages[-1].oob_score), 9).alias("forest_oob_score"))


def _boosted_stump_sql(lam: float, alpha: float, least: float) -> str:
    """One round from margin 0: g is 0.5 - y and h is 0.25 for every row; the best gain splits."""
    sides = "\nUNION ALL\n".join(
        f"SELECT {i} AS i, '{c}' AS feature, sum(0.5 - isFraud) FILTER (WHERE {c} = 1) AS g1, 0.25 * count(*) FILTER (WHERE {c} = 1) AS h1, "
        f"sum(0.5 - isFraud) FILTER (WHERE {c} = 0) AS g0, 0.25 * count(*) FILTER (WHERE {c} = 0) AS h0 FROM tr" for i, c in enumerate(STUMP_INPUTS))

    def soft(g: str) -> str:
        return f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))"

    def part(g: str, h: str) -> str:
        return f"{soft(g)} * {soft(g)} / ({h} + {lam})"

    return oracle_with_tx(_SPLIT_SQL + FEATURE_CTES + f"""
, side AS (SELECT s.*, a.split FROM scored s JOIN assigned a ON a.row_id = s.row_id)
, tr AS (SELECT * FROM side WHERE split = 'train')
, sums AS (SELECT i, feature, CAST(g1 AS DOUBLE) AS g1, CAST(g0 AS DOUBLE) AS g0, CAST(h1 AS DOUBLE) AS h1, CAST(h0 AS DOUBLE) AS h0 FROM ({sides}))
, gain AS (SELECT *, {part('g1', 'h1')} + {part('g0', 'h0')} - {part('(g1 + g0)', '(h1 + h0)')} AS gain FROM sums WHERE h1 >= {least} AND h0 >= {least})
, best AS (SELECT * FROM gain ORDER BY round(gain, 9) DESC, i LIMIT 1)
SELECT row_id, round(1 / (1 + exp({soft('g')} / (h + {lam}))), 9) AS score
FROM (SELECT row_id, CASE WHEN passed = 1 THEN g1 ELSE g0 END AS g, CASE WHEN passed = 1 THEN h1 ELSE h0 END AS h FROM (
  SELECT row_id, best.*, CASE best.feature {" ".join(f"WHEN '{c}' THEN side.{c}" for c in STUMP_INPUTS)} END AS passed FROM side, best WHERE split = 'test'))
""")


@query("boosted_stump_scores", _boosted_stump_sql(2.5, 3.0, 5.0))
def boosted_stump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: one round of depth 1 of second-order boosting with both penalties and a least hessian; scores of every test row."""
    from ..operators.models import ModelTrainer, build_boosted_trees, score
    from ..operators.split import SPLIT_COL, StratifiedSplitter

    df = StratifiedSplitter(test_size=0.2, random_state=42).assign(engineered(spark, sf_dir))
    spec = build_boosted_trees(n_estimators=1, max_depth=1, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0, reg_lambda=2.5, reg_alpha=3.0,
                               min_child_weight=5)
    model = ModelTrainer(spec).train(df.where(F.col(SPLIT_COL) == "train"), list(STUMP_INPUTS))
    return score(model, df.where("split = 'test'")).select(S.ROW_ID, F.round("score", 9).alias("score"))


@query("boosted_saved_scores", oracle_with_tx(
    _CLEAN_SPLIT_SQL + "SELECT row_id, CAST(1 AS INTEGER) AS same_score, CAST(1 AS INTEGER) AS adds_up FROM assigned WHERE split = 'test'"))
def boosted_saved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, S9, S10, M6, X1 for every test row: a saved and loaded second-order model gives the score of the one that was saved,
    and base value and attributions add up to the logit of that score."""
    from ..operators.explain import BASE, TreeExplainer
    from ..operators.models import ModelTrainer, build_boosted_trees, feature_columns, load_model, save_model, score
    from .jobs import scratch_dir
    from .queries import model_frame

    df = model_frame(spark, sf_dir)
    train, test = (df.where(F.col("split") == s) for s in ("train", "test"))
    model = ModelTrainer(build_boosted_trees(n_estimators=5, max_depth=4, learning_rate=0.3)).train(train, feature_columns(train))
    loaded = load_model(save_model(model, scratch_dir(spark, "boosted") + "/model"))
    a = score(model, test).select(S.ROW_ID, "score")
    b = score(loaded, test).select(F.col(S.ROW_ID).alias("_b"), F.col("score").alias("_loaded"))
    ex = TreeExplainer(loaded, spark=spark)
    c = ex.attributions(test, validate=False).select(F.col(S.ROW_ID).alias("_c"), sum((F.col(f"`{x}`") for x in ex.features), F.col(BASE)).alias("_total"))
    both = a.join(b, F.col(S.ROW_ID) == F.col("_b")).join(c, F.col(S.ROW_ID) == F.col("_c"))
    return both.select(S.ROW_ID, (F.abs(F.col("score") - F.col("_loaded")) <= 1e-12).cast("int").alias("same_score"),
                       (F.abs(1 / (1 + F.exp(-F.col("_total"))) - F.col("score")) <= 1e-9).cast("int").alias("adds_up"))


# ------------------------------------------------------------- identities ---
@query("attribution_additivity", oracle_with_tx(
    _CLEAN_SPLIT_SQL + "SELECT row_id, CAST(1 AS INTEGER) AS adds_up, CAST(1 AS INTEGER) AS is_score "
                       "FROM assigned WHERE split = 'test'"))
def attribution_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 for every test row: base value and attributions add up to the output, and the output is the model's own score."""
    from ..operators.explain import BASE, OUTPUT, TreeExplainer
    from ..operators.models import score

    model, df = trained(spark, sf_dir, "gbt")
    test = df.where("split = 'test'")
    ex = TreeExplainer(model)
    total = sum((F.col(f"`{c}`") for c in ex.features), F.col(BASE))
    parts = ex.attributions(test).select(S.ROW_ID, F.col(OUTPUT), total.alias("total"))
    own = score(model, test).select(F.col(S.ROW_ID).alias("_id"), "score")
    both = parts.join(own, F.col(S.ROW_ID) == F.col("_id"))
    return both.select(
        S.ROW_ID, (F.abs(F.col("total") - F.col(OUTPUT)) <= 1e-6).cast("int").alias("adds_up"),
        (F.abs(1 / (1 + F.exp(-F.col(OUTPUT))) - F.col("score")) <= 1e-6).cast("int").alias("is_score"))


@query("score_threshold", oracle_with_tx(
    _CLEAN_SPLIT_SQL + "SELECT row_id, CAST(1 AS INTEGER) AS in_range, CAST(1 AS INTEGER) AS agrees "
                       "FROM assigned WHERE split = 'test'"))
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 on model scores for every test row: scores are shares, and the prediction is 1 from the threshold 0.3 on."""
    from ..operators.models import score

    model, df = trained(spark, sf_dir, "gbt")
    scored = score(model, df.where("split = 'test'"), threshold=0.3)
    return scored.select(S.ROW_ID, F.col("score").between(0, 1).cast("int").alias("in_range"),
                         (F.col("prediction") == (F.col("score") >= 0.3).cast("int")).cast("int").alias("agrees"))


_FLAGS = [c for c in S.RISK_FEATURES if c.startswith("risk_") and c != "risk_score"]


@query("top_risk_flags", with_features(
    ", imp AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(sum({c}) AS DOUBLE) / CAST(sum(risk_score) AS DOUBLE) AS importance FROM scored" for c in _FLAGS)
    + ") SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 5"))
def top_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 (a top-5 report): the risk flags with the largest shares of all risk points."""
    from ..operators.models import top_features

    one = engineered(spark, sf_dir).agg(F.sum("risk_score").cast("double").alias("_all"),
                                        *[F.sum(c).cast("double").alias(c) for c in _FLAGS])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) / F.col("_all")).alias("importance")) for c in _FLAGS])
    return top_features(one.select(F.explode(cells).alias("e")).select("e.*"), 5)


@query("behavior_batches", with_features("SELECT row_id, " + ", ".join(S.BEHAVIOR_FEATURES) + " FROM scored"))
def behavior_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 on a stream, W1-W12: tx cut into three batches of steps, each with the account history of those before; equals one batch."""
    from ..operators.behavior import BehaviorFeatures, account_history, merge_histories

    tx = transactions(spark, sf_dir)
    out, history = None, None
    for where in ("step < 200", "step between 200 and 499", "step >= 500"):
        batch = tx.where(where)
        stage = BehaviorFeatures("window")
        stage.history = history
        part = stage.transform(batch).select(S.ROW_ID, *S.BEHAVIOR_FEATURES)
        out = part if out is None else out.unionByName(part)
        own = account_history(batch)
        history = own if history is None else merge_histories(history.unionByName(own))
    return out


# ------------------------------------------------------ failing inputs ---
_PLANTED = {
    "amount": "CASE WHEN row_id % 50 = 7 THEN -1.0 ELSE amount END",
    "oldbalanceDest": "CASE WHEN row_id % 70 = 3 THEN -2.5 ELSE oldbalanceDest END",
    "type": "CASE WHEN type = 'PAYMENT' AND step % 40 = 0 THEN 'REFUND_' || CAST(step AS STRING) ELSE type END",
}


def _planted_sql(*columns: str) -> str:
    cells = ["row_id", *_SRC_NO_ID]
    return "SELECT " + ", ".join(f"{_PLANTED[c]} AS {c}" if c in columns else c for c in cells) + " FROM tx"


def _integrity_sql() -> str:
    names = "[' || string_agg(chr(39) || c || chr(39), ', ' ORDER BY i) || ']"
    bad = "\nUNION ALL\n".join(f"SELECT {i} AS i, '{c}' AS c FROM neg WHERE {c} < 0 GROUP BY 1, 2" for i, c in enumerate(S.NON_NEGATIVE_COLUMNS))
    return oracle_with_tx(f"""
, neg AS ({_planted_sql("amount", "oldbalanceDest")})
, odd AS ({_planted_sql("type").replace("STRING", "VARCHAR")})
, kinds AS (SELECT type, row_number() OVER (ORDER BY type) AS k, count(*) OVER () AS m FROM odd WHERE type LIKE 'REFUND%' GROUP BY type)
, texts AS (
  SELECT 'negative' AS input, 'Negative values found in: {names}' AS message FROM ({bad})
  UNION ALL
  SELECT 'unknown type', 'Unknown transaction type(s): Invalid values in ''type'': [' || string_agg(chr(39) || type || chr(39), ', ' ORDER BY k) FILTER (WHERE k <= 20)
    || ']' || CASE WHEN max(m) > 20 THEN ' and ' || (max(m) - 20) || ' more of ' || max(m) || ' (offending_table() lists all)' ELSE '' END FROM kinds)
SELECT input, mode, 'DataIntegrityError' AS error, message FROM texts, (SELECT 'eager' AS mode UNION ALL SELECT 'job')
""")


@query("integrity_errors", _integrity_sql())
def integrity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of tx with planted rows, by the eager check and by the data job (found inside its write): the same text,
    with every failing column or value."""
    from .. import errors as E
    from ..operators.preprocess import Preprocessor
    from .jobs import run_data_pipeline, scratch_dir

    transactions(spark, sf_dir)
    rows = []
    for name, columns in (("negative", ("amount", "oldbalanceDest")), ("unknown type", ("type",))):
        bad = spark.sql(_planted_sql(*columns))
        for mode, run in (("eager", lambda d: Preprocessor(salt="").process(d)), ("job", lambda d: run_data_pipeline(spark, d, scratch_dir(spark, "bad")))):
            try:
                run(bad)
            except E.TxRiskError as exc:
                rows.append((name, mode, type(exc).__name__, str(exc)))
    return spark.createDataFrame(rows, "input string, mode string, error string, message string")


# -------------------------------------------------- tables and reports ---
@query("ingest_row_ids", oracle_with_tx("""
SELECT f.fmt, t.row_number AS row_id, t.step, t.nameOrig FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_number, step, nameOrig FROM tx) t,
  (SELECT 'csv' AS fmt UNION ALL SELECT 'parquet') f
"""))
def ingest_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tx written to several ordered files as CSV and as Parquet, then loaded: row ids are dense and in file order."""
    from ..sources.io import load_transactions, write_table
    from .jobs import scratch_dir

    folder = scratch_dir(spark, "ingest")
    tx = transactions(spark, sf_dir)
    ordered = tx.repartitionByRange(5, S.ROW_ID).sortWithinPartitions(S.ROW_ID).select(*_SRC_NO_ID)
    out = None
    for fmt in ("csv", "parquet"):
        loaded = load_transactions(spark, write_table(ordered, f"{folder}/tx.{fmt}", fmt))
        part = loaded.select(F.lit(fmt).alias("fmt"), S.ROW_ID, S.STEP, S.NAME_ORIG)
        out = part if out is None else out.unionByName(part)
    return out


_MANY_SQL = """
SELECT row_id, CASE WHEN type = 'PAYMENT' THEN 'REFUND_' || CAST(step AS STRING) ELSE type END AS type,
  CASE WHEN type = 'DEBIT' THEN step ELSE isFraud END AS isFraud FROM tx
"""


@query("offending_values", oracle_with_tx(f", v AS ({_MANY_SQL.replace('STRING', 'VARCHAR')})" + f"""
SELECT 'unknown_type' AS rule, type AS value, count(*) AS n_rows FROM v
WHERE type NOT IN ({", ".join(f"'{t}'" for t in S.TRANSACTION_TYPES)}) GROUP BY type
UNION ALL SELECT 'bad_label', CAST(isFraud AS VARCHAR), count(*) FROM v WHERE isFraud NOT IN (0, 1) GROUP BY isFraud
"""))
def offending_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6, V9: every distinct unknown type and bad label of tx with planted ones, with row counts."""
    from ..operators import validate as V

    transactions(spark, sf_dir)
    df = spark.sql(_MANY_SQL)
    found = [V.offending_table(df, r).select(F.lit(r.name).alias("rule"), F.col("value").cast("string").alias("value"), "n_rows")
             for r in (V.categorical_rule(), V.target_rule())]
    return found[0].unionByName(found[1])


@query("split_class_balance", oracle_with_tx(_SPLIT_SQL + """
SELECT split, count(*) AS n_rows, round(avg(CAST(isFraud AS DOUBLE)) * 100, 9) AS fraud_pct FROM assigned GROUP BY split
"""))
def split_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and fraud percentage of each side of the stratified split."""
    from ..operators.split import StratifiedSplitter, class_balance

    sides = StratifiedSplitter(test_size=0.2, random_state=42).assign(transactions(spark, sf_dir))
    return class_balance(sides).withColumn("fraud_pct", F.round("fraud_pct", 9))


@query("first_rows", oracle_with_tx(f"SELECT row_id, {', '.join(_SRC_NO_ID)} FROM tx ORDER BY row_id LIMIT 5"))
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 (a preview): the first five rows in input order."""
    from ..operators.profile import preview

    return preview(transactions(spark, sf_dir).select(S.ROW_ID, *_SRC_NO_ID))


_WRITTEN = [S.ROW_ID, "amount_bucket", "sender_txn_count", "receiver_time_gap", "day_of_week", *S.RISK_FEATURES]


@query("pipeline_written_features", oracle_with_tx(
    _CLEAN_SQL + FEATURE_CTES.replace("FROM tx", "FROM clean").replace("tx.*", "clean.*") + "SELECT " + ", ".join(_WRITTEN) + " FROM scored"))
def pipeline_written_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engineered rows as read back from both sides of the written split."""
    from ..sources.io import read_split
    from .jobs import run_data_pipeline, scratch_dir

    out = run_data_pipeline(spark, transactions(spark, sf_dir), scratch_dir(spark, "pipeline"))
    sides = [read_split(spark, out["split"], s).select(*_WRITTEN) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


_X_COLUMNS = [S.ROW_ID, S.STEP, S.AMOUNT, "sender_balance_delta", "receiver_txn_count", "day_of_week", "risk_score"]


@query("split_side_tables", oracle_with_tx(
    _CLEAN_SQL + _SPLIT_SQL.replace("FROM tx", "FROM clean") + FEATURE_CTES.replace("FROM tx", "FROM clean").replace("tx.*", "clean.*")
    + f"SELECT a.split AS side, {', '.join('s.' + c for c in _X_COLUMNS)}, s.isFraud FROM scored s JOIN assigned a ON a.row_id = s.row_id"))
def split_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X from the Parquet outputs and y from the CSV outputs of the data job, put together again by row id."""
    from .jobs import run_data_pipeline, scratch_dir

    out = run_data_pipeline(spark, transactions(spark, sf_dir), scratch_dir(spark, "sides"), formats=("parquet", "csv"), sides=True)
    found = None
    for side in ("train", "test"):
        x = spark.read.parquet(out[f"X_{side}"])
        y = spark.read.schema(f"{S.ROW_ID} bigint, {S.LABEL} int").option("header", True).csv(out[f"y_{side}.csv"])
        both = x.join(y, S.ROW_ID).select(F.lit(side).alias("side"), *_X_COLUMNS, S.LABEL)
        found = both if found is None else found.unionByName(both)
    return found
