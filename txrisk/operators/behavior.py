"""Behaviour features W1-W12: per-account running history.

For each side (sender = ``nameOrig``, receiver = ``nameDest``) and each row,
in the order ``(step, row_id)`` within the account:

* running count (1-based), gap to the previous step (-1 if none),
* mean of strictly earlier amounts (own amount if none), deviation from it,
* first-transaction and rapid-activity flags.

Two plans give identical results:

``mode="window"``
    one ``Window.partitionBy(account).orderBy(step, row_id)`` per side; one
    task holds a whole account, so a hot account (a third of all rows) runs
    serially in one task.

``mode="blocked"`` (skew-safe)
    rows are cut into ranges of ``(account, step, row_id)`` of about equal
    size, however many rows one account has, and written once to the shared
    folder with their range number. Windows run inside ``(range, account)``.
    Only an account at the edge of a range can go on in the next one, so at
    most two accounts of a range have rows elsewhere: their count, sum and last
    step in each range make a table of at most twice as many rows as there are
    ranges, whose running totals are the carry that rows of later ranges get.
    Count, sum and last step are decomposable, so this is exact, for any
    spread of an account over steps and any gaps between row ids.

``mode="auto"`` (default)
    one sampled probe job estimates the largest account on each side; a side
    whose estimate exceeds ``hot_key_rows`` uses the blocked plan, the other
    the single window. The probe only routes: both plans are exact.

Running sums use exact decimals, so neither plan nor partitioning changes a
bit of the result.

``history`` (:func:`account_history` of earlier rows) makes both plans go on
from the rows before: features of a table cut into consecutive pieces of
``(step, row_id)``, each with the history of those before it, equal those of
the whole table. Histories of pieces merge by :func:`merge_histories`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..functions.columns import flag, money, prior_mean
from ..session import ensure_checkpoint_dir, shuffle_partitions

DEFAULT_HOT_KEY_ROWS = 1 << 20
PROBE_HITS = 200  # expected sampled rows of an account right at the hot threshold

_SIDES = {
    "sender": S.NAME_ORIG,
    "receiver": S.NAME_DEST,
}


def _finish(df: DataFrame, side: str, count_c, prior_count_c, prior_sum_c, gap_c) -> list:
    """Feature columns of one side from count, prior count/sum and raw gap."""
    amount = F.col(S.AMOUNT)
    avg = prior_mean(prior_sum_c, prior_count_c, amount).cast("float")
    gap = gap_c.cast("float")
    return [
        count_c.cast("int").alias(f"{side}_txn_count"),
        gap.alias(f"{side}_time_gap"),
        avg.alias(f"{side}_avg_amount"),
        (amount - avg.cast("double")).cast("float").alias(f"{side}_amount_deviation"),
        flag(count_c == 1).alias(f"is_first_{side}_transaction"),
        flag((gap >= 0) & (gap <= S.RAPID_GAP)).alias(f"rapid_{side}_activity"),
    ]


RANGE = "_range"
_PAST = ("_h_n", "_h_sum", "_h_last")
HISTORY = "side string, account string, n bigint, total decimal(38,6), last_step int"


def account_history(df: DataFrame) -> DataFrame:
    """``HISTORY`` rows: count, sum of amounts and last step of every account on each side."""
    both = None
    for side, key in _SIDES.items():
        one = df.groupBy(F.col(key).alias("account")).agg(
            F.count("*").alias("n"), F.sum(money(S.AMOUNT)).cast("decimal(38,6)").alias("total"), F.max(S.STEP).cast("int").alias("last_step"))
        one = one.select(F.lit(side).alias("side"), "account", "n", "total", "last_step")
        both = one if both is None else both.unionByName(one)
    return both


def merge_histories(histories: DataFrame) -> DataFrame:
    """One row for each side and account of histories of several pieces."""
    return histories.groupBy("side", "account").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"), F.max("last_step").alias("last_step"))


def _with_past(df: DataFrame, side: str, history: DataFrame | None) -> DataFrame:
    """``df`` with count, sum and last step of each row's account before the frame (0, 0, null without any)."""
    if history is None:
        none = [F.lit(0).cast("bigint"), F.lit(0).cast("decimal(38,6)"), F.lit(None).cast("int")]
        return df.select("*", *[c.alias(n) for c, n in zip(none, _PAST)])
    own = history.where(F.col("side") == side).select(F.col("account").alias("_h_acc"), F.col("n").alias("_h_n0"), F.col("total").alias("_h_s0"),
                                                      F.col("last_step").alias(_PAST[2]))
    j = df.join(own, F.col(_SIDES[side]).eqNullSafe(F.col("_h_acc")), "left")
    return j.select(*df.columns, F.coalesce("_h_n0", F.lit(0)).alias(_PAST[0]), F.coalesce("_h_s0", F.lit(0).cast("decimal(38,6)")).alias(_PAST[1]), _PAST[2])


def ranged(df: DataFrame, side: str, ranges: int) -> DataFrame:
    """``df`` cut by ``(account, step, row_id)``, written once and read back.

    The range number is stored with the row, so each branch of the plan reads
    the same cut (sampled bounds are never drawn again).
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    cut = df.repartitionByRange(ranges, _SIDES[side], S.STEP, S.ROW_ID)
    cut.withColumn(RANGE, F.spark_partition_id()).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def probe_fraction(hot_key_rows: int) -> float:
    """Sample fraction giving ~200 expected hits for an account at the threshold.

    It depends on the threshold, not the data size, so the probe's shuffle
    stays small on any input (about 0.02 % of rows for a 2^20-row threshold).
    """
    return min(1.0, PROBE_HITS / max(1, hot_key_rows))


def hot_sides(df: DataFrame, hot_key_rows: int = DEFAULT_HOT_KEY_ROWS,
              fraction: float | None = None, seed: int = S.RANDOM_STATE) -> dict[str, bool]:
    """Estimate, per side, whether some account holds more than ``hot_key_rows`` rows.

    One job over a Bernoulli sample of the two key columns; only two numbers
    come back. A routing hint only (see module doc), never a result.
    """
    fraction = probe_fraction(hot_key_rows) if fraction is None else fraction
    sample = df.select(S.NAME_ORIG, S.NAME_DEST).sample(fraction=fraction, seed=seed)
    keyed = sample.select(F.explode(F.array(
        F.struct(F.lit("sender").alias("side"), F.col(S.NAME_ORIG).alias("k")),
        F.struct(F.lit("receiver").alias("side"), F.col(S.NAME_DEST).alias("k")),
    )).alias("e")).select("e.side", "e.k")
    top = keyed.groupBy("side", "k").count().groupBy("side").agg(F.max("count").alias("m")).collect()
    est = {r["side"]: r["m"] / fraction for r in top}
    return {side: est.get(side, 0) > hot_key_rows for side in _SIDES}


def _running(w) -> tuple:
    """Row number, sum of earlier amounts and previous step over the ordered window ``w``."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(money(S.AMOUNT)).over(before), F.lit(0).cast("decimal(38,6)"))
    return F.row_number().over(w), earlier, F.lag(S.STEP, 1).over(w)


def _gap(prev) -> Column:
    return F.when(prev.isNull(), F.lit(S.NO_PRIOR_GAP)).otherwise(F.col(S.STEP) - prev)


def _side_window(df: DataFrame, side: str, history: DataFrame | None = None) -> DataFrame:
    n, prior_sum, prev = _running(Window.partitionBy(_SIDES[side]).orderBy(S.STEP, S.ROW_ID))
    if history is None:
        return df.select("*", *_finish(df, side, n, n - 1, prior_sum, _gap(prev)))
    past_n, past_sum, past_last = (F.col(c) for c in _PAST)
    j = _with_past(df, side, history)
    features = _finish(j, side, n + past_n, n - 1 + past_n, prior_sum + past_sum, _gap(F.coalesce(prev, past_last)))
    return j.select(*df.columns, *features)


def edge_carry(rows: DataFrame, key: str) -> DataFrame:
    """Count, sum and last step of the earlier ranges, for the accounts at the edges of each range.

    At most two rows a range, whatever the data size, so the table is broadcast.
    A struct around the account keeps a null account in the minimum and maximum.
    """
    edges = rows.groupBy(RANGE).agg(F.min(F.struct(key)).alias("lo"), F.max(F.struct(key)).alias("hi"))
    edges = edges.select(F.col(RANGE).alias("_r"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_e"))
    at_edge = rows.join(F.broadcast(edges), (F.col(RANGE) == F.col("_r")) & F.col(key).eqNullSafe(F.col(f"_e.{key}")))
    parts = at_edge.groupBy(F.col(key).alias("_k"), "_r").agg(
        F.count("*").alias("_n"), F.sum(money(S.AMOUNT)).alias("_s"), F.max(S.STEP).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_k", "_r", F.sum("_n").over(before).alias("_c_cnt"), F.sum("_s").over(before).alias("_c_sum"),
                         F.max("_last").over(before).alias("_c_prev"))
    return carry.where(F.col("_c_cnt").isNotNull())


def _side_blocked(df: DataFrame, side: str, ranges: int, history: DataFrame | None = None) -> DataFrame:
    key = _SIDES[side]
    rows = ranged(_with_past(df, side, history), side, ranges)
    i, inner, prev = _running(Window.partitionBy(RANGE, key).orderBy(S.STEP, S.ROW_ID))
    own = rows.select("*", i.alias("_i"), inner.alias("_in_sum"), prev.alias("_in_prev"))
    j = own.join(F.broadcast(edge_carry(rows, key)),
                 (F.col(RANGE) == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    past_n, past_sum, past_last = (F.col(c) for c in _PAST)
    count_c = F.coalesce(F.col("_c_cnt"), F.lit(0)) + F.col("_i") + past_n
    prior_sum = F.coalesce(F.col("_c_sum"), F.lit(0).cast("decimal(38,6)")) + F.col("_in_sum") + past_sum
    gap = _gap(F.coalesce(F.col("_in_prev"), F.col("_c_prev"), past_last))
    return j.select(*df.columns, *_finish(j, side, count_c, count_c - 1, prior_sum, gap))


class BehaviorFeatures:
    """Stage object for the chain: W1-W12 on both sides."""

    name = "BehaviorFeatures"
    row_local = False
    outputs = S.BEHAVIOR_FEATURES
    required = (S.STEP, S.AMOUNT, S.NAME_ORIG, S.NAME_DEST)

    def __init__(self, mode: str = "auto", ranges: int | None = None,
                 hot_key_rows: int = DEFAULT_HOT_KEY_ROWS, probe_fraction: float | None = None):
        if mode not in ("auto", "blocked", "window"):
            raise ValueError("mode must be 'auto', 'blocked' or 'window'")
        if ranges is not None and ranges < 1:
            raise ValueError("ranges must be None (the shuffle partitions of the session) or at least 1")
        if probe_fraction is not None and not 0 < probe_fraction <= 1:
            raise ValueError("probe_fraction must be in (0, 1]")
        self.mode = mode
        self.ranges = ranges
        self.hot_key_rows = hot_key_rows
        self.probe_fraction = probe_fraction
        self.last_plan: dict[str, str] = {}
        self.history: DataFrame | None = None  # of the rows before those to be transformed

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise E.BehaviorFeatureError(f"Missing required column(s) for behavior features: {missing}")
        if S.ROW_ID not in df.columns:
            raise E.BehaviorFeatureError(
                f"'{S.ROW_ID}' is required: it is the stable tiebreak inside a step "
                "(assign it once at ingest, see sources.io.with_row_id)")

    def transform(self, df: DataFrame, rows_hint: int | None = None) -> DataFrame:
        """``rows_hint``: the frame's known row count; when it is at most
        ``hot_key_rows`` no account can be hot, so ``auto`` skips the probe."""
        self.check(df)
        base = df.drop(*[c for c in self.outputs if c in df.columns])
        out = base
        if self.mode == "auto" and rows_hint is not None and rows_hint <= self.hot_key_rows:
            plan = {side: "window" for side in _SIDES}
        elif self.mode == "auto":
            hot = hot_sides(base, self.hot_key_rows, self.probe_fraction)
            plan = {side: "blocked" if hot[side] else "window" for side in _SIDES}
        else:
            plan = {side: self.mode for side in _SIDES}
        self.last_plan = plan
        ranges = self.ranges or shuffle_partitions(df.sparkSession)
        for side in _SIDES:
            out = (_side_window(out, side, self.history) if plan[side] == "window"
                   else _side_blocked(out, side, ranges, self.history))
        # column order: sender/receiver interleaved per feature
        return out.select(*base.columns, *S.BEHAVIOR_FEATURES)
