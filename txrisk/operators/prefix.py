"""Global running sums over a sorted key, without a single-partition window.

``Window.orderBy(k)`` with no partition runs in ONE task. Instead, rows are
cut into ``buckets`` ranges of the key at approximate quantile bounds,
each range's totals are summed (at most ``buckets`` numbers reach the
driver), and the running sum inside a range is a window partitioned by the
range plus that range's offset (a literal array lookup: no join).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions


def bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    """Range index of ``col`` (binary search in the JVM); one range -> 0."""
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out + "_d").transform(df)
    return b.withColumn(out, F.col(out + "_d").cast("int")).drop(out + "_d")


def running_sums(df: DataFrame, key: str, cols: list[str], descending: bool = False,
                 buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add inclusive running sums ``cum_<col>`` over ``key`` order.

    ``key`` must be unique per row (aggregate to distinct keys first) and
    not null; ``cols`` hold integers.
    """
    p = buckets or max(1, shuffle_partitions(df.sparkSession))
    ok = "_ok"
    base = df.withColumn(ok, (-F.col(key) if descending else F.col(key)).cast("double"))
    if p > 1:
        grid = [i / p for i in range(1, p)]
        bounds = base.agg(F.percentile_approx(ok, grid, 10 * p).alias("b")).first()["b"] or []
        inner = sorted({float(b) for b in bounds if b is not None and math.isfinite(b)})
    else:
        inner = []
    splits = [-math.inf] + inner + [math.inf]
    bk = bucketize(base, ok, splits, "_bk")
    totals = bk.groupBy("_bk").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    nb = len(splits) - 1
    per = {r["_bk"]: r for r in totals}
    offsets = {c: [] for c in cols}
    acc = {c: 0 for c in cols}
    for b in range(nb):
        for c in cols:
            offsets[c].append(acc[c])
            acc[c] += int(per[b][c] or 0) if b in per else 0
    w = Window.partitionBy("_bk").orderBy(ok).rowsBetween(Window.unboundedPreceding, 0)
    out = bk.select("*", *[
        (F.element_at(F.array(*[F.lit(v).cast("bigint") for v in offsets[c]]), F.col("_bk") + 1)
         + F.sum(c).over(w)).alias(f"{prefix}{c}")
        for c in cols
    ])
    return out.drop(ok, "_bk")
