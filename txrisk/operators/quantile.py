"""Exact quantiles (A1, A2) without sorting or collecting the column.

The answer must equal pandas ``Series.quantile`` (numpy 'linear' rule), so
the order statistics at ranks ``floor((n-1)q)`` and the next one are found
exactly, then interpolated on the driver with numpy's formula.

Order statistics are found by refinement: while the value range holding a
wanted rank has more than ``max_rows`` values, split it into up to
``buckets`` ranges at approximate quantile bounds (``percentile_approx``),
count each range (one small aggregate) and keep the range holding the rank.
Once a range is small enough, one task sorts it and returns only the wanted
elements. Nothing larger than ``buckets`` numbers reaches the driver, and no
task holds more than ``max_rows`` values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_plain_scan, persist_adaptive
from .prefix import bucketize

DEFAULT_BUCKETS = 1024
DEFAULT_MAX_ROWS = 100_000


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's _lerp: two forms, chosen by t, for monotonicity
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


def _order_stats(values: DataFrame, ranks: Sequence[int], n: int, buckets: int, max_rows: int,
                 root_bounds: list | None = None) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of column ``v`` (non-null, non-NaN)."""
    out: dict[int, float] = {}
    # work items: (lower bound incl. or None, upper bound excl. or None, rows before, rows inside, ranks)
    work = [(None, None, 0, n, sorted(set(ranks)))]
    while work:
        lo, hi, base, cnt, want = work.pop()
        known = root_bounds if (lo is None and hi is None) else None
        sub = values
        if lo is not None:
            sub = sub.where(F.col("v") >= F.lit(lo))
        if hi is not None:
            sub = sub.where(F.col("v") < F.lit(hi))
        if cnt <= max_rows:
            srt = F.array_sort(F.collect_list("v"))
            row = sub.agg(*[F.element_at(srt, r - base + 1).alias(f"r{r}") for r in want]).first()
            for r in want:
                out[r] = float(row[f"r{r}"])
            continue
        if known is not None:
            bounds = known
        else:
            bounds = sub.agg(F.percentile_approx("v", _grid(buckets), 10 * buckets).alias("b")).first()["b"]
        inner = sorted({float(b) for b in bounds
                        if (lo is None or b > lo) and (hi is None or b < hi)})
        splits = [-math.inf] + inner + [math.inf]
        stats = (bucketize(sub, "v", splits, "bk").groupBy("bk")
                 .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                 .collect())
        stats = sorted((int(r["bk"]), int(r["c"]), float(r["mn"]), float(r["mx"])) for r in stats)
        acc = base
        pending: dict[int, list] = {}
        for bk, c, mn, mx in stats:
            for r in want:
                if acc <= r < acc + c:
                    if mn == mx:
                        out[r] = mn
                    else:
                        pending.setdefault(bk, [acc, c, mn, mx, []])[4].append(r)
            acc += c
        for bk, (b_base, c, mn, mx, rs) in pending.items():
            b_lo = splits[bk] if bk > 0 else lo
            b_hi = splits[bk + 1] if bk + 1 < len(splits) - 1 else hi
            if c < cnt:
                work.append((b_lo, b_hi, b_base, c, rs))
                continue
            # no progress (approximate bounds collapsed): peel off the range's max value
            below = sub.where(F.col("v") < F.lit(mx)).count()
            low_rs = [r for r in rs if r < b_base + below]
            for r in rs:
                if r >= b_base + below:
                    out[r] = mx
            if low_rs:
                work.append((b_lo, mx, b_base, below, low_rs))
    return out


def _grid(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float],
                    buckets: int = DEFAULT_BUCKETS, max_rows: int = DEFAULT_MAX_ROWS,
                    stats: dict | None = None) -> list[float]:
    """pandas-equal quantiles (linear interpolation) of ``column``; nulls/NaN skipped.

    ``stats``, when given, receives ``rows``: the frame's total row count,
    learned in the same first job.
    """
    for q in qs:
        if not 0.0 <= q <= 1.0:
            raise ValueError("quantiles must be in [0, 1]")
    col = df.select(F.col(column).cast("double").alias("v"))
    # The few refinement jobs re-read one column. Re-reading a file column is
    # cheap; an expensive upstream plan (joins, windows) is cached instead
    # (spills to disk; lost blocks are recomputed from lineage).
    if is_plain_scan(col):
        return _quantiles(col, qs, buckets, max_rows, stats)
    col = persist_adaptive(col)
    try:
        return _quantiles(col, qs, buckets, max_rows, stats)
    finally:
        col.unpersist()


def _quantiles(col: DataFrame, qs: Sequence[float], buckets: int, max_rows: int,
               stats: dict | None) -> list[float]:
    valid = F.col("v").isNotNull() & ~F.isnan("v")
    values = col.where(valid)
    # one pass gives the sizes and the first split bounds
    first = col.agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid).alias("n"),
                    F.percentile_approx(F.when(valid, F.col("v")), _grid(buckets), 10 * buckets)
                    .alias("b")).first()
    if stats is not None:
        stats["rows"] = int(first["rows"])
    n = int(first["n"])
    if n == 0:
        return [math.nan for _ in qs]
    plan = []
    ranks: set[int] = set()
    for q in qs:
        qq = (q * 100) / 100  # pandas passes q*100 to numpy.percentile, which divides by 100
        vi = (n - 1) * qq
        lo = min(max(int(math.floor(vi)), 0), n - 1)
        hi = min(lo + 1, n - 1)
        plan.append((lo, hi, vi - lo))
        ranks.update((lo, hi))
    stats = _order_stats(values, sorted(ranks), n, buckets, max_rows, root_bounds=first["b"])
    return [_lerp(stats[lo], stats[hi], g) for lo, hi, g in plan]
