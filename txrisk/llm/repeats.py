"""Rows whose 64-bit key occurs more than once, cut into groups of bounded size.

Keys are dealt out by range, with ``(key, tie)`` as the sort order, so one key with a third of
all rows is spread over many tasks. Each task walks its sorted rows once and holds one Arrow
batch and one unfinished group. A key met at the edge of a task, or longer than ``most`` rows,
may go on elsewhere: its groups are marked ``split`` and later steps join them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, key: str, tie: list[str], most: int) -> DataFrame:
    """Rows of ``df`` (all columns long) whose ``key`` may occur again, with ``part`` and ``split``.

    Added columns: ``part`` (long; rows of one key and one ``part`` are at most ``most`` and belong
    together) and ``split`` (boolean; the key may have rows in other parts). A key that lies within
    one task and occurs once there is left out; it is nowhere else.
    """
    cols = df.columns
    schema = df.withColumns({"part": F.lit(0).cast("long"), "split": F.lit(False)}).schema
    ordered = df.repartitionByRange(key, *tie).sortWithinPartitions(key, *tie)
    return ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(
        lambda batches: _walk(batches, cols, key, most), schema)


def _walk(batches: Iterator[pa.RecordBatch], cols: list[str], key: str, most: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None  # the unfinished last key
    at, part, first, cut = cols.index(key), 0, True, False

    def out(rows: list[np.ndarray], parts: np.ndarray, split: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c) for c in rows] + [pa.array(parts), pa.array(split)]
        return pa.RecordBatch.from_arrays(arrays, names=[*cols, "part", "split"])

    for b in batches:
        if not b.num_rows:
            continue
        task = b.column(len(cols))[0].as_py()
        rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        k = rows[at]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        # finished groups: all but the last
        done = len(starts) - 1
        if done:
            size = ends[:done] - starts[:done]
            edge = np.zeros(done, bool)
            edge[0] = first or cut
            take = (size > 1) | edge
            mask = np.zeros(len(k), bool)
            mask[: ends[done - 1]] = np.repeat(take, size)
            if mask.any():
                split = np.repeat(edge, size)[mask[: ends[done - 1]]]
                # a group already cut goes on in a part of its own
                parts = np.full(int(mask.sum()), task << 24, np.int64)
                parts[: int(size[0]) if take[0] else 0] += part
                yield out([c[mask] for c in rows], parts, split)
            part, first, cut = 0, False, False
        held = [c[starts[done]:] for c in rows]
        while len(held[at]) > most:  # a long group is cut
            head, held = [c[:most] for c in held], [c[most:] for c in held]
            yield out(head, np.full(most, (task << 24) + part, np.int64), np.ones(most, bool))
            part, cut = part + 1, True
    if held is not None and len(held[at]):
        n = len(held[at])
        yield out(held, np.full(n, (task << 24) + part, np.int64), np.ones(n, bool))
