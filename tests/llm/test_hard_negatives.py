"""Hard negatives against plain loops: clusters, ties, unequal lengths, huge values, nulls, repeats, blocks."""

import random

import numpy as np

from txrisk.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>"


def _key(row):
    return tuple((x is None, x or 0) for x in row)


def _rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        near, size = rng.choice([0.001, 0.05, 0.5]), rng.choice([1.0, 1.0, 1.0, 3.0])
        vector = [size * (x + rng.gauss(0, near)) for x in centres[rng.randrange(5)]][: rng.choice([6, 6, 6, 5])]
        rows.append((i if rng.random() < 0.98 else None, rng.choice([1, 2, 2, 2, None]), vector))
    rows += [(300, 1, rows[0][2])] * 4 + [(None, 2, rows[0][2])] * 3
    rows += [(3000, 2, []), (3001, 1, [0.0] * 6), (3100, 2, [1e200, 0.0]), (3101, 2, [1e100, -1e100]), (3200, 1, [1e8] * 6)]
    rows += [(3003, 1, None), (3004, 1, [1.0, None]), (3005, 1, [float("nan")]), (3006, 2, [float("inf")])]
    rows += [(4000 + i, 2, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(50)] + [(5000 + i, 1, [1.0, 0.9, 0.0, 0.0, 0.0, 0.0]) for i in range(50)]
    return rows


def test_against_loops(spark):
    rows = _rows()
    want = sorted(hn.brute_force(rows), key=_key)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, anchor int").repartition(5)
    for size in (hn.BLOCK_BYTES, 1000):  # also in many blocks of anchors
        got = sorted((tuple(r) for r in hn.hard_negatives(frame, block_bytes=size).collect()), key=_key)
        assert got == want


def test_no_rows_and_no_references(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty).collect() == []
    zero = [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0]), (None, 1, [0.0])]
    got = sorted(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(zero, SCHEMA)).where("positive_id is not null").collect())
    assert got == [(0, 1, 1, 2, 0, 0)]
    assert hn.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], SCHEMA)).collect() == []


def test_windows_never_lose_a_row_and_prune():
    """Rows outside an anchor's window have scores outside its range; on rows in clusters most are left out."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 300
    x = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 8)) * 8)
    references = hn.choose_references(x[:500], 8)
    rows = hn.Rows(np.arange(4000), np.zeros(4000, int), x, hn.angles(x, references))
    a = x[:60]
    exact = hn.scores(a, x)
    top = np.sort(exact, axis=1)[:, ::-1]
    low, high = top[:, 200].astype(float), top[:, 50].astype(float)
    which, start, end = hn.windows(hn._norms(a), hn.angles(a, references), low, high, rows)
    for i in range(60):
        inside = np.zeros(4000, bool)
        inside[rows.order[start[i] : end[i], which[i]]] = True
        assert not ((exact[i] >= low[i]) & (exact[i] <= high[i]) & ~inside).any()
    assert (end - start).mean() < 2000


def test_scores_are_exact():
    a = np.array([[2.0**40, 3.0, -1.0], [1e30, 0.0, 0.0]])
    x = np.array([[2.0**30 + 1, 1.0, 2.0], [-1e30, 5.0, 5.0]])
    want = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(r, s)))) for s in x.tolist()] for r in a.tolist()]
    assert hn.scores(a, x).tolist() == want
