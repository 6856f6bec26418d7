"""Suffix-array dedup against a dictionary of all strings: batches, levels, cut anchors, long texts, nulls, repeats."""

import hashlib
import random

import numpy as np
import pytest

from txrisk.llm import suffix_array_dedup as sad

DOCS = "doc_id long, text string"


def _text(rng, n):
    return "".join(rng.choice("abcdefg é\n") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    passages = [_text(rng, n) for n in (99, 100, 130, 400)]
    rows = []
    for i in range(80):
        t = _text(rng, rng.choice([0, 1, 98, 99, 100, 101, 300, 900]))
        if i % 3 == 0:
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice(passages) + t[cut:]
        rows.append((i * 2, t))
    base = _text(rng, 700)
    for i in range(200, 230):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    rows += [(300, "ab" * 400), (301, "a" * 5000), (302, "ab" * 300), (303, ""), (304, None), (305, "é" * 300)]
    rows += [(400 + i, passages[2] + _text(rng, 60)) for i in range(40)]  # one string, many contexts
    return rows


def _got(out):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 6}, {"batches": 2, "most": 3, "size": 500}, {"prefix": 99}])
def test_against_all_strings(spark, corpus, how):
    docs = spark.createDataFrame(corpus, DOCS).repartition(5)
    assert _got(sad.suffix_array_dedup(docs, **how)) == sorted(sad.brute_force(corpus))


def test_short_strings(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert _got(sad.suffix_array_dedup(docs, length=12, prefix=3, batches=4)) == sorted(sad.brute_force(rows, 12))


def test_texts_in_pieces(spark, corpus, monkeypatch):
    """A text indexed in pieces gives what it gives whole."""
    rng = random.Random(1)
    long = _text(rng, 9000)
    rows = [(1, long), (2, long[500:7000] + "x" + long[7000:]), (3, "a" * 6000)]
    monkeypatch.setattr(sad, "SEGMENT_BYTES", 1000)
    got = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([long])], names=["doc", "text"])
    pieces = pa.Table.from_batches(sad._suffix_rows(iter([batch]), 100, 24))
    monkeypatch.setattr(sad, "SEGMENT_BYTES", 1 << 20)
    whole = pa.Table.from_batches(sad._suffix_rows(iter([batch]), 100, 24))
    covered = lambda t: sorted(p for s, n in zip(t["spot"].to_pylist(), t["n"].to_pylist()) for p in range(s & sad._POS, (s & sad._POS) + n))
    assert covered(pieces) == covered(whole) == list(range(len(long.encode()) - 99))
    assert set(whole["gram"].to_pylist()) == set(pieces["gram"].to_pylist())
    got = _got(sad.suffix_array_dedup(spark.createDataFrame(rows, DOCS)))
    assert got == sorted(sad.brute_force(rows))


def test_very_long_text(spark):
    rng = random.Random(6)
    part = _text(rng, 40_000)
    rows = [(1, part * 70), (2, part[:200] + "~" * 3_000_000)]
    got = {r[0]: r[1:4] for r in _got(sad.suffix_array_dedup(spark.createDataFrame(rows, DOCS)))}
    size = len(part.encode())
    assert got[1] == (70 * size, 69 * size, 1)
    assert got[2][1] >= 2_999_999 and got[2][2] <= 2


def test_rows(spark):
    """Repeated rows leave each other alone and cost no square; null ids come last; names may clash."""
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    rows = [(1, text, "a")] * 2 + [(None, text, "b"), (2, text + " end", None), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gram string").withColumnRenamed("gram", "spans").withColumnRenamed("doc_id", "DOC_ID")
    got = sorted(((r.DOC_ID, r.spans, r.n_removed) for r in sad.suffix_array_dedup(docs).collect()), key=str)
    n = len(text)
    assert got == sorted([(1, "a", 0), (1, "a", 0), (None, "b", n), (2, None, n), (None, "c", 0)], key=str)
    assert sad.suffix_array_dedup(docs.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("cast(null as long) doc_id", f"'{text}' text")
    assert sad.suffix_array_dedup(many).agg({"n_removed": "sum"}).first()[0] == 0


def test_levels_double(spark, corpus):
    """Levels merge like a binary counter, and hold each context once."""
    family = sad.IndexFamily()
    sizes = []
    rows = [(d, t or "") for d, t in corpus]
    for i in range(7):
        family.add(spark.createDataFrame(rows[i::7], "doc long, text string"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    every = [r for _, level in family.levels for r in level.select("gram", "context").collect()]
    assert len(every) <= 1.2 * len(set(every))


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    for length in (1, 3, 8, 20, 100):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        starts = np.arange(len(data) - length + 1)
        order, same = sad.suffix_array(data, starts, length)
        words = [data[i : i + length].tobytes() for i in order]
        assert words == sorted(words) and same.tolist() == [False] + [a == b for a, b in zip(words, words[1:])]
