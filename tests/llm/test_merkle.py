"""Merkle manifest against plain lists, and its layout."""

import random

import numpy as np
import pytest

from txrisk.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _rows(n=700):
    rng = random.Random(4)
    langs = ["en"] * 20 + ["de", "fr", None, "", "Zz", "é"] + [f"l{i}" for i in range(12)]
    return [(i * 3, rng.choice(["a", None, "b:c"]), rng.choice(langs), rng.choice([None, 5, i]), rng.choice([None, "", "Ab Ç", "lower", "X" * 9])) for i in range(n)]


def test_addresses_are_a_permutation_split_at_half_height():
    for rows in range(1, 6):
        all_ = np.concatenate([merkle.address(rows, d, np.arange(8**d)) for d in range(rows)])
        assert sorted(all_.tolist()) == list(range(merkle.tree_size(rows)))
    # five rows: a top of two rows, then 64 bottom trees of three rows, each contiguous
    bottom = [merkle.address(5, d, np.arange(8**d)) for d in range(2, 5)]
    size = merkle.tree_size(3)
    for tree in (0, 7, 63):
        own = np.concatenate([b[tree * 8**i : (tree + 1) * 8**i] for i, b in enumerate(bottom)])
        assert sorted(own.tolist()) == list(range(9 + tree * size, 9 + (tree + 1) * size))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_lists(spark, levels):
    rows = _rows()
    want = merkle.brute_force(rows)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", leaf int, key string").repartition(7)
    leaves = merkle.document_leaves(docs)
    got = merkle.manifest(leaves, levels=levels, with_paths=True).collect()
    assert {r.doc_id: tuple(r)[2:8] for r in got} == want and len(got) == len(rows)
    assert 0 < sum(not v[-1] for v in want.values()) < len(rows)
    for r in got[::50]:  # the stored path folds the leaf to the root
        path = merkle.unpack(r.path)
        assert merkle.fold(r.leaf.encode(), path).decode() == r.root
        assert merkle.node(b"".join(a + b for a, b in path)).decode() == r.proof_sha256


def test_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(merkle.document_leaves(empty)).collect() == []
    one = merkle.manifest(merkle.document_leaves(spark.createDataFrame([(1, None, None, None, None)], SCHEMA))).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].verified
    assert one[0].proof_sha256 == merkle.node(b"").decode()
    # null ids and equal rows are leaves of their own
    rows = [(None, "s", "en", 1, "t")] * 3 + [(5, "s", "en", 1, "t")] * 9
    got = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 12 and len({r.root for r in got}) == 1 and all(r.verified for r in got if r.doc_id is None)


def test_long_text(spark):
    rows = [(1, "s", "en", 1, "Q" * 3_000_000), (2, "s", "en", 1, "")]
    got = {r.doc_id: tuple(r)[2:8] for r in merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), with_paths=False).collect()}
    assert got == merkle.brute_force(rows)
