"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Method. Texts are compared as lower-case words of letters and digits (ASCII punctuation separates).
The seeds of a benchmark item are its ``n``-grams. A first pass over all documents counts in how many
each seed stands; a seed is rare unless it stands in ``RARE_FACTOR`` times as many as three quarters
of its own item's seeds do (a passage that was copied often stays rare in this sense, a run of
function words does not). A second pass joins the documents' n-grams to the rare seeds; where
``min_seeds`` of one item meet, the item is aligned with the words around them, and the score is
that of the best local alignment as a share of a full match. This finds copies with words
replaced, dropped or added. Hits score at least ``threshold``.

The documents are never shuffled: seeds and items go to the tasks. The benchmark is taken in blocks of
at most about ``BLOCK_CHARS`` characters, one after another, so what is shipped is bounded however
large it is. Counts come back one number a seed of the block.

Cases. Null or blank document: no hits. Null or blank item: hits nothing. An item of fewer than ``n``
words is its own seed. Repeated items hit separately; repeated documents alike. Other columns
of the documents pass through. An empty benchmark or table: no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import column, read

N = 3
MIN_SEEDS = 2
THRESHOLD = 0.5
RARE_FACTOR = 8
#: A seed in at most this share of the documents, or in this many, is rare in any case.
RARE_SHARE, RARE_LEAST = 0.0005, 20
BLOCK_CHARS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _lo, _hi in ((48, 58), (97, 123)):
    _PLAIN[_lo:_hi] = np.arange(_lo, _hi)
_PLAIN[65:91] = np.arange(97, 123)


def _plain(texts: pa.Array) -> pa.Array:
    data, offsets = W.buffer_of(texts)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[data])])


class Seeds:
    """Items of one block: their words, and their seeds in hash order."""

    def __init__(self, texts: list[str | None], n: int):
        words = W.tokenize(_plain(pa.array(texts, pa.string())))
        self.n = n
        self.items = [words.hash[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
        seed, item, offset = [], [], []
        for i, w in enumerate(self.items):
            g = W.grams(w, min(n, len(w))) if len(w) else w
            # a short item is looked for by its single words
            g = g if len(w) >= n else w
            seed.append(g)
            item.append(np.full(len(g), i))
            offset.append(np.arange(len(g)))
        seed, item, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seed, item, offset))
        short = np.array([len(w) < n for w in self.items], bool)[item] if len(item) else np.zeros(0, bool)
        self.sets = [self._set(seed, item, offset, ~short, n), self._set(seed, item, offset, short, 1)]

    @staticmethod
    def _set(seed, item, offset, pick, n):
        order = np.argsort(seed[pick], kind="stable")
        seed, item, offset = seed[pick][order], item[pick][order], offset[pick][order]
        keys, start = np.unique(seed, return_index=True)
        table = np.zeros(1 << 16, bool)
        table[(keys >> np.uint64(48)).astype(np.int64)] = True
        return {"n": n, "keys": keys, "start": np.r_[start, len(seed)], "item": item, "offset": offset, "table": table, "rare": np.ones(len(keys), bool)}

    def find(self, words: W.Words, s: dict) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the texts and the seed there, for one set."""
        none = np.zeros(0, np.int64)
        if not len(s["keys"]):
            return none, none
        starts = W.within_row(words, s["n"])
        g = W.grams(words.hash, s["n"])[starts] if s["n"] > 1 else words.hash[starts]
        maybe = np.flatnonzero(s["table"][(g >> np.uint64(48)).astype(np.int64)])
        near = np.searchsorted(s["keys"], g[maybe])
        near[near == len(s["keys"])] = 0
        hit = s["keys"][near] == g[maybe]
        return starts[maybe[hit]], near[hit]


def align(item: np.ndarray, window: np.ndarray) -> int:
    """Best local alignment score of two word sequences (linear gaps)."""
    slope = GAP * np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best = 0
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(window == w, MATCH, MISMATCH), 0, out=new[1:])
        np.maximum(new, row + GAP, out=new)
        row = np.maximum.accumulate(new - slope) + slope
        best = max(best, int(row.max()))
    return best


def _hits(words: W.Words, seeds: Seeds, min_seeds: int, threshold: float) -> list[list[tuple[int, float, int, int]]]:
    """For each row: (item, score, first word, last word + 1) of the passages that match."""
    out: list[list] = [[] for _ in words.row_start]
    for s in seeds.sets:
        at, seed = seeds.find(words, s)
        pick = s["rare"][seed]
        at, seed = at[pick], seed[pick]
        if not len(at):
            continue
        count = s["start"][seed + 1] - s["start"][seed]
        total = np.cumsum(count)
        spread = np.arange(int(total[-1])) + np.repeat(s["start"][seed] - (total - count), count)
        pos, item, offset = np.repeat(at, count), s["item"][spread], s["offset"][spread]
        row = words.row[pos]
        order = np.lexsort((pos, item, row))
        pos, item, offset, row = pos[order], item[order], offset[order], row[order]
        length = np.array([len(w) for w in seeds.items])[item]
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(pos) > 2 * length[1:])]
        heads = np.flatnonzero(new)
        for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(pos)], strict=True):
            k, n_seeds = int(item[a]), len(seeds.items[item[a]]) - s["n"] + 1
            if len(np.unique(offset[a:z])) < min(min_seeds, n_seeds):
                continue
            r, size = int(row[a]), int(length[a])
            slack = size // 4 + 4
            lo = max(int(words.first[r]), int((pos[a:z] - offset[a:z]).min()) - slack)
            hi = min(int(words.first[r + 1]), int((pos[a:z] - offset[a:z]).max()) + size + slack)
            score = align(seeds.items[k], words.hash[lo:hi]) / (MATCH * size)
            if score >= threshold:
                out[r].append((k, score, lo - int(words.first[r]), hi - int(words.first[r])))
    return out


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
                                 T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))


def _count_seeds(docs: DataFrame, seeds: Seeds, n_docs: int) -> None:
    """Mark each seed rare or not by the number of documents that have it."""
    shipped = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        totals = [np.zeros(len(s["keys"]), np.int64) for s in own.sets]
        for b in batches:
            for part in W.slices(b, "__text"):
                words = W.tokenize(_plain(part.column("__text")))
                for s, total in zip(own.sets, totals, strict=True):
                    at, seed = own.find(words, s)
                    pairs = np.unique(words.row[at].astype(np.int64) * max(1, len(total)) + seed)
                    np.add.at(total, pairs % max(1, len(total)), 1)
        for i, total in enumerate(totals):
            got = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), i)), pa.array(got), pa.array(total[got])], names=["i", "seed", "c"])

    counts = docs.select("__text").mapInArrow(run, "i long, seed long, c long").groupBy("i", "seed").agg(F.sum("c").alias("c")).toPandas()
    least = max(RARE_LEAST, math.ceil(RARE_SHARE * n_docs))
    for i, s in enumerate(seeds.sets):
        df = np.zeros(len(s["keys"]), np.int64)
        own = counts[counts["i"] == i]
        df[own["seed"].to_numpy()] = own["c"].to_numpy()
        key_of = np.repeat(np.arange(len(s["keys"])), np.diff(s["start"]))
        rare = np.zeros(len(s["keys"]), bool)
        order = np.argsort(s["item"], kind="stable")
        cuts = np.flatnonzero(np.diff(s["item"][order])) + 1
        for keys in np.split(key_of[order], cuts) if len(order) else ():
            rare[keys[df[keys] <= max(least, RARE_FACTOR * np.quantile(df[keys], 0.75))]] = True
        s["rare"] = rare
    shipped.unpersist()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, min_seeds: int = MIN_SEEDS, threshold: float = THRESHOLD,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``hits``: the benchmark items found in each text, with score and place."""
    own = docs.drop(*[c for c in docs.columns if c.lower() == "hits"])
    out = own.withColumn("hits", F.lit(None).cast(HITS))
    text = column(own, "text", "string")
    framed = own.select(text.alias("__text"))
    items = benchmark.select(column(benchmark, "item_id", "long").alias("item_id"), column(benchmark, "text", "string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / block_chars)
    n_docs = own.count() if blocks else 0
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toPandas()
        seeds = Seeds(block["text"].tolist(), n)
        _count_seeds(framed, seeds, n_docs)
        out = _add_hits(out, text, seeds, block["item_id"].tolist(), min_seeds, threshold)
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))


def _add_hits(docs: DataFrame, text, seeds: Seeds, item_ids: list, min_seeds: int, threshold: float) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((seeds, item_ids))
    framed = docs.withColumn("__text", text)
    names = docs.columns
    at = names.index("hits")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = shipped.value
        for b in batches:
            for part in W.slices(b, "__text"):
                found = _hits(W.tokenize(_plain(part.column("__text"))), own, min_seeds, threshold)
                cols = part.columns[:-1]
                if any(found):
                    said = [None if i is None or i != i else int(i) for i in ids]
                    cells = [(old or []) + [(said[k], score, lo, hi) for k, score, lo, hi in new]
                             for old, new in zip(part.column(at).to_pylist(), found, strict=True)]
                    cols[at] = pa.array([[tuple(h.values()) if isinstance(h, dict) else h for h in c] for c in cells], kind)
                else:
                    cols[at] = cols[at].cast(kind)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return framed.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    return benchmark_hits(docs, benchmark, **how).where(F.size("hits") == 0).drop("hits")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``: one row for each such pair."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, read(spark, sf_dir, "benchmark"))
    hit = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.score")
    return hit.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
