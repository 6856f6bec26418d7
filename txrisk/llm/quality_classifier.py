"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Method. A labelled document of quality 1 is preferred to one of quality 0. Each pair (preferred,
other) gives the difference of their features, and the weights are those of least logistic loss on
the differences, without an intercept (ridge-penalised, Newton's method). A document's strength is its
weighted feature sum. The threshold is a quantile of the strengths: the share of label 0 among
the labelled rows. Scores are the logistic function of the strength, moved so that the
threshold falls on ``THRESHOLD`` (0.3).

Features come from the text alone (counts and ratios of words, characters, lines and repeats). Learning uses at
most about ``LABELLED_ROWS`` labelled rows, chosen by a hash of doc_id, and ``PAIRS_EACH`` pairs for each of their
label-0 rows; only these ids go to the tasks, only their features come back. Every document is scored in one pass, without a shuffle.

Cases. Null or empty text: scored like any text, from zero counts. Null doc_id: held out. Labels that
contradict each other for one doc_id are averaged (half counts as 1); null labels are ignored. Without
both labels nothing can be learnt and every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .quality_rules import _measure, _row_sums
from .tables import column, read

LABELLED_ROWS = 20_000
PAIRS_EACH = 10
THRESHOLD = 0.3
RIDGE = 1e-3
FOLDS = 5


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0 (null: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".!?")
_SHOUT = _class("!")
_PIPE = _class("|")
_MARK = _class("#*$%&<>=@^~_{}[]\\")
_PLAIN = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PLAIN[128:] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    words = W.tokenize(texts)
    n, chars, symbols, dup_lines, repeats, covered, _ = (c.astype(float) for c in _measure(texts, 10))
    offsets = np.r_[words.row_start, words.row_end[-1:]]
    size = np.maximum(chars, 1)
    some = np.maximum(n, 1)
    count = lambda mask: _row_sums(mask[words.data], offsets)
    lines = _row_sums(words.data == 10, offsets) + 1
    lettered = np.zeros(len(words.start) + 1, np.int64)
    if len(words.start):
        letters = np.r_[0, np.cumsum(_PLAIN[words.data])]
        lettered[1:] = np.cumsum(letters[words.end] > letters[words.start])
    bare = n - (lettered[words.first[1:]] - lettered[words.first[:-1]])
    _, name = np.unique(words.hash ^ W.mix(words.row.astype(np.uint64)), return_index=True)
    kinds = np.bincount(words.row[name], minlength=len(n))
    ratio = [symbols / some, count(_MARK) / some, count(_SHOUT) / some, count(_PIPE) / some, bare / some]
    cols = [*(np.log1p(10 * r) for r in ratio), np.sqrt(count(_UPPER) / size), count(_DIGIT) / size, np.sqrt(dup_lines / lines),
            np.sqrt(repeats / some), np.sqrt(covered / some), kinds / some, np.log1p(n) / 5, np.log1p(some / lines) / 3,
            np.log1p(count(_STOP) / some), np.log1p(size / some), (n < 20).astype(float)]
    return np.stack(cols, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight
        return 1 / (1 + np.exp(-np.clip(strength + self.shift, -50, 50)))


def bradley_terry(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, threshold: float = THRESHOLD) -> Model:
    """Weights from preference pairs between rows of label 1 and rows of label 0."""
    width = x.shape[1] if x.ndim == 2 else 0
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(7)
    lost = np.repeat(bad, pairs_each)
    d = z[rng.choice(good, len(lost))] - z[lost]
    weight = np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ weight, -50, 50)))
        grad = d.T @ (p - 1) / len(d) + ridge * weight
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(curve, grad)
        weight -= step
        if np.abs(step).max() < 1e-8:
            break
    cut = float(np.quantile(z @ weight, len(bad) / len(label), method="midpoint"))
    return Model(mean, scale, weight, math.log(threshold / (1 - threshold)) - cut)


def _with_features(docs: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``docs`` (last column ``__text``) through ``make(features) -> columns``, ``__text`` dropped."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in W.slices(b, "__text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(features(part.column("__text")))], names=names)

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, pairs_each: int = PAIRS_EACH) -> Model:
    """A model from the labelled rows that are not held out."""
    own = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "quality", "double").alias("q"))
    own = own.where(F.col("q").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))
    total = own.count()
    if total > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
    # at most about `most` ids and labels: bounded whatever the size of the tables
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("__text"))
    picked = texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "__text")
    schema = T.StructType([*picked.drop("__text").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = _with_features(picked, schema, lambda x: [pa.array(list(x), pa.list_(pa.float64()))])
    # repeated ids count once, so no more rows come back than ids
    rows = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 16))
    return bradley_terry(x, rows["label"].to_numpy(), pairs_each)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    framed = own.withColumn("__text", column(docs, "text", "string"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    scored = _with_features(framed, schema, lambda x: [pa.array(shipped.value.score(x))])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score, learnt from ``labels`` outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
