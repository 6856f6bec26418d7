"""Quality rules: counts of words, symbols, lines and repeats, and repeated passages by suffix array.

Method. Each text is a sequence of words with a suffix array, sorted by prefix doubling (only
suffixes that are not yet alone are sorted again), and the longest common prefixes of neighbours
read off the levels of that sort. The deepest LCP interval around a suffix is the longest repeat
that starts there; the union of those of at least ``min_words`` words is what the text's maximal
repeats cover. A text is kept when that is at most ``max_covered`` of its words, no repeat is
longer than ``max_repeat`` words, and the base rules hold. Texts never meet: no shuffle at all.

Cases. Null or blank text: all counts 0, fails the base rules (under 50 words). Repeated rows are
judged alike. Other columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import column, read

MIN_WORDS = 10
MAX_COVERED = 0.30
MAX_REPEAT = 200
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def suffix_repeats(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Length of the longest repeat that starts at each position and stays within its row."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    _, rank, size = np.unique(symbols ^ W.mix(row.astype(np.uint64)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[rank]  # suffixes before the group; -1 ends a row
    row_end = np.searchsorted(row, row, side="right")
    levels, k = [rank], 1
    group = np.zeros(n + 1, np.int64)
    np.add.at(group, rank, 1)
    active = np.flatnonzero(group[rank] > 1)
    while len(active):
        after = active + k
        second = np.where(after < row_end[active], rank[np.minimum(after, n - 1)], -1)
        first = rank[active]
        order = np.lexsort((second, first))
        f, s, p = first[order], second[order], active[order]
        new_f = np.r_[True, f[1:] != f[:-1]]
        new = new_f | np.r_[True, s[1:] != s[:-1]]
        at = np.arange(len(p))
        start_f = at[new_f][np.cumsum(new_f) - 1]
        start = at[new][np.cumsum(new) - 1]
        rank = rank.copy()
        rank[p] = f + (start - start_f)
        sizes = np.diff(np.r_[at[new], len(p)])[np.cumsum(new) - 1]
        ended = s < 0  # equal up to the row's end cannot happen twice in one row
        levels.append(rank)
        active = np.sort(p[(sizes > 1) & ~ended])
        k *= 2
    array = np.argsort(rank, kind="stable")
    a, b = array[:-1].copy(), array[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    a_end, b_end = row_end[a], row_end[b]
    same = row[a] == row[b]
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = same & (x < a_end) & (y < b_end)
        ok[ok] = levels[i][x[ok]] == levels[i][y[ok]]
        lcp[ok] += 1 << i
    out = np.zeros(n, np.int64)
    out[array[:-1]] = lcp
    out[array[1:]] = np.maximum(out[array[1:]], lcp)
    return out


def _row_sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _measure(texts: pa.Array, min_words: int) -> list[np.ndarray]:
    words = W.tokenize(texts)
    n, rows = len(words.start), len(words.row_start)
    bounds = words.first
    points = W.code_points(words.data)
    chars = np.r_[0, np.cumsum(points[words.end] - points[words.start])]
    offsets = np.r_[words.row_start, words.row_end[-1:]]
    # lines
    breaks = np.flatnonzero(words.data == 10)
    lo = np.sort(np.concatenate([words.row_start, breaks + 1]), kind="stable")
    hi = np.sort(np.concatenate([words.row_end, breaks]), kind="stable")
    held = np.searchsorted(words.start, hi) > np.searchsorted(words.start, lo)
    lo, hi = lo[held], hi[held]
    line_row = np.searchsorted(offsets, lo, side="right") - 1
    h = W.hash_ranges(words.data, lo, hi) ^ W.mix(line_row.astype(np.uint64))
    _, firsts = np.unique(h, return_index=True)
    dup = np.ones(len(h), bool)
    dup[firsts] = False
    dup_lines = np.bincount(line_row[dup], minlength=rows)
    # words in repeated 3-word windows
    starts = W.within_row(words, 3)
    g = W.grams(words.hash, 3)[starts] ^ W.mix(words.row[starts].astype(np.uint64))
    _, name, size = np.unique(g, return_inverse=True, return_counts=True)
    again = starts[size[name] > 1]
    repeat = W.covered(n, again, again + 3)
    # repeated passages
    reach = suffix_repeats(words.hash, words.row)
    long = np.flatnonzero(reach >= min_words)
    cover = W.covered(n, long, long + reach[long])
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row, reach)
    return [np.diff(bounds), chars[bounds[1:]] - chars[bounds[:-1]], _row_sums(_SYMBOL[words.data], offsets),
            dup_lines, _row_sums(repeat, bounds), _row_sums(cover, bounds), longest]


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED,
                  max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with the counts of the module's docstring, ``base_failed`` and ``kept``."""
    results = {*RESULTS, "base_failed", "kept"}
    own = docs.drop(*[c for c in docs.columns if c.lower() in results])
    framed = own.withColumn("__text", column(docs, "text", "string"))
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.LongType()) for c in RESULTS)])
    names = schema.names

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in W.slices(b, "__text"):
                counts = _measure(part.column("__text"), min_words)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c.astype(np.int64)) for c in counts)], names=names)

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    passes = (F.col("n_covered") <= F.col("n_words") * F.lit(max_covered)) & (F.col("longest_repeat") <= max_repeat)
    return framed.mapInArrow(measure, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its counts and the verdict."""
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "longest_repeat")


#: ``longest_repeat`` is left to the tests; "a repeat over 200 words" is "a 201-word window met twice".
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, text FROM d),
win AS (SELECT doc_id, words, k.k AS k, unnest(range(len(words) - k.k + 1)) AS i FROM w, (VALUES (3), (10), (201)) AS k(k)),
h AS (SELECT doc_id, k, i, md5(array_to_string(words[i + 1 : i + k], ' ')) AS g FROM win),
again AS (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, g) AS n FROM h),
cov AS (SELECT doc_id, k, count(DISTINCT j) AS n FROM (
          SELECT doc_id, k, unnest(range(i, i + k)) AS j FROM again WHERE n > 1) GROUP BY doc_id, k),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS n_covered,
    c201.n IS NOT NULL AS too_long
  FROM w LEFT JOIN dup USING (doc_id)
  LEFT JOIN cov c3 ON c3.doc_id = w.doc_id AND c3.k = 3
  LEFT JOIN cov c10 ON c10.doc_id = w.doc_id AND c10.k = 10
  LEFT JOIN cov c201 ON c201.doc_id = w.doc_id AND c201.k = 201),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_covered::BIGINT AS n_covered,
  base_failed, NOT base_failed AND n_covered <= n_words * 0.3 AND NOT too_long AS kept
FROM f
"""
