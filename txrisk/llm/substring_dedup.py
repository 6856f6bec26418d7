"""Substring dedup: repeated word windows found in prefix-partitioned (sparse) suffix trees.

Method. The texts are word sequences. Of every window of ``window`` words the lowest-hashed run of
``prefix`` words is its anchor, so equal windows have equal anchors at equal places, and a text has
an anchor about every eighth word. Only suffixes that start at anchors are indexed.

1. The anchors' prefixes split the suffixes: those whose prefix is unique are leaves above any deep
   node and go; prefixes with many suffixes are cut into parts of bounded size (:mod:`.repeats`).
2. Each remaining suffix is fetched with the words around its anchor, and the suffixes of some
   prefixes form a generalised suffix tree, built level by level: the nodes at depth 1, 2, 4, 8,
   16, ... are named by pairs of names from the level above. Nodes at depth ``window`` with two
   leaves or more are the repeats; all leaves but the earliest are copies.
3. Of a prefix that was cut, the earliest leaf of each part goes on to a last comparison between
   the parts, one row a part and repeat.
4. The spans of the copies meet their text, and its words in no span are kept.

Nothing grows with the corpus in one task: a tree holds at most ``tree_bytes`` of text, spans are
gathered by text. Lost executors cost the recomputation of their partitions only.

Cases. Null text: no words (n_words 0, kept text empty). Fewer than ``window`` words: kept whole.
Whitespace other than between kept words is lost (kept words are joined by one space). Rows that
share a doc_id are told apart by a checksum of their text; rows equal in both do not remove each
other. A null doc_id comes last in the order. Other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .repeats import repeated
from .tables import read, ready

#: Words of a repeated window.
WINDOW = 20
#: Words of the prefix by which suffixes are split.
PREFIX = 6
#: Suffixes of one prefix that may stand in one tree.
MOST_SUFFIXES = 20_000
#: Bytes of text in one tree.
TREE_BYTES = 1 << 20
_LAST = (1 << 63) - 1


def _anchors(words: W.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor word, its hash, first window, last window."""
    starts = W.within_row(words, window)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none
    g = W.grams(words.hash, prefix)
    span = window - prefix + 1
    place = max(1, int(len(g)).bit_length())
    low = ((g >> np.uint64(place)) << np.uint64(place)) | np.arange(len(g), dtype=np.uint64)
    width, least = 1, low
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[starts] & np.uint64((1 << place) - 1)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]
    at = np.flatnonzero(new)
    return anchor[at], W.signed(g)[anchor[at]], starts[at], starts[np.r_[at[1:], len(starts)] - 1]


def _checksums(part: pa.RecordBatch) -> np.ndarray:
    data, offsets = W.buffer_of(part.column("text"))
    view = memoryview(data)
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, part.num_rows)


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in W.slices(b):
            words = W.tokenize(part.column("text"))
            anchor, key, first, _ = _anchors(words, window, prefix)
            row = words.row[anchor]
            spot = (_checksums(part)[row] << 31) | (first - words.first[row])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, _ids(part)[row], spot)], names=["key", "doc", "spot"])


def _named(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text is the table's column number ``at``, named ``text`` as a last column."""
    named = batch.append_column("text", batch.column(f"c{at}"))
    return W.slices(named)


def _suffix_rows(batches: Iterator[pa.RecordBatch], at: int, window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """One row for each repeated anchor of a text: the words of the windows it stands for."""
    names = ["key", "part", "split", "doc", "spot", "context"]
    for b in batches:
        for part in _named(b, at):
            words = W.tokenize(part.column("text"))
            anchor, key, first, last = _anchors(words, window, prefix)
            row = words.row[anchor]
            sums = _checksums(part)
            spot = (sums[row] << 31) | (first - words.first[row])
            wanted = part.column("anchors")
            of = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            w_spot, w_part, w_split = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            # (row, spot) is unique among the anchors of this slice and ascending by row
            rank_have, rank_want = _pair_keys(row, spot, of, w_spot)
            order = np.argsort(rank_have, kind="stable")
            near = np.searchsorted(rank_have[order], rank_want)
            ok = near < len(order)
            ok[ok] = rank_have[order][near[ok]] == rank_want[ok]
            pick, hit = order[near[ok]], np.flatnonzero(ok)
            context = [words.text(i, j + window) for i, j in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[pick]), pa.array(w_part[hit]), pa.array(w_split[hit].astype(bool)), pa.array(part.column("doc").to_numpy()[row[pick]]),
                 pa.array(spot[pick]), pa.array(context, pa.binary())], names=names)


def _pair_keys(row: np.ndarray, spot: np.ndarray, row2: np.ndarray, spot2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal for equal (row, spot), over both lists."""
    _, code = np.unique(np.concatenate([spot, spot2]), return_inverse=True)
    code = code.astype(np.int64)
    m = int(code.max(initial=0)) + 1
    both = np.concatenate([row, row2]).astype(np.int64) * m + code
    return both[: len(row)], both[len(row):]


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: equal for equal pairs, in the pairs' order."""
    width = int(right.max(initial=0)) + 1
    return np.unique(left.astype(np.int64) * width + right, return_inverse=True)[1].astype(np.int64)


def _tree_leaves(h: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Node at ``depth`` of the suffix tree over the items ``h`` for each suffix in ``starts``."""
    name = np.unique(h, return_inverse=True)[1].astype(np.int64)
    level, reach = name, 1
    while reach * 2 <= depth:
        level = _names(level[:-reach], level[reach:])
        reach *= 2
    rest = depth - reach
    if rest:
        return _names(level[starts], level[starts + rest])
    return level[starts]


def _trees(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by (key, part); hand over whole groups of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        weight += b.column("context").nbytes
        if weight < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, part = (table.column(c).to_numpy() for c in ("key", "part"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        if not len(new):  # one part so far; parts are bounded
            held = table.to_batches()
            continue
        yield from _repeats(table.slice(0, int(new[-1])), window, size)
        held = table.slice(int(new[-1])).to_batches()
        weight = sum(x.column("context").nbytes for x in held)
    if held:
        yield from _repeats(pa.Table.from_batches(held).combine_chunks(), window, size)
    W.give_back()


def _repeats(table: pa.Table, window: int, size: int) -> Iterator[pa.RecordBatch]:
    key, part = (table.column(c).to_numpy() for c in ("key", "part"))
    group = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    _, total = W.buffer_of(table.column("context"))
    at = 0
    while at < len(group):
        lo = int(group[at])
        to = int(np.searchsorted(total[group], total[lo] + size, side="right"))
        to = max(to, at + 1)
        hi = int(group[to]) if to < len(group) else len(table)
        yield _tree(table.slice(lo, hi - lo), window)
        at = to


def _tree(table: pa.Table, window: int) -> pa.RecordBatch:
    """Copies in one generalised suffix tree, as spans of words; of cut prefixes also the earliest leaves.

    Of equal contexts of one part the earliest goes into the tree; all windows of the others are copies.
    """
    key, part, doc, spot, split = (table.column(c).to_numpy() for c in ("key", "part", "doc", "spot", "split"))
    cells = table.column("context").combine_chunks()
    data, offsets = W.buffer_of(cells)
    same = W.hash_ranges(data, offsets[:-1], offsets[1:])
    part_no = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])][: len(key)])
    order = np.lexsort((spot, doc, same, part_no))
    head = np.r_[True, (part_no[order][1:] != part_no[order][:-1]) | (same[order][1:] != same[order][:-1])][: len(order)]
    leader = np.empty(len(order), np.int64)
    leader[order] = order[head][np.cumsum(head) - 1]
    distinct = np.sort(order[head])
    words = W.tokenize(cells.take(pa.array(distinct)))
    windows = np.zeros(len(order), np.int64)
    windows[distinct] = np.diff(words.first) - window + 1
    other = np.flatnonzero((leader != np.arange(len(leader))) & ((doc != doc[leader]) | (spot != spot[leader])))
    mask = (1 << 31) - 1
    whole = [doc[other], spot[other] >> 31, spot[other] & mask, (spot[other] & mask) + windows[leader[other]] - 1 + window]
    key, part, doc, spot, split, group_no = (x[distinct] for x in (key, part, doc, spot, split, part_no))
    starts = W.within_row(words, window)
    row = words.row[starts]
    place = spot[row] + (starts - words.first[row])
    leaf = _tree_leaves(words.hash, starts, window)
    # equal windows share their prefix; parts of one prefix stay apart
    group = group_no[row]
    order = np.lexsort((place, doc[row], leaf, group))
    g, n, d, p = group[order], leaf[order], doc[row][order], place[order]
    head = np.r_[True, (g[1:] != g[:-1]) | (n[1:] != n[:-1])][: len(order)]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    copy = (d != d[first]) | (p != p[first])
    # spans of the copies: consecutive places of one context
    c = np.sort(order[copy])
    cr, cp = row[c], place[c]
    new = np.r_[True, (cr[1:] != cr[:-1]) | (np.diff(cp) != 1)][: len(c)]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(c)] - 1 if len(s) else s
    spans = [doc[cr[s]], cp[s] >> 31, cp[s] & mask, (cp[e] & mask) + window] if len(s) else [np.zeros(0, np.int64)] * 4
    spans = [np.concatenate(x) for x in zip(whole, spans, strict=True)]
    nothing = [np.zeros(len(spans[0]), np.int64)] * 2
    # the earliest leaf of each repeat of a cut prefix
    o = order[head & split[row][order]] if len(order) else order
    if len(o):
        again = W.grams(words.hash, window)[starts[o]]
        other = W.grams(W.mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)), window)[starts[o]]
        more = [doc[row[o]], place[o] >> 31, place[o] & mask, (place[o] & mask) + window, W.signed(again), W.signed(other)]
        cols = [np.concatenate(x) for x in zip([*spans, *nothing], more, strict=True)]
        open_ = np.r_[np.zeros(len(spans[0]), bool), np.ones(len(o), bool)]
    else:
        cols, open_ = [*spans, *nothing], np.zeros(len(spans[0]), bool)
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(open_)],
                                      names=["doc", "sum", "lo", "hi", "node", "node2", "open"])


def _between_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, node2, doc, sum, lo): definite copies pass, of open ones all but the first of a node."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "sum", "lo", "hi", "node", "node2", "open")}
        key = np.stack([c["node"], c["node2"]])
        head = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
        spot = np.stack([c["doc"], c["sum"], c["lo"]])
        if last is not None and (key[:, 0] == last[0]).all():
            head[0] = False
        group = np.cumsum(head) - (1 if head[0] else 0)
        firsts = spot[:, head]
        if not head[0]:
            firsts = np.concatenate([last[1][:, None], firsts], axis=1)
        keep = ~c["open"] | (spot != firsts[:, group]).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c[n][keep]) for n in ("doc", "sum", "lo", "hi")], names=["doc", "sum", "lo", "hi"])
        last = (key[:, -1], firsts[:, -1])


def _cut(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Apply the spans: words, words removed, and the kept words joined by one space."""
    for b in batches:
        for part in _named(b, at):
            n = part.num_rows
            texts, spans = part.column("text"), part.column("spans")
            total, removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            bounds = spans.offsets.to_numpy()
            flat = spans.flatten()
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            valid = spans.is_valid().to_numpy(zero_copy_only=False)
            lows = bounds - bounds[0] if n else bounds
            for i in range(n):
                own = (texts[i].as_py() or "").encode().split()
                total[i] = len(own)
                a, z = int(lows[i]), int(lows[i + 1])
                if valid[i] and z > a:
                    gone = W.covered(len(own), lo[a:z], hi[a:z])
                    removed[i] = int(gone.sum())
                    own = [own[j] for j in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(own))
            out = [part.column(f"c{j}") for j in range(len(names) - 3)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(total), pa.array(removed), pa.array([k.decode() for k in kept], pa.string())], names=names)


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                    most_suffixes: int = MOST_SUFFIXES, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``n_words``, ``n_removed`` and ``kept_text``.

    A word is removed when a window of ``window`` words of its document that covers it also starts
    earlier: in a row with a smaller doc_id, or earlier in the same one. The module's docstring has
    the other cases.
    """
    if not 1 <= prefix <= window:
        raise ValueError("prefix must be from 1 to window")
    ready(docs.sparkSession)
    results = {"n_words", "n_removed", "kept_text"}
    own = docs.drop(*[c for c in docs.columns if c.lower() in results])
    names = own.columns
    # numbered names inside, so that no column of the table clashes with a working one
    placed = own.toDF(*[f"c{i}" for i in range(len(names))])
    cells = {n.lower(): f"c{i}" for i, n in enumerate(names)}
    for name in ("doc_id", "text"):
        if name not in cells:
            raise ValueError(f"the table has no column {name}")
    doc, text = F.col(cells["doc_id"]), F.col(cells["text"])
    anchors = placed.select(doc.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        lambda b: _anchor_rows(b, window, prefix), "key long, doc long, spot long")
    again = repeated(anchors, "key", ["doc", "spot"], most_suffixes)
    # sets: rows equal in id and text have the same anchors and spans, which must not be listed once for each of them
    by_doc = again.groupBy("doc", F.shiftright("spot", 31).alias("sum")).agg(
        F.collect_set(F.struct("spot", "part", "split")).alias("anchors"))
    # both uses of the texts take all columns, so that Spark shares one exchange between them
    placed = placed.withColumns({"doc": F.coalesce(doc.cast("long"), F.lit(_LAST)), "sum": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    at = int(cells["text"][1:])
    suffixes = placed.join(by_doc, ["doc", "sum"], "left").where("anchors is not null").mapInArrow(
        lambda b: _suffix_rows(b, at, window, prefix), "key long, part long, split boolean, doc long, spot long, context binary")
    trees = suffixes.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part").mapInArrow(
        lambda b: _trees(b, window, tree_bytes), "doc long, sum long, lo long, hi long, node long, node2 long, open boolean")
    order = F.when(F.col("open"), F.col("node")).otherwise(F.xxhash64("doc", "sum"))
    copies = trees.repartition(order).sortWithinPartitions("open", "node", "node2", "doc", "sum", "lo").mapInArrow(
        _between_parts, "doc long, sum long, lo long, hi long")
    spans = copies.groupBy("doc", "sum").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = placed.join(spans, ["doc", "sum"], "left")
    kept = own.toDF(*[f"c{i}" for i in range(len(names))]).schema.fields
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(lambda b: _cut(b, at, schema.names), schema).toDF(*names, "n_words", "n_removed", "kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its words, the removed ones and a digest of the kept ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same result by a dictionary of all windows (for tests)."""
    texts = sorted((d, (t or "").encode().split()) for d, t in rows)
    seen: dict[tuple, tuple] = {}
    out = []
    for d, w in texts:
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), (d, i))
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words) - 19)) AS i, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(words[i + 1 : i + 20], ' ')) AS g FROM w),
copies AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM copies)),
per AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
flat AS (SELECT d.doc_id, unnest(words) AS word, unnest(range(len(words))) AS j FROM d JOIN per USING (doc_id)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM flat ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(per.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN per.n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(left_.kept, '') END) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
