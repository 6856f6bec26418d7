"""Suffix-array dedup: a logarithmic family of sparse suffix arrays over bytes.

Method. Documents come in batches. A batch gets a suffix array: its suffixes in order, over the whole cluster by ranges.
It is merge-scanned against the arrays of all existing levels, which finds the long matches; then levels of equal size
are merged into one of twice the size, as in a binary counter, so that ``b`` batches have at most ``log2 b`` levels.

1. Only suffixes at anchors are indexed: of every string of ``length`` bytes the least-hashed run of ``prefix`` bytes is its
   anchor, so that equal strings have equal anchors at equal places. Suffixes are ordered by the anchor (``gram``) and
   then by the bytes that the strings with this anchor cover, the context (``context``); both by their 64-bit hashes.
2. One scan over the sorted suffixes of batch and levels: of equal contexts all but the earliest are copies whole, and
   only the earliest goes on into a level. Contexts with equal anchors that differ are matched in part: they are noted.
3. The noted contexts are fetched from the texts. Those of some anchors form a text of bounded size, whose suffix array is
   built by prefix doubling; an interval of suffixes with a common prefix of ``length`` is a repeated string, and all
   its places but the earliest are copies. Anchors with over ``MOST_CONTEXTS`` contexts are dealt to parts, and their
   strings are then compared between the parts by a 128-bit hash in an aggregation.
4. The copies' spans meet their text, whose bytes in no span are kept.

Nothing grows with the corpus in one task: scans hold a batch of rows, texts of step 3 are bounded, spans are gathered by text,
texts over ``SEGMENT_BYTES`` are indexed in pieces. An anchor or context that a third of all rows share is dealt over
many tasks by ranges. Lost executors cost the recomputation of their tasks; levels are written to the shared folder.

Cases. Null text: no bytes. Texts shorter than ``length`` are kept whole. A null doc_id comes after all others, and null ids in
the order of a hash of their texts. Rows that share a doc_id are told apart by a checksum of their text, and ordered by
it; rows equal in both do not remove each other. Kept bytes may end within a character, so they are binary. Other
columns pass through unchanged, also under the names used here. An empty table has no rows.
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
from .tables import column, keep, read, ready

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of an anchor.
PREFIX = 24
#: Batches that a table is cut into by doc_id.
BATCHES = 3
#: Contexts of one anchor that may stand in one text of step 3, and bytes of such a text.
MOST_CONTEXTS = 20_000
TEXT_BYTES = 1 << 20
#: Bytes of a text indexed at once.
SEGMENT_BYTES = 1 << 20
_PLACE = 24
_POS = (1 << 31) - 1
_BASE = 0xD6E8FEB86659FD93 | 1


class _Hash:
    """64-bit hashes of any range of some bytes, after one pass over them."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = W._powers(_BASE, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(W._BYTE[data] * self.power[: len(data)], out=self.total[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def runs(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes from each place."""
        count = max(0, len(self.total) - n)
        return W.mix((self.total[n:] - self.total[:count]) * self.inverse[:count])


def _starts(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from which ``length`` bytes lie in one range, and their range."""
    count = np.maximum(hi - lo - length + 1, 0)
    of = np.repeat(np.arange(len(lo)), count)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[of], of


def anchors(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: range, first string's place, number of strings, hashes of anchor and context.

    ``data`` has fewer than 2^24 bytes. The choice of an anchor depends on the string's bytes only.
    """
    starts, of = _starts(lo, hi, length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    hashed = _Hash(data)
    gram = hashed.runs(prefix)
    place = np.uint64(_PLACE)
    least = ((gram >> place) << place) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, length - prefix + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1) | (of[1:] != of[:-1])])
    count = np.diff(np.r_[head, len(starts)])
    first = starts[head]
    context = hashed.ranges(first, first + count - 1 + length)
    return of[head], first, count, W.signed(gram[anchor[head]]), W.signed(context)


def _pieces(part: pa.RecordBatch, name: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, ranges, row of each range and its offset in the text: all rows at once, or pieces of a long text.

    Pieces overlap so that every string of ``length`` bytes lies in one of them.
    """
    data, offsets = W.buffer_of(part.column(name))
    if part.num_rows > 1 or len(data) <= 2 * SEGMENT_BYTES:
        rows = np.arange(part.num_rows)
        yield data, offsets[:-1], offsets[1:], rows, np.zeros(part.num_rows, np.int64)
        return
    for at in range(0, len(data), SEGMENT_BYTES):
        piece = data[at : at + SEGMENT_BYTES + length - 1]
        yield piece, np.zeros(1, np.int64), np.array([len(piece)]), np.zeros(1, np.int64), np.array([at])


def _checksums(part: pa.RecordBatch, name: str) -> np.ndarray:
    data, offsets = W.buffer_of(part.column(name))
    view = memoryview(data)
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, part.num_rows)


def _suffix_rows(batches: Iterator[pa.RecordBatch], length: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batch's suffix array, not yet in order."""
    for b in batches:
        for part in W.slices(b):
            doc, sums = part.column("doc").to_numpy(), _checksums(part, "text")
            for data, lo, hi, rows, offset in _pieces(part, "text", length):
                of, first, count, gram, context = anchors(data, lo, hi, length, prefix)
                row = rows[of]
                spot = (sums[row] << 31) | (first - lo[of] + offset[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(context), pa.array(np.full(len(of), 2, np.int8)), pa.array(doc[row]), pa.array(spot), pa.array(count.astype(np.int32))],
                    names=["gram", "context", "tag", "doc", "spot", "n"])


_SUFFIX = "gram long, context long, tag byte, doc long, spot long, n int"
_SCANNED = _SUFFIX + ", copy boolean, noted boolean"


def _scan(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Merge-scan of suffixes sorted by (gram, context, tag, doc, spot); tag 0 and 1: of levels, 2: of the batch.

    Passes on the earliest suffix of each context and the batch's copies. ``noted`` marks contexts that share their gram with
    others, also where the gram lies at an edge of the task and may go on elsewhere. Levels that stay
    as they are (tag 0) pass on noted suffixes only, and so do all for the ``last`` batch.
    """
    names = ["gram", "context", "tag", "doc", "spot", "n"]
    before: dict[str, int] | None = None  # the last row
    pending: list[np.ndarray] | None = None  # the only context so far of the unfinished gram
    contexts, edge = 0, True  # contexts so far of that gram; whether it is the task's first

    def out(c: list[np.ndarray], copy: np.ndarray, noted: np.ndarray) -> pa.RecordBatch:
        take = copy | noted | (c[2] > (2 if last else 0))
        c = [x[take] for x in c]
        copy, noted = copy[take], noted[take]
        c[0], c[1] = np.where(copy, 0, c[0]), np.where(copy, 0, c[1])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in c), pa.array(copy), pa.array(noted)], names=[*names, "copy", "noted"])

    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(x).to_numpy() for x in names]
        gram, context, tag, doc, spot, _ = c
        new_gram = np.r_[before is None or gram[0] != before["gram"], gram[1:] != gram[:-1]]
        new = new_gram | np.r_[before is None or context[0] != before["context"], context[1:] != context[:-1]]
        again = np.r_[before is not None and doc[0] == before["doc"] and spot[0] == before["spot"], (doc[1:] == doc[:-1]) & (spot[1:] == spot[:-1])]
        copy = ~new & ~again & (tag == 2)
        group = np.cumsum(new_gram) - (1 if new_gram[0] else 0)
        size = np.bincount(group, weights=new).astype(np.int64)
        fresh = np.bincount(group, weights=tag == 2) > 0
        goes_on = not new_gram[0]
        if goes_on:
            size[0] += contexts
            fresh[0] = True
        elif pending is not None:  # that gram has ended
            yield out(pending, np.zeros(1, bool), np.full(1, edge))
            pending = None
        at_edge = np.zeros(len(size), bool)
        at_edge[0] = edge if goes_on or before is None else False
        fresh[-1] = True  # may go on with rows of the batch
        noted = ((size > 1) & fresh) | at_edge
        if goes_on and pending is not None and (noted[0] or len(size) > 1):
            yield out(pending, np.zeros(1, bool), np.full(1, bool(noted[0])))
            pending = None
        own = new & noted[group]
        lead = new.copy()
        if size[-1] == 1 and not at_edge[-1] and new[group == len(size) - 1].any():  # its only context waits
            i = int(np.flatnonzero(new & (group == len(size) - 1))[0])
            pending, lead[i] = [x[i : i + 1] for x in c], False
        take = lead | copy
        yield out([x[take] for x in c], copy[take], (own & lead)[take])
        contexts, edge = int(size[-1]), bool(at_edge[-1])
        before = {"gram": gram[-1], "context": context[-1], "doc": doc[-1], "spot": spot[-1]}
    if pending is not None:
        yield out(pending, np.zeros(1, bool), np.ones(1, bool))


class IndexFamily:
    """Levels of sparse suffix arrays. ``levels`` has (batches covered, table), the largest first."""

    def __init__(self, length: int = LENGTH, prefix: int = PREFIX):
        if not 1 <= prefix < length:
            raise ValueError("prefix must be from 1 to length - 1")
        self.length, self.prefix = length, prefix
        self.levels: list[tuple[int, DataFrame]] = []
        self.scans: list[DataFrame] = []

    def add(self, texts: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch (``doc`` long, ``text``), all of whose documents come after those before; returns its scan.

        After the ``last`` batch no level is written.
        """
        length, prefix = self.length, self.prefix
        own = texts.select("doc", "text").mapInArrow(lambda b: _suffix_rows(b, length, prefix), _SUFFIX)
        size, merged = 1, 0
        while merged < len(self.levels) and self.levels[-1 - merged][0] == size:
            size, merged = size * 2, merged + 1
        stay = len(self.levels) - merged
        for i, (_, level) in enumerate(self.levels):
            own = own.unionByName(level.withColumn("tag", F.lit(0 if i < stay or last else 1).cast("byte")))
        order = ["gram", "context", "tag", "doc", "spot"]
        made = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _scan(b, last), _SCANNED)
        scan = keep(made, "suffixes")
        self.scans.append(scan)
        if not last:
            level = scan.where("not copy and tag > 0").drop("copy", "noted")
            self.levels = [*self.levels[:stay], (size, level)]
        return scan

    def copies(self) -> DataFrame:
        """doc, sum, lo, hi: strings whose whole context came earlier."""
        found = None
        for scan in self.scans:
            found = scan.where("copy") if found is None else found.unionByName(scan.where("copy"))
        lo = F.col("spot").bitwiseAND(F.lit(_POS))
        return found.select("doc", F.shiftright("spot", 31).alias("sum"), lo.alias("lo"), (lo + F.col("n") - 1 + self.length).alias("hi"))

    def noted(self) -> DataFrame:
        """gram, doc, spot of contexts to be compared by their bytes."""
        found = None
        for scan in self.scans:
            own = scan.where("noted").select("gram", "doc", "spot")
            found = own if found is None else found.unionByName(own)
        return found


def _context_rows(batches: Iterator[pa.RecordBatch], at: int, length: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The noted contexts of each text."""
    names = ["gram", "part", "split", "doc", "spot", "context"]
    for b in batches:
        for part in W.slices(b.append_column("text", b.column(f"c{at}"))):
            doc, sums = part.column("doc").to_numpy(), _checksums(part, "text")
            wanted = part.column("wanted")
            of = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            w_spot, w_part, w_split = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            w_key = (of << 31) | (w_spot & _POS)  # rows of a slice and places within them
            order = np.argsort(w_key, kind="stable")
            w_key, w_part, w_split = w_key[order], w_part[order], w_split[order]
            for data, lo, hi, rows, offset in _pieces(part, "text", length):
                own, first, count, gram, _ = anchors(data, lo, hi, length, prefix)
                row = rows[own]
                pos = first - lo[own] + offset[own]
                key = (row << 31) | pos
                near = np.searchsorted(w_key, key)
                hit = np.flatnonzero((near < len(w_key)) & (w_key[np.minimum(near, len(w_key) - 1)] == key)) if len(w_key) else near[:0]
                view = memoryview(data)
                context = [view[i:j] for i, j in zip(first[hit].tolist(), (first[hit] + count[hit] - 1 + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[hit]), pa.array(w_part[near[hit]]), pa.array(w_split[near[hit]].astype(bool)), pa.array(doc[row[hit]]),
                     pa.array((sums[row[hit]] << 31) | pos[hit]), pa.array([bytes(x) for x in context], pa.binary())], names=names)


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``length`` bytes, and whether each has those of the one before.

    Prefix doubling: places are ranked by 8 bytes, then by pairs of ranks of 16, 32, ... bytes. ``starts`` leave room for ``length``.
    """
    n = len(data)
    reach = 1
    rank = data.astype(np.uint64)
    while reach < 8 and reach * 2 <= length:  # up to 8 bytes fit one number as they are
        rank = (rank[: n - 2 * reach + 1] << np.uint64(8 * reach)) | rank[reach : n - reach + 1]
        reach *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while reach * 2 <= length:
        m = n - 2 * reach + 1
        pair = rank[:m] * (int(rank.max(initial=0)) + 1) + rank[reach : reach + m]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    pair = rank[starts] * (int(rank.max(initial=0)) + 1) + rank[starts + length - reach]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    return order, np.r_[False, pair[1:] == pair[:-1]][: len(pair)]


def _texts(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by (gram, part); whole groups of about ``size`` bytes form one text."""
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
        gram, part = (table.column(c).to_numpy() for c in ("gram", "part"))
        new = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1])) + 1
        if not len(new):  # one part so far; parts are bounded
            held = table.to_batches()
            continue
        yield from _in_texts(table.slice(0, int(new[-1])), length, size)
        held = table.slice(int(new[-1])).to_batches()
        weight = sum(x.column("context").nbytes for x in held)
    if held:
        yield from _in_texts(pa.Table.from_batches(held).combine_chunks(), length, size)
    W.give_back()


def _in_texts(table: pa.Table, length: int, size: int) -> Iterator[pa.RecordBatch]:
    gram, part = (table.column(c).to_numpy() for c in ("gram", "part"))
    group = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
    _, total = W.buffer_of(table.column("context"))
    at = 0
    while at < len(group):
        lo = int(group[at])
        to = max(int(np.searchsorted(total[group], total[lo] + size, side="right")), at + 1)
        hi = int(group[to]) if to < len(group) else len(table)
        yield _repeats(table.slice(lo, hi - lo), length)
        at = to


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch:
    """Copies among the strings of some contexts, as spans; of grams that were cut also the earliest place of each string."""
    doc, spot, split = (table.column(c).to_numpy() for c in ("doc", "spot", "split"))
    data, offsets = W.buffer_of(table.column("context").combine_chunks())
    starts, row = _starts(offsets[:-1], offsets[1:], length)
    order, same = suffix_array(data, starts, length) if len(starts) else (starts, np.zeros(0, bool))
    place = spot[row] + (starts - offsets[:-1][row])
    interval = np.cumsum(~same)
    order = order[np.lexsort((place[order], doc[row[order]], interval))]  # intervals stay in order
    head = np.r_[True, interval[1:] != interval[:-1]][: len(order)]
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
    copy = np.sort(order[(doc[row[order]] != doc[row[first]]) | (place[order] != place[first])])
    new = np.r_[True, (row[copy][1:] != row[copy][:-1]) | (np.diff(place[copy]) != 1)][: len(copy)]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(copy)][: len(s)] - 1
    lo, hi = place[copy[s]] & _POS, (place[copy[e]] & _POS) + length
    cols = [doc[row[copy[s]]], place[copy[s]] >> 31, lo, hi]
    nothing = np.zeros(len(s), np.int64)
    o = order[head & split[row[order]].astype(bool)] if len(order) else order
    node, node2 = nothing[:0], nothing[:0]
    if len(o):
        node = W.signed(_Hash(data).runs(length)[starts[o]])
        node2 = W.signed(W.grams(W._BYTE[data], length)[starts[o]])
    at = place[o] & _POS
    cols = [np.concatenate(x) for x in zip([*cols, nothing, nothing], [doc[row[o]], place[o] >> 31, at, at + length, node, node2], strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(np.r_[np.zeros(len(s), bool), np.ones(len(o), bool)])],
                                      names=["doc", "sum", "lo", "hi", "node", "node2", "open"])


def _cut(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Apply the spans: bytes, bytes removed, maximal removed runs, bytes kept."""
    for b in batches:
        for part in W.slices(b.append_column("text", b.column(f"c{at}"))):
            data, offsets = W.buffer_of(part.column("text"))
            spans = part.column("spans")
            valid = spans.is_valid().to_numpy(zero_copy_only=False)
            bounds = spans.offsets.to_numpy()
            bounds = bounds - bounds[0]
            flat = spans.flatten()
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            removed, runs, kept = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), []
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = data[a:z]
                s, e = int(bounds[i]), int(bounds[i + 1])
                if valid[i] and e > s:
                    gone = W.covered(len(own), lo[s:e], hi[s:e])
                    removed[i] = int(gone.sum())
                    runs[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                kept.append(own.tobytes())
            out = [part.column(f"c{j}") for j in range(len(names) - 4)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], names=names)


def spans(family: IndexFamily, placed: DataFrame, at: int, most: int, size: int) -> DataFrame:
    """doc, sum, spans: the copied ranges of each text, for all batches of a family (``placed``: their texts, by doc and sum)."""
    length, prefix = family.length, family.prefix
    noted = family.noted()
    counts = noted.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.when(F.col("m") > most, F.pmod(F.xxhash64("doc", "spot"), F.ceil(F.col("m") / most))).otherwise(0).cast("long")
    noted = noted.join(counts, "gram").withColumns({"part": parts, "split": F.col("m") > most})
    by_text = noted.groupBy("doc", F.shiftright("spot", 31).alias("sum")).agg(F.collect_list(F.struct("spot", "part", "split")).alias("wanted"))
    contexts = placed.join(by_text, ["doc", "sum"]).mapInArrow(
        lambda b: _context_rows(b, at, length, prefix), "gram long, part long, split boolean, doc long, spot long, context binary")
    found = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(
        lambda b: _texts(b, length, size), "doc long, sum long, lo long, hi long, node long, node2 long, open boolean")
    found = keep(found, "repeats")
    # strings of anchors cut into parts: the earliest place over all parts, then all others
    open_ = found.where("open")
    place = F.struct("doc", "sum", "lo")
    earliest = open_.groupBy("node", "node2").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest <> latest")
    between = open_.join(earliest, ["node", "node2"]).where(place != F.col("earliest"))
    cells = ["doc", "sum", "lo", "hi"]
    every = found.where("not open").select(*cells).unionByName(between.select(*cells)).unionByName(family.copies())
    return every.groupBy("doc", "sum").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, prefix: int = PREFIX,
                       most: int = MOST_CONTEXTS, size: int = TEXT_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary).

    A byte is removed when a string of ``length`` bytes of its document that covers it also starts earlier: in a row
    with a smaller doc_id, or earlier in the same one. ``batches`` changes the work, not the result.
    """
    spark = docs.sparkSession
    ready(spark)
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    own = docs.drop(*[c for c in docs.columns if c.lower() in added])
    names = own.columns
    cells = {n.lower(): i for i, n in enumerate(names)}
    for name in ("doc_id", "text"):
        if name not in cells:
            raise ValueError(f"the table has no column {name}")
    # numbered names inside, so that no column of the table clashes with a working one
    plain = own.toDF(*[f"c{i}" for i in range(len(names))])
    at = cells["text"]
    id_, text = F.col(f"c{cells['doc_id']}").cast("long"), F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")).cast("binary")
    doc = F.coalesce(id_, F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))
    placed = plain.withColumns({"doc": doc, "sum": F.crc32(text)})
    batches = max(1, batches)
    cuts = []
    if batches > 1:
        shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
        cuts = sorted(set(plain.agg(F.percentile_approx(id_, shares, 10_000)).first()[0] or []))
    bounds = [None, *cuts, None]
    family = IndexFamily(length, prefix)
    for i in range(len(bounds) - 1):
        some = placed
        if bounds[i] is not None:
            some = some.where(id_.isNull() | (id_ > bounds[i]))
        if bounds[i + 1] is not None:
            some = some.where(id_ <= bounds[i + 1])
        family.add(some.select("doc", F.col(f"c{at}").alias("text")), last=i == len(bounds) - 2)
    by_text = spans(family, placed, at, most, size)
    kept = plain.schema.fields
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in added[:3]), T.StructField("kept", T.BinaryType())])
    joined = placed.join(by_text, ["doc", "sum"], "left")
    return joined.mapInArrow(lambda b: _cut(b, at, schema.names), schema).toDF(*names, *added)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its bytes, the removed ones, their runs and a digest of the kept ones."""
    docs = read(spark, sf_dir, "documents")
    out = suffix_array_dedup(docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same result by a dictionary of all strings (for tests; ids unique, not null)."""
    seen: dict[bytes, tuple[int, int]] = {}
    out = []
    texts = sorted((d, (t or "").encode()) for d, t in rows)
    for d, t in texts:
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], (d, i))
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


#: Over hex digits, as DuckDB cuts no blobs.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS i, h FROM d WHERE n >= 100),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM w),
copies AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
marked AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM copies),
numbered AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
