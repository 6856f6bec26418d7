"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Method. The shingles of a document are hashed into groups; the vector of group counts is a point.
For two documents the sum of the coordinate minima bounds the size of their common part from
above, so pairs whose sum is under ``t/(1+t) * (|A|+|B|)`` cannot link. Points are packed into an
R-tree whose boxes give the same bound for all points below. What survives is verified on the whole sets.

All points of a corpus in one tree would compare everything with everything, so the tree is cut
first, without loss:

1. Documents with equal sets are one class; from here on one row stands for it.
2. With all shingles in one fixed order, linked sets share one among the first
   ``|A| - ceil(t |A|) + 1`` of each (prefix filter). Only documents that share such a shingle meet in a
   tree. The order is by hash, with frequent shingles last. Which are frequent is estimated on at
   most ``SAMPLE_ROWS`` documents; any order is exact, a poor estimate costs time only.
3. Shingles that the same documents share make one tree. A shingle with over ``MOST`` documents is
   cut into blocks, and each two blocks make a tree.
4. A tree gives back a spanning forest of its surviving pairs, not the pairs. The forests' connected
   components (Spark rounds, :mod:`.graph`) hold all links; inside each the whole sets are compared until
   everything is connected or refuted. A component of over ``BLOCK_SHINGLES`` shingles is cut into
   blocks, each two of which are compared in a task of their own.

Cases. A null or blank text has an empty set, links with nothing and is its own component. Fewer
than ``n`` words: the whole sequence is the one shingle. Documents with equal sets share their component,
also under one doc_id. A null doc_id joins a component but does not name it (its own alone: null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .repeats import repeated
from .tables import column, keep, read

N = 5
#: Similarity as a fraction, so that the comparison is in whole numbers.
NUMERATOR, DENOMINATOR = 80, 100
MOST = 30_000
SAMPLE_ROWS = 5_000
#: A shingle in this share of the sampled documents, and in four of them at least, counts as frequent.
FREQUENT = 0.001
BLOCK_SHINGLES = 4_000_000
LEAF = 32


# ---- sets, points, prefixes ----------------------------------------------------------------------

def shingle_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within a row, and the rows' bounds."""
    words = W.tokenize(texts, lower=True)
    starts = W.within_row(words, n)
    h, row = W.grams(words.hash, n)[starts], words.row[starts]
    size = np.diff(words.first)
    for length in range(1, n):  # short texts: the whole sequence
        rows = np.flatnonzero(size == length)
        if len(rows):
            g = W.grams(words.hash, length)[words.first[rows]]
            h, row = np.concatenate([h, W.mix(g + np.uint64(length))]), np.concatenate([row, rows])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(size) + 1))


def classes_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    total = np.r_[np.uint64(0), np.cumsum(W.mix(h ^ np.uint64(0xD6E8FEB86659FD93)))]
    return W.signed(W.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))


def level(size: int) -> int:
    """Groups into which a set of this size is hashed: a power of two from a quarter to half of it."""
    return 1 << max(4, size.bit_length() - 2)


def point(shingles: np.ndarray, groups: int) -> np.ndarray:
    """Count of shingles in each group, saturated at 255 (which then means: any number)."""
    at = (W.mix(shingles ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(groups - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), 255).astype(np.uint8)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """Points (last axis) summed down to fewer groups."""
    out = p.astype(np.int32)
    while out.shape[-1] > groups:
        half = out.shape[-1] // 2
        out = out[..., :half] + out[..., half:]
    return out


def _class_rows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "text_hash", "n", "cls", "keys", "point"]
    for b in batches:
        for part in W.slices(b):
            h, bounds = shingle_sets(part.column("text"), n)
            size = np.diff(bounds)
            cls = classes_of(h, bounds)
            late = np.zeros(len(h), bool)
            if len(frequent):
                near = np.searchsorted(frequent, h)
                near[near == len(frequent)] = 0
                late = frequent[near] == h
            keys, points = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, m = h[a:z], z - a
                if not m:
                    keys.append(b"")
                    points.append(b"")
                    continue
                ordered = np.concatenate([own[~late[a:z]], own[late[a:z]]])
                keys.append(ordered[: m - -(-num * m // den) + 1].tobytes())
                points.append(point(own, level(m)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(size.astype(np.int64)), pa.array(cls),
                                              pa.array(keys, pa.binary()), pa.array(points, pa.binary())], names=names)


def _frequent(ids: DataFrame, n: int, rows: int, share: float) -> np.ndarray:
    """Hashes of shingles that are frequent in a sample of at most about ``rows`` documents, ascending."""
    total = ids.count()
    if not total:
        return np.zeros(0, np.uint64)
    part = ids.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < F.lit(math.ceil(min(1.0, rows / total) * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in W.slices(b):
                h, count = np.unique(shingle_sets(piece.column("text"), n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(h)), pa.array(count)], names=["h", "c"])

    least = max(4, math.ceil(share * min(rows, total)))
    found = part.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


# ---- trees of documents that share a shingle -----------------------------------------------------

def _same_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cls) in key order, each key in one task, to (tree, cls): keys with the same members give one tree."""
    seen: set[int] = set()
    held: list[np.ndarray] | None = None

    def out(key: np.ndarray, cls: np.ndarray) -> pa.RecordBatch | None:
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        which = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(key)]))
        keep_ = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]  # repeated rows
        which, cls = which[keep_], cls[keep_]
        size = np.bincount(which, minlength=len(heads))
        mixed = W.mix(cls.view(np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(mixed)]
        ends = np.cumsum(size)
        tree = W.signed(W.mix(total[ends] - total[ends - size] + size.astype(np.uint64)))
        new = np.array([s > 1 and not (t in seen or seen.add(t)) for t, s in zip(tree.tolist(), size.tolist(), strict=True)], bool)
        rows = new[which]
        return pa.RecordBatch.from_arrays([pa.array(tree[which][rows]), pa.array(cls[rows])], names=["tree", "cls"]) if rows.any() else None

    for b in batches:
        if not b.num_rows:
            continue
        key, cls = (b.column(c).to_numpy() for c in ("key", "cls"))
        if held is not None:
            key, cls = np.concatenate([held[0], key]), np.concatenate([held[1], cls])
        last = int(np.searchsorted(key, key[-1]))
        if last and (made := out(key[:last], cls[:last])) is not None:
            yield made
        held = [key[last:], cls[last:]]
    if held is not None and (made := out(*held)) is not None:
        yield made


class CountTree:
    """R-tree over points of one width: leaves of ``LEAF`` points, boxes of their greatest coordinates."""

    def __init__(self, points: np.ndarray, size: np.ndarray, num: int, den: int):
        self.points, self.size, self.num, self.den = points, size, num, den
        order = np.arange(len(size))
        self.leaves = self._pack(order, 0)
        self.box = np.stack([points[leaf].max(axis=0) for leaf in self.leaves])
        self.low = np.array([size[leaf].min() for leaf in self.leaves])
        self.high = np.array([size[leaf].max() for leaf in self.leaves])
        self.alive = np.ones(len(size), bool)

    def _pack(self, rows: np.ndarray, depth: int) -> list[np.ndarray]:
        """Halve by size first, then by the coordinate of the widest spread."""
        if len(rows) <= LEAF:
            return [rows]
        if depth < 2:
            key = self.size[rows]
        else:
            part = self.points[rows]
            key = part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))]
        rows = rows[np.argsort(key, kind="stable")]
        half = len(rows) // 2
        return self._pack(rows[:half], depth + 1) + self._pack(rows[half:], depth + 1)

    def near(self, p: np.ndarray, size: int) -> np.ndarray:
        """Living points that may link with ``p``."""
        fits = (self.high * self.den >= size * self.num) & (self.low * self.num <= size * self.den)
        fits &= may_link(np.minimum(self.box, p).sum(axis=1), size, self.low, self.num, self.den)
        found = [self.leaves[i] for i in np.flatnonzero(fits).tolist()]
        if not found:
            return np.zeros(0, np.int64)
        rows = np.concatenate(found)
        rows = rows[self.alive[rows]]
        return rows[may_link(np.minimum(self.points[rows], p).sum(axis=1), size, self.size[rows], self.num, self.den)]


def may_link(common, a, b, num: int, den: int):
    """Whether a common part of ``common`` would do: common / (a + b - common) >= num / den, and sizes fit."""
    return (common * (den + num) >= num * (a + b)) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)


def forest(points: list[bytes], size: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest (pairs of rows) of the pairs whose bound lets them link."""
    m = len(points)
    if m == 2:
        a, b = (np.frombuffer(p, np.uint8) for p in points)
        g = min(len(a), len(b))
        a, b = (fold(x, g) if len(x) > g or x.max() == 255 else x for x in (a, b))
        full = 255 in points[0] or 255 in points[1]
        return [(0, 1)] if may_link(np.int64(1 << 40) if full else np.minimum(a, b).sum(dtype=np.int64), size[0], size[1], num, den) else []
    parsed = [np.frombuffer(p, np.uint8) for p in points]
    full = np.array([255 in p for p in points])
    widths = np.array([len(p) for p in parsed])
    trees: dict[int, tuple[np.ndarray, CountTree]] = {}
    for g in np.unique(widths).tolist():  # a tree for each width; its points also folded for wider neighbours
        rows = np.flatnonzero(widths == g)
        own = np.stack([parsed[i] for i in rows]).astype(np.int32)
        own[full[rows]] = 1 << 16
        trees[g] = rows, CountTree(own, size[rows], num, den)
    folded = {g: (rows, CountTree(fold(t.points, g // 2), size[rows], num, den)) for g, (rows, t) in trees.items() if g // 2 in trees}
    for g, (_, t) in folded.items():
        t.alive = trees[g][1].alive  # one mark for both
    where = np.zeros(m, np.int64)
    for rows, _ in trees.values():
        where[rows] = np.arange(len(rows))
    out, reached = [], np.zeros(m, bool)
    for root in range(m):
        if reached[root]:
            continue
        reached[root] = True
        trees[int(widths[root])][1].alive[where[root]] = False
        stack = [root]
        while stack:
            q = stack.pop()
            g, n = int(widths[q]), int(size[q])
            p = trees[g][1].points[where[q]]
            hits = [trees[g][0][trees[g][1].near(p, n)]]
            if g // 2 in trees:
                rows, t = trees[g // 2]
                hits.append(rows[t.near(fold(p, g // 2), n)])
            if g * 2 in folded:
                rows, t = folded[g * 2]
                hits.append(rows[t.near(p, n)])
            for x in np.concatenate(hits).tolist():
                reached[x] = True
                trees[int(widths[x])][1].alive[where[x]] = False
                out.append((q, x))
                stack.append(x)
    return out


def _groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, in tables of whole groups."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            count += held[-1].num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k = table.column(key).to_numpy()
            last = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            if last:
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
                count = len(table) - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(k: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]


def _tree_edges(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    said: set[tuple[int, int]] = set()
    for table in _groups(batches, "tree"):
        at = _bounds(table.column("tree").to_numpy()).tolist()
        cls, size = table.column("cls").to_numpy(), table.column("n").to_numpy()
        points = table.column("point").to_pylist()
        new = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            if z - a < 2:
                continue
            for x, y in forest(points[a:z], size[a:z], num, den):
                x, y = int(cls[a + x]), int(cls[a + y])
                edge = (x, y) if x < y else (y, x)
                if x != y and edge not in said:
                    new.append(edge)
                    said.add(edge)
        if len(said) > 100_000:
            said.clear()  # repeats are removed again by distinct()
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], names=["a", "b"])
    W.give_back()


def _block_trees(hot: DataFrame) -> DataFrame:
    """Members (key, cls, part) of cut keys, dealt to a tree for each two blocks of their key."""
    blocks = hot.select("key", F.col("part").alias("other")).distinct()
    pairs = hot.join(blocks, "key").where("part <= other").select(
        F.xxhash64("key", "part", "other").alias("tree"), "key", F.col("part").alias("x"), F.col("other").alias("y")).distinct()
    first = pairs.join(hot, (pairs["key"] == hot["key"]) & ((hot["part"] == pairs["x"]) | (hot["part"] == pairs["y"])))
    return first.select("tree", "cls")


# ---- verification on whole sets ------------------------------------------------------------------

def exact_labels(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set under the exact similarity: the number of the first set in it."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.full(m, -1)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    start = np.r_[0, np.cumsum(size)]
    waiting = np.arange(m)
    while len(waiting):
        root = int(waiting[0])
        label[root] = root
        waiting = waiting[1:]
        stack = [root]
        while stack and len(waiting):
            q = stack.pop()
            fit = np.flatnonzero(np.minimum(size[waiting], size[q]) * den >= np.maximum(size[waiting], size[q]) * num)
            if not len(fit):
                continue
            rows = waiting[fit]
            lengths = size[rows]
            total = np.cumsum(lengths)
            at = np.arange(int(total[-1])) + np.repeat(start[rows] - (total - lengths), lengths)
            own = sets[q]
            near = np.searchsorted(own, flat[at])
            near[near == len(own)] = 0
            common = np.add.reduceat((own[near] == flat[at]).astype(np.int64), total - lengths)
            hit = common * den >= num * (lengths + size[q] - common)
            label[rows[hit]] = root
            stack += rows[hit].tolist()
            waiting = np.delete(waiting, fit[hit])
    return label


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, cls, shingles) by block to a star (a, b) for each exact component."""
    for table in _groups(batches, "block", 512):
        at = _bounds(table.column("block").to_numpy()).tolist()
        cls = table.column("cls").to_numpy()
        cells = table.column("shingles").combine_chunks()
        new = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            members = {int(c): i for i, c in enumerate(cls[a:z].tolist(), a)}
            if len(members) < 2:
                continue
            rows = list(members.values())
            label = exact_labels([np.frombuffer(cells[i].as_py(), np.uint64) for i in rows], num, den)
            new += [(int(cls[rows[int(k)]]), int(cls[r])) for r, k in zip(rows, label, strict=True) if rows[int(k)] != r]
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], names=["a", "b"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, cls) without the repeats that rows equal in id and text make."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(n).to_numpy() for n in ("block", "cls")])
        new = np.r_[last is None or bool((key[:, 0] != last).any()), (key[:, 1:] != key[:, :-1]).any(axis=0)]
        last = key[:, -1]
        yield b if new.all() else b.filter(pa.array(new))


def _set_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in W.slices(b):
            h, bounds = shingle_sets(part.column("text"), n)
            cells = [h[a:z].tobytes() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            made = pa.RecordBatch.from_arrays([part.column("cls"), part.column("comp"), part.column("blocks"), pa.array(cells, pa.binary())],
                                              names=["cls", "comp", "blocks", "shingles"])
            # another text may bear the same doc_id
            yield made.filter(pa.array(classes_of(h, bounds) == part.column("cls").to_numpy()))


def jaccard_components(docs: DataFrame, n: int = N, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
                       most: int = MOST, sample_rows: int = SAMPLE_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    out = linked_rows(docs, n, numerator, denominator, most, sample_rows, block_shingles)
    return out.select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, n: int = N, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
                most: int = MOST, sample_rows: int = SAMPLE_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``jaccard_components`` with ``text_hash`` (xxhash64 of the text) and ``label``, the component's number whatever its doc_ids (null without words)."""
    num, den = numerator, denominator
    ids = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    hashed = ids.withColumn("text_hash", F.xxhash64("text"))
    frequent = ids.sparkSession.sparkContext.broadcast(_frequent(ids, n, sample_rows, FREQUENT))
    rows = keep(hashed.mapInArrow(lambda b: _class_rows(b, frequent.value, n, num, den),
                                  "doc long, text_hash long, n long, cls long, keys binary, point binary"), "sets")
    classes = rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc").alias("doc"),
        # the text of one row stands for the class: the same row as ``doc``, any where all ids are null
        F.coalesce(F.min_by("text_hash", "doc"), F.min("text_hash")).alias("hash"))
    reps = rows.where("n > 0").groupBy("cls").agg(F.first("keys").alias("keys"))
    postings = reps.mapInArrow(_postings, "key long, cls long")
    again = keep(repeated(postings, "key", ["cls"], most), "postings")
    # a large file is read by several tasks: rows of a key meet again
    whole = again.where("not split").select("key", "cls").repartition("key").sortWithinPartitions("key", "cls")
    plain = whole.mapInArrow(_same_members, "tree long, cls long")
    trees = plain.union(_block_trees(again.where("split").select("key", "cls", "part").distinct())).distinct()
    points = rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    edges = trees.join(points, "cls").repartition("tree").sortWithinPartitions("tree").mapInArrow(
        lambda b: _tree_edges(b, num, den), "a long, b long")
    maybe = keep(components(edges), "maybe")
    # whole sets of one document for each class in a component
    members = maybe.join(classes, maybe["node"] == classes["cls"]).select("cls", "doc", "hash", "n", F.col("label").alias("comp"))
    weight = members.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("long").alias("blocks"))
    wanted = members.join(weight, "comp").select("cls", "doc", "hash", "comp", "blocks")
    texts = hashed.join(wanted, (hashed["text_hash"] == wanted["hash"]) & hashed["doc_id"].eqNullSafe(wanted["doc"])).select("cls", "comp", "blocks", "text")
    sets = texts.mapInArrow(lambda b: _set_rows(b, n), "cls long, comp long, blocks long, shingles binary")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    dealt = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.xxhash64("comp", F.least("mine", "other"), F.greatest("mine", "other"))
    links = dealt.select(block.alias("block"), "cls", "shingles").repartition("block").sortWithinPartitions("block", "cls").mapInArrow(
        lambda b: _verify(_once(b), num, den), "a long, b long")
    final = keep(components(links), "final")
    named = classes.join(final, classes["cls"] == final["node"], "left").select(
        "cls", "doc", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_class = named.join(least, "label").select("cls", "label", "component_id")
    out = rows.select("doc", "text_hash", "n", "cls").join(of_class, "cls", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), "text_hash", "label")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            cells = part.column("keys").to_pylist()
            size = np.array([len(c) // 8 for c in cells], np.int64)
            flat = np.frombuffer(b"".join(cells), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(part.column("cls").to_numpy(), size))], names=["key", "cls"])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the size of its set and its component."""
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, md5(CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i + 1 : i + 5], ' ') END) AS s
      FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS other FROM sym UNION SELECT r.doc_id, sym.b FROM reach r JOIN sym ON sym.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], n: int = N) -> list[tuple[int, int, int]]:
    """The same result by an inverted index over whole sets (for tests)."""
    import re

    sets = []
    for d, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append((d, grams))
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    index: dict[tuple, list[int]] = {}
    for i, (_, s) in enumerate(sets):
        common: dict[int, int] = {}
        for g in s:
            for j in index.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            index[g].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j][1]) - c):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]
