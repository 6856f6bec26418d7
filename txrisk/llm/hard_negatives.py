"""Hard negatives by angular triangle filtering.

Method. Each row's angles to a few reference directions are computed once and stored with its integer vector.
For an anchor ``a``, a row ``x`` and a reference ``r`` the angle between a and x lies between ``|t(a,r) - t(x,r)|`` and
``t(a,r) + t(x,r)``, so the score lies between the products of the norms with the cosines of these two. Rows of a
batch are sorted by each reference angle; the scores an anchor still seeks (a score range) are then one window of angles
for each reference, found by binary search, and only rows in its narrowest window are scored. Angles are widened by
``MARGIN``, so that rounding never loses a row. Scores are exact integer inner products.

1. The index: usable rows with integer vector, norm and angles, written to the shared folder, sorted by nearest reference
   and angle within each task, so that a batch covers few angles. Nothing is shuffled.
2. Anchors pass in blocks of at most ``BLOCK_BYTES``. A block is sent to all tasks; each task reads its rows once and
   keeps, for each anchor, the best ``positives`` rows of its label. As the list fills, the window narrows.
3. The block goes round again with the score ranges of its positives, and the best rows of other labels in each are kept.

A task holds the block, one batch and the kept rows. Tasks hand on one packed row for 64 anchors; these are merged one
after the other, so that no list grows with the number of tasks. Labels are compared, never shuffled on: one label
may hold all rows. Lost executors cost the recomputation of their tasks.

Cases. A row with a null label, a null vector, or a null or non-finite component takes no part. The anchor's own id (and so
all rows of that id) is never its partner. Equal rows are rows of their own; a null id comes last among ties and is
no anchor. Of vectors of unequal length the shorter one counts as continued by zeros; an empty or zero vector scores 0.
Scores outside the range of a long count as its ends. An empty table has no result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import column, keep, read, ready

#: Components are multiplied by this and rounded down.
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's, and at most the positive's.
LOW, WHOLE = 80, 100
#: Reference directions, drawn from at most SAMPLE rows; they change the time, never the result.
REFERENCES = 8
SAMPLE = 2000
#: Bytes of anchors sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Rows scored at once, and anchors of a packed row.
BATCH_ROWS = 2048
GROUP = 64
#: Radians by which angles may be off by rounding.
MARGIN = 1e-6
_MAX = (1 << 63) - 1


def integers(vector: Column) -> Column:
    """Whole-number components, as doubles (exact: scaling by a power of two and rounding down lose nothing)."""
    most = 1.7e308  # a component that large makes a score the end of the longs either way
    return F.transform(vector, lambda x: F.when(F.abs(x) < 4e15, F.floor(x * SCALE).cast("double")).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), x * SCALE))))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (integers as doubles) of the rows that take part."""
    vector, label = column(rows, "embedding", "array<double>"), column(rows, "label", "int")
    cells = rows.select(column(rows, "vec_id", "long").alias("vec_id"), label.alias("label"), vector.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return cells.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad).select("vec_id", "label", integers(F.col("v")).alias("v"))


def _matrix(cells: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list<double> array as a matrix, short rows continued by zeros."""
    ends = cells.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    wide = max(int(size.max(initial=0)), width or 0)
    if len(size) and (size == wide).all():
        return flat.reshape(len(size), wide).astype(np.float64, copy=False)
    out = np.zeros((len(size), wide))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", m, m))


def angles(m: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each (unit) reference; NaN where a norm is zero or not finite."""
    width = max(m.shape[1], references.shape[1])
    m, references = _widen(m, width), _widen(references, width)
    norm = _norms(m)
    with np.errstate(all="ignore"):
        unit = m / norm[:, None]
        return np.arccos(np.clip(unit @ references.T, -1.0, 1.0))


def choose_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions that lie far from each other: each next one is the sample row farthest from those before."""
    norm = _norms(sample)
    unit = sample[(norm > 0) & np.isfinite(norm)]
    unit = unit / _norms(unit)[:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    picked, near = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[picked[-1]])
    return unit[picked]


def index(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """The written index (vec_id, label, v, angles) of all usable rows, and its reference directions."""
    ready(rows.sparkSession)
    found = usable(rows)
    drawn = found.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).toArrow()["v"].combine_chunks()
    chosen = choose_references(_matrix(drawn if isinstance(drawn, pa.Array) else drawn.chunk(0)), references) if len(drawn) else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = angles(_matrix(b.column("v")), chosen)
            nearest = np.argmin(np.nan_to_num(got, nan=9.0), axis=1) if got.shape[1] else np.zeros(b.num_rows, np.int64)
            least = got[np.arange(b.num_rows), nearest] if got.shape[1] else np.zeros(b.num_rows)
            flat = pa.array(np.ascontiguousarray(got).reshape(-1), pa.float64())
            cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * got.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, cells, pa.array(nearest.astype(np.int32)), pa.array(least)],
                                             names=["vec_id", "label", "v", "angles", "nearest", "least"])

    made = found.mapInArrow(run, "vec_id long, label int, v array<double>, angles array<double>, nearest int, least double")
    return keep(made.sortWithinPartitions("nearest", "least").drop("nearest", "least"), "angles"), chosen


class Rows:
    """A batch of rows: integer vectors, norms, angles, and its order by each angle."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, angle: np.ndarray):
        self.ids, self.labels, self.vectors, self.angles = ids, labels, vectors, angle
        self.norms = _norms(vectors)
        self.finite = bool(np.isfinite(self.norms).all()) and not np.isnan(angle).any() and angle.shape[1] > 0
        if self.finite:
            self.order = np.argsort(angle, axis=0, kind="stable")
            self.sorted = np.take_along_axis(angle, self.order, axis=0)
            self.least, self.most = float(self.norms.min(initial=np.inf)), float(self.norms.max(initial=0.0))


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``x`` (whole numbers as doubles), as longs."""
    width = max(a.shape[1], x.shape[1])
    a, x = _widen(a, width), _widen(x, width)
    if not width:
        return np.zeros((len(a), len(x)), np.int64)
    with np.errstate(all="ignore"):
        out = (a @ x.T).astype(np.int64)
        # below this bound every partial sum is a whole number that a double holds; else whole numbers of any size
        i, j = np.nonzero(~(_norms(a)[:, None] * _norms(x)[None, :] < 2.0**52))
    if len(i):
        left = {r: [int(c) for c in a[r].tolist()] for r in set(i.tolist())}
        right = {r: [int(c) for c in x[r].tolist()] for r in set(j.tolist())}
        out[i, j] = [max(-_MAX - 1, min(_MAX, sum(p * q for p, q in zip(left[r], right[c], strict=True)))) for r, c in zip(i.tolist(), j.tolist(), strict=True)]
    return out


def windows(anchor_norms: np.ndarray, anchor_angles: np.ndarray, low: np.ndarray, high: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor the reference with the fewest rows whose score bounds meet [low, high], and that window.

    ``low`` and ``high`` are doubles; infinite ones bound nothing. An anchor without a direction gets all rows.
    """
    n, m = len(rows.ids), len(anchor_norms)
    best, start, end = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, n, np.int64)
    sound = np.isfinite(anchor_norms) & (anchor_norms > 0) & ~np.isnan(anchor_angles).any(axis=1)
    if not rows.finite or not n or rows.least <= 0 or not sound.any():
        return best, start, end
    with np.errstate(all="ignore"):
        # a row reaches ``low`` only within this angle, and stays at or under ``high`` only beyond this one
        reach = np.arccos(np.clip(low / (anchor_norms * np.where(low >= 0, rows.most, rows.least)), -1.0, 1.0)) + MARGIN
        ratio = low / (anchor_norms * rows.most) * (1 - 1e-9)
        never = (low > 0) & (ratio > 1.0)
        beyond = np.where(high >= 0, np.arccos(np.clip(high / (anchor_norms * rows.least), -1.0, 1.0)) - MARGIN, 0.0)
    reach = np.where(np.isnan(reach), np.pi, reach)
    beyond = np.where(np.isnan(beyond), 0.0, beyond)
    for k in range(rows.sorted.shape[1]):
        t = anchor_angles[:, k]
        lo = np.searchsorted(rows.sorted[:, k], np.maximum(t - reach, beyond - t) - MARGIN, side="left")
        hi = np.searchsorted(rows.sorted[:, k], t + reach + MARGIN, side="right")
        hi = np.maximum(hi, lo)
        better = sound & (hi - lo < end - start)
        best[better], start[better], end[better] = k, lo[better], hi[better]
    end[never & sound] = start[never & sound]
    return best, start, end


class Best:
    """For each (anchor, slot): up to ``k`` rows, by descending score and ascending id, within the slot's range."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # (anchors, slots), as longs
        shape = (*low.shape, k)
        self.score = np.full(shape, -_MAX - 1, np.int64)
        self.id = np.full(shape, _MAX, np.int64)
        self.null = np.zeros(shape, bool)
        self.count = np.zeros(low.shape, np.int64)

    def floor(self) -> np.ndarray:
        """The least score that may still enter each slot."""
        return np.where(self.count == self.k, np.maximum(self.score[..., -1], self.low), self.low)

    def offer(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Rows for some (anchor, slot); each slot keeps its best."""
        if not len(anchor):
            return
        slots = self.low.shape[1]
        code = anchor * slots + slot
        touched = np.unique(code)
        a, s = touched // slots, touched % slots
        have = np.arange(self.k)[None, :] < self.count[a, s][:, None]
        code = np.concatenate([np.repeat(touched, have.sum(axis=1)), code])
        score = np.concatenate([self.score[a, s][have], score])
        ids = np.concatenate([self.id[a, s][have], ids])
        null = np.concatenate([self.null[a, s][have], null])
        order = np.lexsort((ids, null, ~score, code))  # ~score descends without overflow
        code, score, ids, null = code[order], score[order], ids[order], null[order]
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        place = np.arange(len(code)) - np.repeat(head, np.diff(np.r_[head, len(code)]))
        take = place < self.k
        at = (code[take] // slots, code[take] % slots, place[take])
        self.score[at], self.id[at], self.null[at] = score[take], ids[take], null[take]
        self.count[a, s] = np.minimum(self.k, np.diff(np.r_[head, len(code)]))


def search(block: dict, best: Best, same: bool, rows: Rows) -> None:
    """Offer the rows of one batch to the anchors of a block, rows of the anchor's label only (``same``) or of others."""
    floor = best.floor()
    wanted = best.low <= best.high
    any_ = wanted.any(axis=1)
    low = np.where(wanted, floor, _MAX).min(axis=1)
    high = np.where(wanted, best.high, -_MAX - 1).max(axis=1)
    lowest = np.where(low == -_MAX - 1, -np.inf, low.astype(float))
    highest = np.where(high == _MAX, np.inf, high.astype(float))
    _, start, end = found = windows(block["norms"], block["angles"], lowest, highest, rows)
    size = np.where(any_, end - start, 0)
    n = len(rows.ids)
    wide = np.flatnonzero(size * 4 >= n)
    step = max(1, (1 << 20) // max(n, 1))
    every = np.arange(n)
    for at in range(0, len(wide), step):
        some = wide[at : at + step]
        _take(block, best, same, rows, some, every, scores(block["vectors"][some], rows.vectors))
    for a in np.flatnonzero((size > 0) & (size * 4 < n)).tolist():
        near = rows.order[start[a] : end[a], found[0][a]]
        one = np.array([a])
        _take(block, best, same, rows, one, near, scores(block["vectors"][one], rows.vectors[near]))


def _take(block: dict, best: Best, same: bool, rows: Rows, anchors: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
    equal = block["labels"][anchors][:, None] == rows.labels[near][None, :]
    ok = (equal if same else ~equal) & ((block["ids"][anchors][:, None] != rows.ids[near][None, :]) | rows.null[near][None, :])
    floor = best.floor()[anchors]
    for slot in range(best.low.shape[1]):
        full = best.count[anchors, slot] == best.k
        last = np.where(full, best.id[anchors, slot, -1], _MAX)
        edge = score == floor[:, slot][:, None]
        fits = ok & (score <= best.high[anchors, slot][:, None]) & ((score > floor[:, slot][:, None]) | (edge & (~full[:, None] | (rows.ids[near][None, :] <= last[:, None]))))
        i, j = np.nonzero(fits)
        best.offer(anchors[i], np.full(len(i), slot), score[i, j], rows.ids[near][j], rows.null[near][j])


_PACKED = "grp long, anchor array<long>, slot array<int>, score array<long>, id array<long>"
_NAMES = ["grp", "anchor", "slot", "score", "id"]


def _pack(best: Best) -> Iterator[pa.RecordBatch]:
    """One row for each GROUP anchors: their kept rows as arrays."""
    for at in range(0, len(best.low), GROUP):
        have = np.arange(best.k)[None, None, :] < best.count[at : at + GROUP, :, None]
        a, s, k = np.nonzero(have)
        if not len(a):
            continue
        a += at
        ids = pa.array(best.id[a, s, k], mask=best.null[a, s, k])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), x)
        cells = [pa.array([at // GROUP], pa.int64()), whole(pa.array(a)), whole(pa.array(s.astype(np.int32))), whole(pa.array(best.score[a, s, k])), whole(ids)]
        yield pa.RecordBatch.from_arrays(cells, names=_NAMES)


def _unpack(b: pa.RecordBatch, best: Best, base: int = 0) -> None:
    """Offer packed rows to ``best``; anchors are numbered from ``base``."""
    a, s, score = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("anchor", "slot", "score"))
    ids = b.column("id").flatten()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    best.offer(a - base, s.astype(np.int64), score, ids.fill_null(_MAX).to_numpy(zero_copy_only=False), null)


def _round(stored: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """grp, anchor, slot, score, id: the best ``k`` rows of each anchor and slot over all of ``stored``."""
    sent = stored.sparkSession.sparkContext.broadcast((block, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = sent.value
        best = Best(low, high, k)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                ids = part.column("vec_id")
                rows = Rows(ids.fill_null(_MAX).to_numpy(zero_copy_only=False), part.column("label").to_numpy(), _matrix(part.column("v")), _matrix(part.column("angles")))
                rows.null = ids.is_null().to_numpy(zero_copy_only=False)
                search(block, best, same, rows)
        yield from _pack(best)
        W.give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, low, high = sent.value
        now, best = None, None
        for b in batches:
            for i in range(b.num_rows):
                grp = b.column("grp")[i].as_py()
                if grp != now:
                    if best is not None:
                        yield from _flat(best, now)
                    now, best = grp, Best(low[grp * GROUP : (grp + 1) * GROUP], high[grp * GROUP : (grp + 1) * GROUP], k)
                _unpack(b.slice(i, 1), best, grp * GROUP)
        if best is not None:
            yield from _flat(best, now)

    packed = stored.mapInArrow(run, _PACKED)
    return packed.repartition("grp").sortWithinPartitions("grp").mapInArrow(merge, "anchor long, slot int, place int, score long, id long")


def _flat(best: Best, grp: int) -> Iterator[pa.RecordBatch]:
    a, s, k = np.nonzero(np.arange(best.k)[None, None, :] < best.count[:, :, None])
    ids = pa.array(best.id[a, s, k], mask=best.null[a, s, k])
    yield pa.RecordBatch.from_arrays([pa.array(a + grp * GROUP), pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(best.score[a, s, k]), ids],
                                     names=["anchor", "slot", "place", "score", "id"])


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``every``) and positive, the best negatives in its score range.

    ``rows`` has vec_id, label and embedding. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    stored, _ = index(rows)
    anchors = stored.where(F.col("vec_id") % every == 0)
    size = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size[0]:
        return spark.createDataFrame([], schema)
    per_block = max(1, block_bytes // (8 * (max(size[1], 1) + REFERENCES + 2 + 2 * positives)))
    blocks = -(-size[0] // per_block)
    dealt = anchors
    if blocks > 1:  # by a hash of the row's place, so that no id fills a block
        dealt = keep(anchors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "anchors")
    out = None
    for i in range(blocks):
        own = (dealt.where(F.col("block") == i).drop("block") if blocks > 1 else dealt).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        vectors = _matrix(own["v"].chunk(0))
        block = {"ids": own["vec_id"].to_numpy(), "labels": own["label"].to_numpy(), "vectors": vectors, "norms": _norms(vectors),
                 "angles": _matrix(own["angles"].chunk(0))}
        m = own.num_rows
        free = np.full((m, 1), -_MAX - 1, np.int64)
        first = _round(stored, block, free, -1 - free, positives, True).toArrow()
        found = {c: first[c].to_numpy() for c in ("anchor", "place", "score")}
        low, high = np.ones((m, positives), np.int64), np.zeros((m, positives), np.int64)  # empty ranges
        at = (found["anchor"], found["place"])
        high[at] = found["score"]
        low[at] = [-(-LOW * s // WHOLE) for s in found["score"].tolist()]
        own_ids = spark.createDataFrame(pa.table({"anchor": pa.array(found["anchor"]), "slot": pa.array(found["place"].astype(np.int32)), "positive_id": first["id"],
                                                  "positive_score": first["score"], "anchor_id": pa.array(block["ids"][found["anchor"]])}))
        second = _round(stored, block, low, high, negatives, False)
        done = second.join(F.broadcast(own_ids), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        done = keep(done, "negatives") if blocks > 1 else done
        out = done if out is None else out.union(done)
    return out


def spoilt_labels(rows: DataFrame) -> DataFrame:
    """``embeddings`` with the label of every seventh row moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``, against all rows."""
    return hard_negatives(spoilt_labels(read(spark, sf_dir, "embeddings")))


def brute_force(rows: list[tuple], every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple]:
    """The same rows by plain loops, for rows (vec_id, label, vector) (for tests)."""
    import math

    good = [(i, y, [math.floor(SCALE * x) for x in v]) for i, y, v in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if i is None or i % every:
            continue
        scored = [(max(-_MAX - 1, min(_MAX, sum(a * b for a, b in zip(v, w, strict=False)))), j, z) for j, z, w in good if j != i]
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            hard = [r for r in scored if r[2] != y and LOW * s <= WHOLE * r[0] <= WHOLE * s][:negatives]
            out += [(i, j, n, r[1], s, r[0]) for n, r in enumerate(hard, 1)]
    return out


ORACLE_SQL = """
WITH good AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
