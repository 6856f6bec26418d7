"""Words, word hashes and n-gram hashes of Arrow text columns, vectorised with NumPy.

A word is a maximal run of bytes other than space and 0x09-0x0D, so the bytes of a word are
never decoded. Word and n-gram identity is a 64-bit hash: two different words are taken for
equal with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task (a longer text is still handled whole).
SLICE_BYTES = 1 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, at least ``n`` of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 21:  # a single giant text does not stay in the cache
            _POWERS[base] = have
    return have


@dataclass
class Words:
    """Words of a slice of rows: byte ranges into ``data``, row of each word, 64-bit hash."""

    data: np.ndarray
    row_start: np.ndarray
    row_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each row; one more entry than rows

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (exclusive), as they stand in the text."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo if len(texts) else np.zeros(1, np.int64)


#: What operators keep in a worker between tasks: name -> how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes of text each.

    Workers live on from one operator to the next: what others than ``owner`` have kept is let go.
    """
    for name in [n for n in KEPT if n != owner]:
        KEPT.pop(name)()
    if not batch.num_rows:
        return
    _, offsets = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(batch.num_rows, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a reused worker would else hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tokenize(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every row of ``texts``; ``lower`` maps A-Z to a-z for the hashes."""
    data, offsets = buffer_of(texts)
    n = len(data)
    rows = len(offsets) - 1
    # a sentinel space after each row would copy the text; row ends are cut explicitly instead
    space = _SPACE[data]
    inner = np.ones(n + 1, dtype=bool)
    inner[:-1] = space
    before = np.ones(n + 1, dtype=bool)
    before[1:] = space
    starts_row = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut = np.zeros(n + 1, dtype=bool)
    cut[starts_row] = True
    word_byte = ~inner[:-1]
    start = np.flatnonzero(word_byte & (before[:-1] | cut[:-1]))
    end = np.flatnonzero(word_byte & (inner[1:] | cut[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    h = hash_ranges(_LOWER[data] if lower else data, start, end)
    first = np.searchsorted(start, offsets)
    return Words(data, offsets[:-1], offsets[1:], start, end, row, h, first)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive items from each position (``len(h) - n + 1`` values; rows are not cut)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_GRAM, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])


def within_row(words: Words, n: int) -> np.ndarray:
    """Positions from which ``n`` words lie in one row."""
    if len(words.row) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.row[: len(words.row) - n + 1] == words.row[n - 1 :])


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask over ``n`` items of those inside any range [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
