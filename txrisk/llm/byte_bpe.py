"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each task.

Method. The split pattern cuts a text into pieces. Pieces new to a worker go, some thousands at a
time, into a DuckDB table of (word, position, token, next position, next token). A recursive query
joins these rows to the merge table on (token, next token), takes for each word its leftmost pair
of least rank, contracts it, and goes on until no word has a pair left. Decoding joins the ids to the
vocabulary and concatenates the tokens' bytes by an aggregate ordered by position.

Texts never meet, so nothing is shuffled. A worker remembers at most ``2 * MEMORY`` pieces of at most ``LONG``
bytes. A query keeps the rows of all its steps, so it does as many contractions a word as keep these under ``ROWS``, and
is then called again on the words not yet done.

A piece over ``LONG`` bytes is encoded in overlapping blocks, each a word of its own, and the blocks are joined at a token
that both neighbours hold at the same place. That is the encoding of the whole: a list of tokens is the
encoding of its bytes exactly if every two neighbours are the encoding of theirs, and each two neighbours here stand
together in the encoding of a block. Blocks without a common token are cut anew, twice as long. Time
and memory grow with the piece, not with its square.

Cases. Null or empty text: no ids, decoded to no bytes. Special tokens are ordinary text. Repeated
rows are encoded alike; other columns pass through. An id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import column, read

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces in each of the two generations a worker remembers.
MEMORY = 300_000
#: Contractions of a word in one recursive query.
STEPS = 64
#: Bytes of pieces in one recursive query, and rows of all its steps.
QUERY_BYTES = 200_000
ROWS = 4_000_000
#: Pieces over LONG bytes are encoded in blocks of BLOCK bytes and MARGIN more on either side.
LONG, BLOCK, MARGIN = 1024, 256, 64
#: Rank files beyond this size are refused: the file is shipped to every task.
MAX_VOCABULARY_BYTES = 64 << 20

_MERGE = """
WITH RECURSIVE s(w, p, t, q, nx, n) AS (
  SELECT w, p, t, lead(p) OVER z, lead(t) OVER z, 0 FROM start_rows WINDOW z AS (PARTITION BY w ORDER BY p)
  UNION ALL
  (WITH best AS (
      SELECT s.w, min(m.m::BIGINT * (1::BIGINT << 32) + s.p) AS b
      FROM s JOIN merges m ON s.t = m.l AND s.nx = m.r WHERE s.n < {steps} GROUP BY s.w),
   found AS (
      SELECT a.w, best.b >> 32 AS mt, a.p AS mp, a.q AS mq, z.q AS zq, z.nx AS znx
      FROM best JOIN s a ON a.w = best.w AND a.p = (best.b & 4294967295) JOIN s z ON z.w = a.w AND z.p = a.q)
   SELECT s.w, s.p,
     CASE WHEN s.p = mp THEN mt ELSE t END::INT,
     CASE WHEN s.p = mp THEN zq ELSE q END,
     CASE WHEN s.p = mp THEN znx WHEN s.q = mp THEN mt ELSE nx END::INT, n + 1
   FROM s JOIN found f ON s.w = f.w WHERE s.p <> mq))
SELECT s.w, s.n, s.t FROM s JOIN (SELECT w, max(n) AS n FROM s GROUP BY w) USING (w, n) ORDER BY s.w, s.p
"""
_DECODE = "SELECT w, string_agg(s, '' ORDER BY p) AS s FROM ids JOIN vocab ON t = id GROUP BY w"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return data


class Codec:
    """The tables of one vocabulary in a private in-memory DuckDB of this worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.find = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})
        made = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32())})
        self._table("merges", made)
        self._table("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                                       "s": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())}))
        self.size = max(self.ranks.values(), default=-1) + 1
        self.length = np.zeros(self.size, np.int64)
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _table(self, name: str, data: pa.Table) -> None:
        self.db.register("made", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM made")
        self.db.unregister("made")

    def merge(self, words: list[bytes], steps: int = STEPS) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit), by recursive queries until no word has a pair to contract."""
        out = [b""] * len(words)
        number = np.arange(len(words), dtype=np.int32)
        size = np.array([len(w) for w in words], np.int64)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        while len(number):
            start = np.cumsum(size) - size
            data = pa.table({
                "w": pa.array(np.repeat(number, size)), "t": pa.array(token),
                "p": pa.array((np.arange(len(token)) - np.repeat(start, size)).astype(np.int32))})
            self.db.register("start_rows", data)
            now = max(1, min(steps, ROWS // len(token)))
            got = self.db.execute(_MERGE.format(steps=now)).fetchnumpy()
            self.db.unregister("start_rows")
            w, n, token = (np.asarray(got[c]) for c in ("w", "n", "t"))
            head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]][: len(w)])
            end = np.r_[head[1:], len(w)][: len(head)]
            flat = token.astype("<u4").tobytes()
            for i, a, z in zip(w[head].tolist(), (4 * head).tolist(), (4 * end).tolist(), strict=True):
                out[i] = flat[a:z]
            again = n[head] >= now  # these may have pairs left
            number, size = w[head][again].astype(np.int32), (end - head)[again]
            token = token[np.repeat(again, end - head)].astype(np.int32)
        return out

    def _blocks(self, raw: bytes, block: int, margin: int) -> bytes | None:
        """Ids of a long piece from overlapping blocks; None where two neighbours have no token in common."""
        n = len(raw)
        cuts = list(range(0, n, block))
        starts = [max(0, c - margin) for c in cuts]
        words = [raw[a : min(n, c + block + margin)] for a, c in zip(starts, cuts, strict=True)]
        per_query = max(1, QUERY_BYTES // (block + 2 * margin))
        coded = [i for at in range(0, len(words), per_query) for i in self.merge(words[at : at + per_query])]
        out: list[np.ndarray] = []
        begin = 0  # where the tokens already taken end
        ids = np.frombuffer(coded[0], "<u4")
        end = starts[0] + np.cumsum(self.length[ids])
        for k in range(1, len(words)):
            next_ids = np.frombuffer(coded[k], "<u4")
            next_end = starts[k] + np.cumsum(self.length[next_ids])
            # tokens are known by where they end and how long they are
            same = np.intersect1d(end * (n + 1) + self.length[ids], next_end * (n + 1) + self.length[next_ids]) // (n + 1)
            same = same[same > begin]
            if not len(same):
                return None
            seam = int(same[np.argmin(np.abs(same - cuts[k]))])
            out.append(ids[(end > begin) & (end <= seam)])
            begin, ids, end = seam, next_ids, next_end
        out.append(ids[end > begin])
        return np.concatenate(out).astype("<u4").tobytes()

    def encode_long(self, raw: bytes) -> bytes:
        """Ids of a piece of any length."""
        block, margin = BLOCK, MARGIN
        while block < len(raw):
            found = self._blocks(raw, block, margin)
            if found is not None:
                return found
            block, margin = 2 * block, 2 * margin
        return self.merge([raw])[0]

    def _learn(self, pieces: list[str]) -> None:
        batch: list[str] = []
        coded: list[bytes] = []
        weight = 0

        def flush() -> None:
            for p, ids in zip(batch, self.merge(coded), strict=True):
                self.young[p] = ids

        for p in pieces:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.young[p] = whole.to_bytes(4, "little")
                continue
            batch.append(p)
            coded.append(raw)
            weight += len(raw)
            if weight >= QUERY_BYTES:
                flush()
                batch, coded, weight = [], [], 0
        if batch:
            flush()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        new = []
        for p in set().union(*cut) - self.young.keys():
            if len(p) > LONG:  # not remembered
                continue
            have = self.old.get(p)
            if have is None:
                new.append(p)
            else:
                self.young[p] = have
        self._learn(new)
        get = self.young.__getitem__
        return [b"".join([get(p) if len(p) <= LONG else self.encode_long(p.encode()) for p in c]) for c in cut]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids, by an ordered aggregate."""
        ids = [np.frombuffer(c, "<u4") for c in coded]
        size = np.array([len(i) for i in ids], np.int64)
        if not size.sum():
            return [b""] * len(ids)
        flat = np.concatenate(ids)
        if int(flat.max()) >= self.size:
            raise ValueError(f"id {int(flat.max())} is not in the vocabulary")
        start = np.cumsum(size) - size
        self.db.register("ids", pa.table({
            "w": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), size)),
            "p": pa.array((np.arange(len(flat)) - np.repeat(start, size)).astype(np.int32)),
            "t": pa.array(flat.astype(np.int32))}))
        rows = self.db.execute(_DECODE).fetchall()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for w, s in rows:
            out[w] = s.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a worker process and vocabulary, until another operator runs there."""
    W.KEPT["byte_bpe"] = codec.cache_clear
    return Codec(rank_file, pattern)


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("__text").to_pylist()]


def encode(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, check: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array<int>); with ``check`` also what the ids decode to.

    ``check`` adds ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the decoded bytes), both in lowercase hex.
    """
    added = ["n_tokens", "ids", *(["ids_sha256", "decoded_sha256"] if check else [])]
    own = docs.drop(*[c for c in docs.columns if c.lower() in added])
    framed = own.withColumn("__text", column(docs, "text", "string"))
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, kinds[c]) for c in added)])
    names = schema.names
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path or default_path()))
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for b in batches:
            for part in W.slices(b, "__text", owner="byte_bpe"):
                ids = coder.encode(_texts(part))
                size = np.array([len(i) // 4 for i in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                out = [*part.columns[:-1], pa.array(size), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), flat)]
                if check:
                    back = coder.decode(ids)
                    out += [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, back)]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return framed.mapInArrow(run, schema)


def decode(coded: DataFrame, rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``coded`` (``ids`` array<int>, more) with ``decoded`` (binary). Null ids: no bytes."""
    own = coded.drop("decoded")
    framed = own.withColumn("__ids", column(coded, "ids", "array<int>"))
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.BinaryType())])
    names = schema.names
    ranks = coded.sparkSession.sparkContext.broadcast(load_ranks(rank_path or default_path()))
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.array(x or [], "<u4").tobytes() for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(coder.decode(ids), pa.binary())], names=names)

    return framed.mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` encoded, and its ids decoded."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
