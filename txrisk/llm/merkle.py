"""Merkle manifest of a table, its trees stored in van Emde Boas layout.

Method. Rows become leaves (SHA-256 of their fields). Each group's leaves, in order, are cut into aligned blocks of
``FANOUT ** LEVELS`` leaves. A block is the whole subtree above its leaves, stored as one byte string in van Emde Boas
order: a tree of ``h`` rows of nodes is split at half height into a top tree and its bottom trees, each stored
contiguously and split again. :func:`address` computes a node's place from its depth and index; construction writes
and sibling retrieval reads through it. The block roots are the leaves of the next layer of blocks, until a group has
one block; the groups' roots form one more tree of the same kind.

1. Leaves are hashed in the scan; only digests, ids and group names are shuffled, by range of (group, id), so that
   a group with most of the rows is spread over all tasks. Rows a task and group give each row its rank.
2. Blocks of a layer are built by tasks that hold one block at a time. Layers are written to the shared folder.
3. Paths go down from the root: each block gets the siblings above its root once, and its leaves add their own.

The driver sees the number of layers and the root, nothing that grows with the rows.

Cases. Null fields hash as ``-``. A null group is a group of its own, before all others. Null ids come last in their
group. Rows equal in group and id are ordered by their leaves; fully equal rows are leaves of their own. A group of
one row has its leaf as subroot; one group's subroot is the root. An empty table has no rows and no root. Texts of
any length are hashed by Spark without being copied to Python. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import column, keep, read, ready

#: Children of a node.
FANOUT = 8
#: Levels that one block folds: 4096 leaves a block.
LEVELS = 4
#: Fields of a leaf, in order.
FIELDS = (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))
_HEX = 64


def node(parts: list[bytes] | bytes) -> bytes:
    """Lowercase hex SHA-256 of the concatenated inputs."""
    return hashlib.sha256(parts if isinstance(parts, bytes) else b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


# ---------------------------------------------------------------- layout


def tree_size(rows: int, fanout: int = FANOUT) -> int:
    """Nodes of a complete tree with ``rows`` rows of nodes."""
    return (fanout**rows - 1) // (fanout - 1)


def address(rows: int, depth: int, index: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Places of the nodes ``index`` of row ``depth`` (root: 0) of a complete tree with ``rows`` rows."""
    if rows == 1:
        return np.zeros_like(index)
    top = rows // 2
    if depth < top:
        return address(top, depth, index, fanout)
    below = rows - top
    width = fanout ** (depth - top)
    return tree_size(top, fanout) + index // width * tree_size(below, fanout) + address(below, depth - top, index % width, fanout)


@lru_cache(maxsize=16)
def _places(rows: int) -> list[np.ndarray]:
    """Addresses of every row of nodes, from the leaves up."""
    return [address(rows, d, np.arange(FANOUT**d)) for d in range(rows - 1, -1, -1)]


def height(n: int, levels: int) -> int:
    """Levels that a block of a layer with ``n`` nodes folds: all when one block holds them, else ``levels``."""
    h = 0
    while h < levels and FANOUT**h < n:
        h += 1
    return h


def fold_block(leaves: list[bytes], h: int) -> tuple[bytes, bytes]:
    """The block's nodes in van Emde Boas order, and its root."""
    places = _places(h + 1)
    out = np.zeros(tree_size(h + 1), dtype=f"S{_HEX}")
    row = leaves
    out[places[0][: len(row)]] = row
    for level in range(1, h + 1):
        row = [node(row[i : i + FANOUT]) for i in range(0, len(row), FANOUT)]
        out[places[level][: len(row)]] = row
    return out.tobytes(), row[0]


class Block:
    """Sibling retrieval from a stored block of ``m`` leaves folding ``h`` levels."""

    def __init__(self, stored: bytes, m: int, h: int):
        nodes = np.frombuffer(stored, dtype=f"S{_HEX}")
        places = _places(h + 1)
        self.h = h
        self.rows = [nodes[places[level][: -(-m // FANOUT**level)]].tolist() for level in range(h + 1)]

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """Siblings to the left and to the right of leaf ``i``, level by level."""
        out = []
        for row in self.rows[: self.h]:
            start = i - i % FANOUT
            out.append((b"".join(row[start:i]), b"".join(row[i + 1 : start + FANOUT])))
            i //= FANOUT
        return out


def pack(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level the numbers of left and right siblings, then their digests."""
    return b"".join(bytes((len(a) // _HEX, len(b) // _HEX)) + a + b for a, b in path)


def unpack(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        a, b = data[at] * _HEX, data[at + 1] * _HEX
        at += 2
        out.append((data[at : at + a], data[at + a : at + a + b]))
        at += a + b
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that ``leaf`` and its siblings give."""
    for a, b in path:
        leaf = node(a + leaf + b)
    return leaf


# ---------------------------------------------------------------- Spark


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row within its key's rows of this task (rows sorted by key)."""
    last, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column("key"))
        ends = runs.run_ends.to_numpy()
        keys = runs.values
        starts = np.r_[0, ends[:-1]]
        pos = np.arange(b.num_rows) - np.repeat(starts, ends - starts)
        if keys[0].as_py() == last:
            pos[: ends[0]] += count
        last, count = keys[len(keys) - 1].as_py(), int(pos[-1]) + 1
        yield b.set_column(b.schema.get_field_index("pos"), "pos", pa.array(pos))


def ranked(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``n`` within ``key``, counted by ranges of (key, order); no key meets in one task."""
    ready(df.sparkSession)
    placed = df.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = placed.withColumns({"part": F.spark_partition_id(), "pos": F.lit(0).cast("long")})
    placed = keep(placed.mapInArrow(_positions, placed.schema), name)
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    offsets = counts.select("key", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    return placed.join(offsets, ["key", "part"]).withColumn("rank", F.col("pos") + F.col("before")).drop("part", "pos", "before")


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, rank): one row a block, built once its last leaf came."""
    names = ["key", "block", "n", "m", "nodes", "root", "ids", "claims"]
    held: list[list] = []

    def done() -> pa.RecordBatch:
        key, block, n = held[0][:3]
        h = height(n, levels)
        nodes, root = fold_block([r[3].encode() for r in held], h)
        cells = [key, block, n, len(held), nodes, root.decode(), [r[4] for r in held], [r[5] for r in held]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    for b in batches:
        cells = [b.column(c).to_pylist() for c in ("key", "block", "n", "digest", "doc_id", "claimed")]
        for row in zip(*cells, strict=True):
            if held and (held[0][1] != row[1] or held[0][0] != row[0]):
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def _layers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Written layers of blocks over ``leaves`` (key, rank, n, digest, doc_id, claimed), the lowest first."""
    size = FANOUT**levels
    layers, nodes = [], leaves
    while True:
        cut = nodes.withColumn("block", F.floor(F.col("rank") / size).cast("long"))
        sorted_ = cut.repartition("key", "block").sortWithinPartitions("key", "block", "rank")
        made = sorted_.select("key", "block", "n", "digest", "doc_id", "claimed").mapInArrow(
            lambda b: _blocks(b, levels), "key string, block long, n long, m int, nodes binary, root string, ids array<long>, claims array<string>")
        layers.append(keep(made, "merkle"))
        more = layers[-1].where(F.col("n") > size)
        if more.isEmpty():
            return layers
        nodes = more.select("key", F.col("block").alias("rank"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("digest"),
                            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claimed"))


def _member_paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them: one row for each leaf of a block, with its path."""
    for b in batches:
        for r in b.to_pylist():
            block = Block(r["nodes"], r["m"], height(r["n"], levels))
            first = r["block"] * FANOUT**levels
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"]] * r["m"], pa.string()), pa.array(np.arange(first, first + r["m"])),
                 pa.array([pack(block.path(i)) + r["path"] for i in range(r["m"])], pa.binary()), pa.array([r["subroot"]] * r["m"], pa.string())],
                names=["key", "rank", "path", "subroot"])


def _down(layers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Paths of the lowest layer's blocks (key, block, path, subroot), from those of each key's root (``tops``: key, path, subroot)."""
    size = FANOUT**levels
    paths = None
    for at in range(len(layers) - 1, -1, -1):
        here = layers[at].where(F.col("n") <= size).select("key", "block").join(tops, "key")
        paths = here if paths is None else paths.unionByName(here)
        if at:
            above = layers[at].join(paths, ["key", "block"])
            paths = above.select("key", "block", "n", "m", "nodes", "path", "subroot").mapInArrow(
                lambda b: _member_paths(b, levels), "key string, rank long, path binary, subroot string").withColumnRenamed("rank", "block")
    return paths


def _proofs(batches: Iterator[pa.RecordBatch], levels: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row a leaf: its proof, and the root that its claimed digest folds to."""
    for b in batches:
        for r in b.to_pylist():
            block = Block(r["nodes"], r["m"], height(r["n"], levels))
            above = unpack(r["path"])
            tail = b"".join(x + y for x, y in above)
            leaf, proof, folded, paths = [], [], [], []
            for i, claimed in enumerate(r["claims"]):
                path = block.path(i)
                digest = block.rows[0][i]
                leaf.append(digest.decode())
                proof.append(node(b"".join(x + y for x, y in path) + tail).decode())
                folded.append(fold(fold(claimed.encode() if claimed else digest, path), above).decode())
                if "path" in names:
                    paths.append(pack(path) + r["path"])
            out = [pa.array([r["key"]] * r["m"], pa.string()), pa.array(r["ids"], pa.int64()), pa.array(leaf), pa.array([r["subroot"]] * r["m"]), pa.array(proof), pa.array(folded)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(paths, pa.binary())] if paths else out, names=names)


def manifest(leaves: DataFrame, levels: int = LEVELS, with_paths: bool = False) -> DataFrame:
    """Proofs for ``leaves``: grp (string), doc_id (long), leaf (hex digest) and claimed (hex digest to verify; null: the leaf).

    Returns grp, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with ``with_paths`` also the path
    (:func:`unpack` gives the siblings of each level).
    """
    # group names in the order of their bytes, a null group first
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("leaf").alias("digest"), F.col("claimed"))
    # the texts are read once: sampling for the ranges reads the digests only
    keyed = keep(keyed, "leaves")
    rows = ranked(keyed, [F.col("doc_id").asc_nulls_last(), F.col("digest")], "ranked")
    layers = _layers(rows, levels)
    size = FANOUT**levels
    subroots = None
    for layer in layers:
        here = layer.where(F.col("n") <= size).select("key", "root")
        subroots = here if subroots is None else subroots.union(here)
    subroots = keep(subroots, "subroots")
    groups = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("grp"), F.col("root").alias("digest")), ["grp"], "groups")
    groups = keep(groups, "groups")
    top = _layers(groups.select("key", "rank", "n", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claimed")), levels)
    last = top[-1].first()
    root = last["root"] if last else None
    none = leaves.sparkSession.createDataFrame([("", b"", root or "")], "key string, path binary, subroot string")
    upper = _down(top, none, levels)
    members = top[0].join(upper, ["key", "block"]).select("key", "block", "n", "m", "nodes", "path", "subroot").mapInArrow(
        lambda b: _member_paths(b, levels), "key string, rank long, path binary, subroot string")
    tops = groups.join(members.select("rank", "path"), "rank").select(F.col("grp").alias("key"), "path", F.col("digest").alias("subroot"))
    paths = _down(layers, keep(tops, "tops"), levels)
    names = ["key", "doc_id", "leaf", "subroot", "proof_sha256", "folded_root", *(["path"] if with_paths else [])]
    out = layers[0].join(paths, ["key", "block"]).select("key", "block", "n", "m", "nodes", "ids", "claims", "path", "subroot").mapInArrow(
        lambda b: _proofs(b, levels, names),
        "key string, doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" + (", path binary" if with_paths else ""))
    grp = F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias("grp")
    return out.select(grp, "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"), *(["path"] if with_paths else []))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs`` by ``lang``; every third id (by CRC-32) claims the digest of its text with A-Z lower-cased."""
    cells = {name: column(docs, name, kind) for name, kind in FIELDS}
    lower = F.translate(cells["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[field(text if name == "text" else cells[name]) for name, _ in FIELDS]).cast("binary"), 256)

    chosen = F.crc32(cells["doc_id"].cast("string").cast("binary")) % 3 == 0
    return docs.select(cells["lang"].alias("grp"), cells["doc_id"].alias("doc_id"), leaf(cells["text"]).alias("leaf"),
                       F.when(chosen, leaf(lower)).alias("claimed"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a leaf, its proof, and the check of a possibly tampered row against the root."""
    return manifest(document_leaves(read(spark, sf_dir, "documents"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def brute_force(rows: list[tuple]) -> dict[int, tuple]:
    """Results by doc_id for rows (doc_id, source, lang, n_chars, text) by plain lists (for tests; ids unique, not null)."""
    import zlib

    def leaf(row) -> str:
        return node("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).decode()

    def tree(nodes: list[str]) -> tuple[str, list[list]]:
        """Root, and for each node its siblings as (left, right) by level."""
        paths, own, width = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(width) > 1:
            for p, i in zip(paths, own, strict=True):
                s = i - i % FANOUT
                p.append(("".join(width[s:i]), "".join(width[i + 1 : s + FANOUT])))
            own = [i // FANOUT for i in own]
            width = [node("".join(width[i : i + FANOUT]).encode()).decode() for i in range(0, len(width), FANOUT)]
        return width[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted(r for r in rows if r[2] == x) if x is not None else sorted((r for r in rows if r[2] is None), key=lambda r: r[0]) for x in langs}
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    if not rows:
        return {}
    root, tops = tree([trees[x][0] for x in langs])
    out = {}
    for x, above in zip(langs, tops, strict=True):
        for r, path in zip(groups[x], trees[x][1], strict=True):
            path = path + above
            proof = node("".join(a + b for a, b in path).encode()).decode()
            now = leaf(r)
            if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                now = node((a + now + b).encode()).decode()
            out[r[0]] = (leaf(r), trees[x][0], root, proof, now, now == root)
    return out


_FIELD_SQL = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(name) for name, _ in FIELDS[:-1]) + " || " + _FIELD_SQL.replace("{0}", "{text}") + ")"
#: DuckDB has no CRC-32: the recursive table holds it bit by bit over the digits of each id.
ORACLE_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
table0 AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table0 WHERE k < 8),
crc_table AS (SELECT i, c FROM table0 WHERE k = 8),
crc(doc_id, s, p, c) AS (SELECT doc_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT doc_id, s, p + 1, xor(t.c, crc.c >> 8) FROM crc JOIN crc_table t ON t.i = xor(crc.c, ascii(substr(s, p + 1, 1))::BIGINT) & 255 WHERE p < length(s)),
chosen AS (SELECT doc_id FROM crc WHERE p = length(s) AND xor(c, 4294967295) % 3 = 0),
leaves AS (SELECT d.doc_id, lang, {_LEAF_SQL.format(text="text")} AS leaf, CASE WHEN chosen.doc_id IS NULL THEN {_LEAF_SQL.format(text="text")}
    ELSE {_LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now
  FROM (SELECT doc_id, source, lang, n_chars, text FROM documents) d LEFT JOIN chosen USING (doc_id)),
numbered AS (SELECT *, coalesce('=' || lang, '') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(k, level, pos, h, n) AS (SELECT k, 0, pos, leaf, n FROM numbered
  UNION ALL SELECT k, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY k, pos // 8),
subroots AS (SELECT k, level, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, h, n) AS (SELECT 0, pos, subroot, n FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY pos // 8),
sides AS (SELECT k, level, pos, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM nodes WINDOW w AS (PARTITION BY k, level, pos // 8 ORDER BY pos)),
topsides AS (SELECT level, pos, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM tops WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
steps(doc_id, leaf, k, now, level, pos, height, toppos, sib, subroot) AS (
  SELECT doc_id, leaf, k, now, 0, x.pos, s.level, s.pos, '', s.subroot FROM numbered x JOIN subroots s USING (k)
  UNION ALL SELECT doc_id, leaf, steps.k, sha256(coalesce(l.l, '') || now || coalesce(l.r, '')), steps.level + 1, steps.pos // 8, height, toppos,
    sib || coalesce(l.l, '') || coalesce(l.r, ''), subroot
  FROM steps JOIN sides l ON l.k = steps.k AND l.level = steps.level AND l.pos = steps.pos WHERE steps.level < height),
summit AS (SELECT level AS height, h AS root FROM tops WHERE n = 1),
climb(doc_id, leaf, now, level, pos, sib, subroot) AS (
  SELECT doc_id, leaf, now, 0, toppos, sib, subroot FROM steps WHERE level = height
  UNION ALL SELECT doc_id, leaf, sha256(coalesce(l.l, '') || now || coalesce(l.r, '')), climb.level + 1, climb.pos // 8, sib || coalesce(l.l, '') || coalesce(l.r, ''), subroot
  FROM climb JOIN topsides l ON l.level = climb.level AND l.pos = climb.pos WHERE climb.level < (SELECT height FROM summit))
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, now AS folded_root, now = root AS verified
FROM climb, summit WHERE climb.level = summit.height
"""
