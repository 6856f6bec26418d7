"""Legacy ARC archives converted to WARC, written, and read back.

Method. An ARC file opens with a version block (``filedesc://``) that names the fields of its header
lines: version 1 has URL, IP, date, type and length; version 2 adds result code, checksum, location,
offset and file name. Each record's header line is parsed by its file's field list and its block
taken by the declared length. The equivalent WARC record gets an identifier derived from the
record (UUID version 5, so a rerun gives the same), an ISO date, a type and SHA-1 digests.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest page id
stays a ``response``; the others become ``revisit`` records that name it and hold no payload. This is
settled on (digest, page id) rows alone; payloads are not shuffled by digest, so a payload that
a third of all pages share is no hot key.

Records are parsed from their ARC files once and kept in the shared folder; digests and revisits come from
columns of that table without the payloads.

Each record is a gzip member of its own, as WARC asks. A task gathers members to files of at most ``FILE_BYTES``
of raw records (a longer record has a file to itself) or ``per_file`` records, and hands each file as one row to Spark's text
writer, one row a file. That writer ends a row with a separator: here the zero byte that ends every gzip member of less
than 16 MB (the top byte of its length; an empty member follows a longer one). Files are read with Spark's binaryFile
source, record after record, so a task holds one compressed file and some MB of records. Any store that Spark reaches will do.

Cases. Null html: empty payload, type response. Null url: ``urn:null``; blanks and control
characters in a url are percent-encoded in header lines. Null page_id: no revisit names it, and it
revisits like any other. Repeated rows: all rows with the largest page id of a digest are responses.
An empty table gives no records. A malformed ARC header or length raises an error naming the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, drop_kept, keep, read, ready, shared_path

MIN_REVISIT = 1000
PER_FILE = 5_000
#: Bytes of raw records in a file.
FILE_BYTES = 32 << 20
_NAMESPACE = uuid.UUID("5e2b5c0a-7d2e-4c8e-9d64-3f0a1c7b9e11")
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "page_id long, uri string, ip string, date string, http binary, payload binary, payload_digest string"


# ---- reading ARC ---------------------------------------------------------------------------------

def parse_arc(content: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one ARC file, the version block excepted."""
    at, fields = 0, _FIELDS[1].split()
    while at < len(content):
        stop = content.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"{name}: header line without an end at byte {at}")
        line = content[at:stop].decode("utf-8", "surrogateescape").rstrip("\r")
        at = stop + 1
        if not line:
            continue
        values = line.split(" ")
        opening = line.startswith("filedesc://")
        names = _FIELDS[1].split() if opening and len(values) == 5 else _FIELDS[2].split() if opening else fields
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{name}: header line does not have the fields {names}: {line[:200]!r}")
        size = int(values[-1])
        if at + size > len(content):
            raise ValueError(f"{name}: a record declares {size} bytes, {len(content) - at} are left")
        block = content[at : at + size]
        at += size
        if opening:
            lines = block.decode("ascii", "replace").splitlines()
            version = int(lines[0].split(" ")[0]) if lines else 1
            if version not in _FIELDS:
                raise ValueError(f"{name}: ARC version {version} is not known")
            fields = lines[1].split(" ") if len(lines) > 1 else _FIELDS[version].split()
            continue
        yield dict(zip(names, values, strict=True)), block


def _http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    stop = block.find(b"\r\n\r\n")
    return (block[: stop + 4], block[stop + 4:]) if stop >= 0 else (block, b"")


def _page_id(http: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", http)
    return int(found[1]) if found else None


def convert_arc(archives: DataFrame) -> DataFrame:
    """Records of ARC files (``name``, ``content``), one row each, ready for :func:`write_warc`."""
    names = ["page_id", "uri", "ip", "date", "http", "payload", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                rows = []
                for head, block in parse_arc(content.as_py() or b"", name or "?"):
                    http, payload = _http_parts(block)
                    d = head["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((_page_id(http), head["URL"], head["IP-address"], date, http, payload, hashlib.sha1(payload).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    ready(archives.sparkSession)
    return archives.select("name", "content").mapInArrow(run, RECORD)


# ---- writing and reading WARC --------------------------------------------------------------------

def with_revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a record revisits, else null."""
    size = F.col("payload_bytes") if "payload_bytes" in records.columns else F.length("payload")
    narrow = records.where(size >= min_revisit).select("payload_digest", "page_id", size.alias("n"))
    last = narrow.groupBy("payload_digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    last = last.where("copies > 1").drop("copies")
    # page_id -> response, for revisiting rows only; a page id may occur with several payloads
    earlier = narrow.join(last, ["payload_digest", "n"]).where("page_id is null or page_id < refers_to")
    earlier = earlier.select("payload_digest", F.col("page_id").alias("__id"), "refers_to").distinct()
    return records.join(earlier.withColumnRenamed("payload_digest", "__digest"),
                        F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left").drop("__id", "__digest")


def _base32(hexes: str) -> str:
    return base64.b32encode(bytes.fromhex(hexes)).decode()


def warc_record(page_id: int | None, uri: str, ip: str, date: str, http: bytes, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record without the two line ends that close it."""
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda page: uuid.uuid5(_NAMESPACE, f"{page} {digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest} {uri} {date}') if revisit else name(page_id)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response" if http else "Content-Type: application/octet-stream",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def member(record: bytes) -> bytes:
    """``record`` as a gzip member; its last byte is zero."""
    packed = gzip.compress(record, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write records (columns of ``RECORD`` and ``refers_to``) as gzipped WARC files under ``path``."""
    cols = ["page_id", "uri", "ip", "date", "http", "payload", "payload_digest", "refers_to"]

    def file(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])  # the writer adds the zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        weight = 0
        for b in batches:
            for row in zip(*b.columns, strict=True):
                record = warc_record(*(cell.as_py() for cell in row)) + b"\r\n\r\n"
                if members and (weight + len(record) > file_bytes or len(members) >= per_file):
                    yield file(members)
                    members, weight = [], 0
                members.append(member(record))
                weight += len(record)
        if members:
            yield file(members)

    ready(records.sparkSession)
    files = records.select(*cols).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_warc(content: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file, gzipped or not."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw
    at = 0
    try:
        while line := stream.readline():
            start = at
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record header at byte {start}")
            head: dict[str, str] = {}
            while True:
                at += len(line)
                line = stream.readline()
                if not line.endswith(b"\n"):
                    raise ValueError(f"{name}: the header at byte {start} has no end")
                if line == b"\r\n":
                    break
                key, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
                head[key.lower()] = value
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) < size or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: the record at byte {start} does not end where it says")
            at += 2 + size + 4
            yield head, block
    except (EOFError, zlib.error, gzip.BadGzipFile) as exc:
        raise ValueError(f"{name}: not a whole gzip file: {exc}") from exc


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: type, uri, page ids, digest, payload."""
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "uri": pa.string(), "date": pa.string(), "page_id": pa.int64(),
             "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def row(head: dict[str, str], block: bytes) -> tuple:
        payload = _http_parts(block)[1]
        kind, whole = head["warc-type"], int(head["warc-payload-length"])
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind == "response" and (len(payload) != whole or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
        number = lambda k: int(head[k]) if k in head else None
        return (head["warc-record-id"], kind, head["warc-target-uri"], head["warc-date"], number("x-page-id"),
                number("x-refers-to-page"), whole, digest, payload if kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows: list[tuple] = []
                weight = 0
                for head, block in parse_warc(content.as_py(), name):
                    rows.append(row(head, block))
                    weight += len(block)
                    if weight > 4 << 20:
                        yield out(rows)
                        rows, weight = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "record_id string, record_type string, uri string, date string, page_id long, refers_to long, "
                                 "payload_bytes long, payload_digest string, payload binary")


# ---- the query -----------------------------------------------------------------------------------

def _safe_uri(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) or "urn:empty" if uri is not None else "urn:null"


def arc_archives(pages: DataFrame) -> DataFrame:
    """Stand-in input: ``pages`` as ARC files of some MB, version 1 and 2 in turn (``name``, ``content``)."""
    def record(version: int, page: int | None, url: str | None, html: str | None) -> bytes:
        payload = (html or "").encode()
        id_ = f"X-Page-Id: {page}\r\n" if page is not None else ""
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{id_}\r\n".encode() + payload
        more = " 200 - - 0 pages.arc" if version == 2 else ""
        return f"{_safe_uri(url)} 192.0.2.1 20240102030405 text/html{more} {len(block)}\n".encode() + block + b"\n"

    def opening(version: int) -> bytes:
        body = f"{version} 0 Stand-in\n{_FIELDS[version]}\n".encode()
        more = " 200 - - 0 pages.arc" if version == 2 else ""
        return f"filedesc://pages.arc 192.0.2.1 20240102030405 text/plain{more} {len(body)}\n".encode() + body + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            cells: list[bytes] = []
            weight = 0
            for page, url, html in zip(*(c for c in b.columns), strict=True):
                version = 1 + n % 2
                cells.append(record(version, page.as_py(), url.as_py(), html.as_py()))
                weight += len(cells[-1])
                if weight > 2 << 20:
                    yield arc(version, cells)
                    cells, weight, n = [], 0, n + 1
            if cells:
                yield arc(1 + n % 2, cells)
                n += 1

    def arc(version: int, cells: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["pages.arc"]), pa.array([opening(version) + b"".join(cells)], pa.binary())], names=["name", "content"])

    own = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"),
                       column(pages, "html", "string").alias("html"))
    return own.mapInArrow(run, "name string, content binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an ARC file into a WARC file, and what the WARC files then hold."""
    converted = convert_arc(arc_archives(read(spark, sf_dir, "pages")))
    records = keep(converted.withColumn("payload_bytes", F.length("payload")), "records", "zstd")
    path = shared_path(spark, "warc")
    write_warc(with_revisits(records), path)
    drop_kept(records)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
