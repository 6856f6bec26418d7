"""Archive files: a gzip member for each record, files by bytes, long records, what does not parse."""

import gzip
import zlib

import pytest

from txrisk.llm import warc

SCHEMA = "page_id long, url string, html string"


def _members(content: bytes) -> list[bytes]:
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        assert d.eof
        content = d.unused_data
    return out


def _written(spark, pages, **kw):
    path = warc.shared_path(spark, "test-files")
    warc.write_warc(warc.with_revisits(warc.convert_arc(warc.arc_archives(pages))), path, **kw)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    return path, [f for f in files if f]


def test_each_record_is_a_member_and_files_are_cut_by_bytes(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 300) for i in range(40)], SCHEMA).coalesce(1)
    path, files = _written(spark, pages, file_bytes=8_000)
    members = [_members(f) for f in files]
    assert len(files) > 3 and sum(map(len, members)) == 40
    for m in members:
        assert sum(map(len, m)) <= 8_000 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in m)
    assert sorted(r.page_id for r in warc.read_warc(spark, path).collect()) == list(range(40))


def test_records_at_the_border_of_the_length_byte(spark):
    html = "x" * (17 << 20)
    pages = spark.createDataFrame([(1, "a", html), (2, "b", "y"), (3, "c", html + "z"), (4, "d", None)], SCHEMA).coalesce(1)
    path, files = _written(spark, pages)
    assert all(f[-1] == 0 for f in files)
    assert {r.page_id: (r.payload_bytes, bytes(r.payload)[-1:]) for r in warc.read_warc(spark, path).collect()} == {
        1: (len(html), b"x"), 2: (1, b"y"), 3: (len(html) + 1, b"z"), 4: (0, b"")}


@pytest.mark.parametrize("size", [0, 1, (1 << 24) - 1, 1 << 24, (1 << 24) + 1])
def test_member_ends_with_zero(size):
    record = b"q" * size
    assert warc.member(record)[-1] == 0 and gzip.decompress(warc.member(record)) == record


def test_empty_table_and_clashing_names(spark):
    path, files = _written(spark, spark.createDataFrame([], SCHEMA))
    assert files == [] and warc.read_warc(spark, path).count() == 0
    more = spark.createDataFrame([(1, "u", "t", "x", "y", 3)], SCHEMA + ", payload string, refers_to string, n int")
    path, _ = _written(spark, more)
    (row,) = warc.read_warc(spark, path).collect()
    assert (row.page_id, bytes(row.payload), row.record_type, row.refers_to) == (1, b"t", "response", None)


def test_what_does_not_parse_names_the_file():
    record = warc.warc_record(1, "u", "ip", "d", b"", b"abc", warc.hashlib.sha1(b"abc").hexdigest(), None) + b"\r\n\r\n"
    assert [b for _, b in warc.parse_warc(record + record, "x")] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse_warc(warc.member(record) + warc.member(record), "x")] == [b"abc", b"abc"]
    assert list(warc.parse_warc(b"", "x")) == []
    for bad in (record[:-5], record[:40], b"oops" + record, warc.member(record)[:-12], warc.member(record) + warc.member(record)[:30]):
        with pytest.raises(ValueError, match="bad.warc"):
            list(warc.parse_warc(bad, "bad.warc"))
