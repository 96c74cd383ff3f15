"""Hand-made ARC files, and archives as other readers see them."""

import gzip
import zlib
from pathlib import Path

import pytest

from railside.llm import warc


def _arc(version: int, *records: bytes) -> bytes:
    body = f"{version} 0 maker\n{warc.FIELDS[version]}\n\n".encode()
    extra = b" 200 - - 0 x.arc" if version == 2 else b""
    return b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain" + extra + b" %d\n" % len(body) + body + b"".join(records)


def test_header_lines_of_both_versions():
    old = b"http://a/b c 1.2.3.4 19970203 text/html 5\nab\ncd\n"
    empty = b"http://e 1.2.3.4 199702030405 image/gif 0\n\n"
    got = list(warc.read_arc(_arc(1, old, empty)))
    assert [(r["url"], r["payload"], r["mime"]) for r in got] == [("http://a/b c", b"ab\ncd", "text/html"), ("http://e", b"", "image/gif")]
    assert [warc.timestamp(r["captured"]) for r in got] == ["1997-02-03T00:00:00Z", "1997-02-03T04:05:00Z"]
    block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody"
    new = b"http://a 1.2.3.4 19970203040506 text/html 200 sum - 99 x.arc %d\n" % len(block) + block + b"\n"
    (only,) = warc.read_arc(_arc(2, new))
    assert (only["url"], only["payload"], only["version"]) == ("http://a", b"body", 2) and only["head"].endswith(b"\r\n\r\n")


def test_broken_archives_are_told():
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.read_arc(_arc(1, b"http://a 1.2.3.4 1997 text/html 50\nshort\n")))
    with pytest.raises(ValueError, match="not an ARC header line"):
        list(warc.read_arc(_arc(1, b"no header\n")))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.read_arc(b"http://a 1.2.3.4 1997 text/html 0\n"))


def _members(data: bytes) -> list[bytes]:
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        assert d.eof
        data = d.unused_data
    return out


def test_a_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(5, "http://five", "same"), (3, "http://three", "same"), (4, "http://four", None), (None, "http://none", "same"), (9, "http://nine", "ab")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.convert_pages(pages, path=str(tmp_path / "w")).collect()}
    assert got == {3: ("response", None), 4: ("response", None), 5: ("revisit", 3), 9: ("response", None), None: ("response", None)}
    files = [p.read_bytes() for p in Path(tmp_path / "w").glob("part-*") if p.stat().st_size]
    headers = {}
    for data in files:
        members = _members(data)
        read = [list(warc.read_warc(m)) for m in members]
        assert all(len(m) == 1 for m in read) and read[0][0][0]["warc-type"] == "warcinfo"
        assert gzip.decompress(data) == b"".join(members)
        headers |= {h["warc-record-id"]: h for ((h, _),) in read}
    assert len(headers) == 5 + len(files)
    (again,) = (h for h in headers.values() if h["warc-type"] == "revisit")
    first = headers[again["warc-refers-to"]]
    assert (first["warc-target-uri"], first["warc-date"]) == (again["warc-refers-to-target-uri"], again["warc-refers-to-date"]) == ("http://three", "2024-01-01T00:00:00Z")
    least = {r.page_id: r.record_type for r in warc.convert_pages(pages, least=5).collect()}
    assert set(least.values()) == {"response"}


def test_members_above_16_mb():
    data = bytes(17 << 20)
    assert gzip.decompress(warc._member(data) + b"\0") == data
    assert _members(warc._member(b"abc") + b"\0") == [b"abc"]
