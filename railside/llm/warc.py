"""Legacy ARC archives to WARC.

An ARC file starts with a version block: a ``filedesc://`` line and, in its body, the version and the
names of the fields of later header lines. Records follow: a header line, as many bytes as it
declares, a line feed. The converter reads header lines by the version's field names and bodies by
declared length, and gives each record what WARC asks for: a record id, an ISO timestamp, a type and
digests. Archives are written by Spark's text writer (whole records, committed by task) and read
back as binary files, again by declared lengths. Each record is a gzip member of its own, so that
other readers can seek to it; a file begins with a warcinfo record. (The text writer names files
``part-*.txt``; they hold what a ``.warc.gz`` file holds.)
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.llm.cluster import cut, scratch_path

#: Bytes of one archive, about.
ARCHIVE_BYTES = 8 << 20
#: Bytes of the table of repeated payloads that may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: Field names of ARC header lines by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_CAPTURED = "20240101000000"
RECORD = "page_id long, url string, ip string, captured string, mime string, head binary, payload binary, digest string, n_bytes long, archive string, version int"


def digest_of(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1, as WARC digests use it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    """A URL without the white space and control characters that would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 railside\n{FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {_CAPTURED} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(page_id: int | None, url: str | None, payload: bytes, version: int, name: str, offset: int, captured: str = _CAPTURED) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    extra = f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{arc_url(url)} 0.0.0.0 {captured} text/html{extra} {len(body)}\n".encode() + body + b"\n"


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\n", at)
    return data[at:end].decode("utf-8", "replace").rstrip("\r"), end + 1


def _fields(line: str, names: list[str]) -> dict[str, str]:
    """Split from the right: old archives may have spaces in URLs."""
    parts = line.rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file of version 1 or 2, without its version block."""
    first, at = _line(data, 0)
    if not first.startswith("filedesc://"):
        raise ValueError("an ARC file starts with a filedesc line")
    body = data[at : at + int(first.rsplit(" ", 1)[1])]
    version_line, names_at = _line(body, 0)
    version = int(version_line.split(" ", 1)[0])
    names = _line(body, names_at)[0].split(" ")
    at += len(body)
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        line, at = _line(data, at)
        header = _fields(line, names)
        length = int(header["Archive-length"])
        block = data[at : at + length]
        if len(block) != length:
            raise ValueError(f"the archive ends within a record of {length} bytes")
        at += length
        head, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        yield {"url": header["URL"], "ip": header["IP-address"], "captured": header["Archive-date"], "mime": header["Content-type"], "head": head + mark, "payload": payload, "archive": first.split(" ", 1)[0], "version": version}


def _head_value(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def timestamp(captured: str) -> str:
    """ISO time of an ARC date of 8 to 14 digits; what is missing counts as the earliest."""
    d = (re.sub(r"\D", "", captured) + "00000101000000"[len(re.sub(r"\D", "", captured)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, captured: str, digest: str, page_id: int | None) -> str:
    """The same record gets the same identifier in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {captured} {digest} {page_id}')}>"


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(parts: list[bytes], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

    k, parts, size = 0, [], 0
    name, task = "", TaskContext.get().partitionId()
    for batch in batches:
        for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            if not parts:
                version, name = 1 + k % 2, f"pages-{task:05d}-{k:05d}.arc"
                parts = [arc_version_block(name, version)]
                size = len(parts[0])
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            parts.append(arc_record(page_id.as_py(), url.as_py(), payload, version, name, size))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield emit(parts, name)
                k, parts = k + 1, []
    if parts:
        yield emit(parts, name)


def _rows(schema: pa.Schema, rows: Iterator[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
    """Rows with their bytes, in batches of bounded bytes."""
    waiting, size = [], 0
    for n, row in rows:
        waiting.append(row)
        size += n
        if size >= ARCHIVE_BYTES or len(waiting) >= 10_000:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("captured", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("version", pa.int32())])


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for content in batch.column(0):
                for r in read_arc(content.as_py()):
                    own = _head_value(r["head"], b"X-Page-Id")
                    yield len(r["payload"]), r | {"page_id": int(own) if own else None, "digest": digest_of(r["payload"]), "n_bytes": len(r["payload"])}

    yield from _rows(_RECORD, rows())


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """name, content: ARC files of bounded size, of versions 1 and 2 by turns, from page rows."""
    chosen = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return chosen.mapInArrow(_to_arc, "name string, content binary")


def arc_records(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of ARC files held as bytes (``spark.read.format("binaryFile")`` reads such)."""
    return archives.select(content_col).mapInArrow(_from_arc, RECORD)


def _warc(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warc_info(record: dict, task: int) -> bytes:
    """The record that a file begins with, dated as the first of those that follow."""
    rid = record_id("warcinfo", record["captured"], record["digest"], task)
    block = b"software: railside\r\nformat: WARC File Format 1.1\r\n"
    return _warc(["WARC-Type: warcinfo", f"WARC-Record-ID: {rid}", f"WARC-Date: {timestamp(record['captured'])}", "Content-Type: application/warc-fields"], block)


def _warc_text(record: dict, first: dict | None) -> bytes:
    """A record, as a revisit of ``first`` (page_id, url, captured of the same payload's response) if it is given."""
    rid = record_id(record["url"], record["captured"], record["digest"], record["page_id"])
    block = record["head"] if first else record["head"] + record["payload"]
    kind = "revisit" if first else "response" if record["head"] else "resource"
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Date: {timestamp(record['captured'])}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha1:{record['digest']}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"Content-Type: {'application/http; msgtype=response' if record['head'] else record['mime']}",
    ]
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first['url'], first['captured'], record['digest'], first['page_id'])}",
            f"WARC-Refers-To-Target-URI: {first['url']}",
            f"WARC-Refers-To-Date: {timestamp(first['captured'])}",
            f"WARC-Refers-To-Page: {first['page_id']}",
        ]
    return _warc(lines, block)


def _member(data: bytes) -> bytes:
    """A gzip member without its last byte, a zero, which the writer adds as its line end.

    A member ends with its size in four bytes, low byte first: the last one is zero below 16 MB. A
    larger one is followed by an empty member.
    """
    packed = gzip.compress(data, 6, mtime=0)
    if packed[-1]:
        packed += gzip.compress(b"", mtime=0)
    return packed[:-1]


def _write_form(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = pa.schema([("value", pa.binary())]), TaskContext.get().partitionId()

        def texts() -> Iterator[bytes]:
            empty = True
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    if empty:
                        yield _warc_info(r, task)
                        empty = False
                    first = r.pop("first")
                    again = first is not None and r["page_id"] not in (None, first["page_id"]) and r["n_bytes"] >= least
                    yield _warc_text(r, first if again else None)

        yield from _rows(schema, ((len(m), {"value": m}) for m in map(_member, texts())))

    return run


def write_warc(records: DataFrame, path: str, least: int = 0) -> None:
    """Write WARC files from ``arc_records`` rows, each record compressed by itself.

    Of records with equal payloads of at least ``least`` bytes, that with the smallest page id is the
    response and others revisit it, naming its record id, URL, date and page. Payloads are equal when
    length and SHA-1 are. A record without a page id is always a response. The rows are computed twice:
    for the digests, and to be written; a copy kept in between would cost as much disk as the archives.
    """
    whose = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "captured"))
    sums = records.select("digest", "n_bytes", whose.alias("whose")).groupBy("digest", "n_bytes").agg(F.min("whose").alias("first"), F.count("*").alias("n"))
    sums = cut(sums)
    total = sums.agg(F.sum(F.col("n") * (F.col("n_bytes") + 600))).first()[0] or 0
    again = cut(sums.where("n > 1").select("digest", "n_bytes", "first"))
    width = again.agg(F.sum(120 + F.coalesce(F.octet_length("first.url"), F.lit(0)))).first()[0] or 0
    known = records.join(F.broadcast(again) if width <= BROADCAST_BYTES else again, ["digest", "n_bytes"], "left")
    files = max(1, -(-total // ARCHIVE_BYTES))
    dealt = known.repartition(files, F.xxhash64("page_id", "url", "digest"))
    members = dealt.mapInArrow(_write_form(least), "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by declared length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError("the archive ends within a header")
            return
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(header["content-length"])
        if at > len(data):
            raise ValueError("the archive ends within a block")
        yield header, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record ends with two line breaks")
        at += 4


def _members(data: bytes, piece: int = 4096) -> Iterator[bytes]:
    """What each gzip member holds. Bytes go in by pieces, so that no member copies all that follow it."""
    at, parts, member = 0, [], zlib.decompressobj(31)
    while at < len(data):
        given = data[at : at + piece]
        parts.append(member.decompress(given))
        at += len(given) - len(member.unused_data)
        if member.eof:
            yield b"".join(parts)
            parts, member = [], zlib.decompressobj(31)
    if parts:
        raise ValueError("the archive ends within a gzip member")


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string())])


def _read_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                members = _members(data) if data[:2] == b"\x1f\x8b" else [data]
                for header, block in chain.from_iterable(map(read_warc, members)):
                    kind = header["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    own, told = _head_value(head + mark, b"X-Page-Id"), _head_value(head + mark, b"Content-Length")
                    named = header["warc-payload-digest"].partition(":")[2]
                    if kind != "revisit" and digest_of(payload) != named:
                        raise ValueError(f"payload digest of {header['warc-record-id']} differs")
                    first = header.get("warc-refers-to-page")
                    yield 200, {
                        "page_id": int(own) if own else None,
                        "payload_bytes": int(told or 0) if kind == "revisit" else len(payload),
                        "payload_digest": named,
                        "record_type": "revisit" if kind == "revisit" else "response",
                        "refers_to": int(first) if first else None,
                        "record_id": header["warc-record-id"],
                        "warc_date": header["warc-date"],
                        "target_uri": header["warc-target-uri"],
                    }

    yield from _rows(_BACK, rows())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files in a folder; response payloads are checked by digest.

    A revisit's size is the one that its HTTP head declares.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read_form, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def convert_pages(pages: DataFrame, least: int = 0, path: str | None = None, **columns) -> DataFrame:
    """Page rows as ARC files, converted to WARC files in ``path`` and read back: one row per page row.

    Null html is an empty payload; a null URL becomes ``urn:unknown``; a null id is kept and its record
    is a response. Rows that repeat id and html are responses all. An empty table gives no rows; other
    columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(arc_records(pages_to_arc(pages, **columns)), path, least)
    return read_archives(pages.sparkSession, path)


__all__ = ["arc_records", "convert_pages", "pages_to_arc", "read_arc", "read_archives", "read_warc", "write_warc"]
