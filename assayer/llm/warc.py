"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

Both refer to the response by its record id, target and date. The metadata record (JSON) keeps
the source's WARC and HTTP headers (by name, and as a list of all in their order) and its digests, says whether the payload still has the
digest that it was stored with, and lists title and links; the conversion record holds the
page's visible text. Record ids are derived from the response's, so a task that runs again
writes the same records.

A record that cannot be parsed, or is not a response, gives nothing, and so does null. An empty
payload gives an empty text. Records are derived one by one: repeated ones give repeated
records (with equal ids), an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.markup import blocks, pieces

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.IGNORECASE | re.DOTALL)
_LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.IGNORECASE)

Headers = list[tuple[str, str]]


class Record(NamedTuple):
    headers: Headers
    block: bytes

    def get(self, name: str) -> str | None:
        return _get(self.headers, name)


def _get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{source} {kind}')}>"


def _lines(data: bytes) -> tuple[str, Headers]:
    first, *rest = data.decode("utf-8", "replace").split("\r\n")
    out: Headers = []
    for line in rest:
        if line[:1] in " \t" and out:  # a folded line goes on with the one before
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return first, out


def parse(data: bytes, start: int = 0) -> tuple[Record, int] | None:
    """The record at ``start``, and where the next one begins; None if there is none."""
    end = data.find(b"\r\n\r\n", start)
    if not data.startswith(b"WARC/", start) or end < 0:
        return None
    _, headers = _lines(data[start:end])
    size = _get(headers, "Content-Length") or ""
    if not size.isdigit() or end + 4 + int(size) > len(data):
        return None
    at = end + 4 + int(size)
    record = Record(headers, bytes(data[end + 4 : at]))
    while data.startswith(b"\r\n", at):
        at += 2
    return record, at


def build(headers: Headers, block: bytes) -> bytes:
    lines = [*headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


def _payload(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and body of an HTTP response; a block without headers is all body."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return "", [], block
    status, headers = _lines(block[:end])
    return status, headers, block[end + 4 :]


def _text_of(body: bytes, content_type: str) -> str:
    charset = _CHARSET.search(content_type)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive_record(data: bytes | None) -> list[tuple[str, Record]]:
    """(type, record) of both derivatives of a response."""
    parsed = parse(data or b"")
    if parsed is None or (parsed[0].get("WARC-Type") or "").lower() != "response":
        return []
    source = parsed[0]
    status, http, body = _payload(source.block)
    page = _text_of(body, _get(http, "Content-Type") or "")
    own, stored = digest(body), source.get("WARC-Payload-Digest")
    name = source.get("WARC-Record-ID") or digest(data)
    links = [html.unescape("".join(m)) for m in _LINK.findall(page)]
    title = _TITLE.search(page)
    described = {
        # A name has one value here; the lists hold every header in its order, repeated ones too.
        "source": dict(source.headers),
        "source_headers": source.headers,
        "http": {"status": status, "headers": dict(http), "header_list": http},
        "payload": {"digest": own, "stored_digest": stored, "unchanged": stored is None or stored == own, "bytes": len(body)},
        "title": " ".join(html.unescape(title[1]).split()) if title else None,
        "links": links,
    }
    out = []
    for kind, media, block in (
        ("metadata", "application/json", json.dumps(described, ensure_ascii=False, sort_keys=True).encode()),
        ("conversion", "text/plain; charset=utf-8", "\n".join(blocks(pieces(page))).encode("utf-8", "replace")),
    ):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", derived_id(name, kind)), ("WARC-Refers-To", source.get("WARC-Record-ID"))]
        headers += [(k, source.get(k)) for k in ("WARC-Target-URI", "WARC-Date")]
        headers += [("WARC-Refers-To-Target-URI", source.get("WARC-Target-URI")), ("WARC-Refers-To-Date", source.get("WARC-Date"))]
        headers += [("WARC-Payload-Digest", own if kind == "metadata" else None), ("WARC-Block-Digest", digest(block)), ("Content-Type", media)]
        out.append((kind, Record([(k, v) for k, v in headers if v is not None], block)))
    return out


_FIELDS = {
    "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "block_digest": "WARC-Block-Digest",
}
DERIVED = T.StructType([
    T.StructField("type", T.StringType()),
    *(T.StructField(n, T.StringType()) for n in _FIELDS),
    T.StructField("block", T.StringType()),
    T.StructField("record", T.BinaryType()),
])
_DERIVED = pa.struct([("type", pa.string()), *((n, pa.string()) for n in _FIELDS), ("block", pa.string()), ("record", pa.binary())])


def _deriving(record: str, derived: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (record, derived)]
            for at in range(0, len(batch), 500):
                rows, places = [], []
                for i, data in enumerate(batch.column(record).slice(at, 500).to_pylist(), at):
                    for kind, made in derive_record(data):
                        fields = {n: made.get(h) for n, h in _FIELDS.items()}
                        rows.append({"type": kind, **fields, "block": made.block.decode(), "record": build(*made)})
                        places.append(i)
                kept = batch.select(names).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rows, _DERIVED)], names=[*names, derived])

    return run


def derive(records: DataFrame, record: str = "record", derived: str = "derived") -> DataFrame:
    """Two rows for each response in ``record`` (binary), with a struct ``derived`` in place of it."""
    fields = [f for f in records.schema.fields if f.name not in (record, derived)]
    return records.mapInArrow(_deriving(record, derived), T.StructType([*fields, T.StructField(derived, DERIVED)]))


def _responses(url: str, page: str, key: str, record: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (page, record)]
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                made = []
                for address, body, name in zip(*(rows.column(c).to_pylist() for c in (url, page, key))):
                    body = (body or "").encode()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
                    headers = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id(f"{name} {address}", "response"))]
                    if address is not None:
                        headers.append(("WARC-Target-URI", " ".join(address.split())))
                    headers += [
                        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest(body)),
                        ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    made.append(build(headers, http))
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(made, pa.binary())], names=[*names, record])

    return run


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", record: str = "record") -> DataFrame:
    """Stored pages as response records, in place of the page's column."""
    fields = [f for f in pages.schema.fields if f.name not in (html, record)]
    return pages.mapInArrow(_responses(url, html, key, record), T.StructType([*fields, T.StructField(record, T.BinaryType())]))


_CHUNK = 1 << 20
_GZIP = b"\x1f\x8b\x08"


def _pieces_of(content: bytes) -> Iterator[tuple[str, bytes | tuple[int, int]]]:
    """A file as ("data", bytes) of bounded size, ("member", b"") where a gzip member begins, and ("broken", (file offset, bytes))."""
    if content[:2] != _GZIP[:2]:
        for at in range(0, len(content), _CHUNK):
            yield "data", content[at : at + _CHUNK]
        return
    at = 0
    while at < len(content):
        start, ended = at, False
        if content.startswith(_GZIP, at):
            yield "member", b""
            stream = zlib.decompressobj(31)
            try:
                while not stream.eof and (at < len(content) or stream.unconsumed_tail):
                    given = stream.unconsumed_tail
                    if not given:
                        given, at = content[at : at + _CHUNK], at + len(content[at : at + _CHUNK])
                    if made := stream.decompress(given, _CHUNK):
                        yield "data", made
                while not stream.eof and (made := stream.decompress(b"", _CHUNK)):
                    yield "data", made
                ended = stream.eof
            except zlib.error:
                pass
        if ended:
            at -= len(stream.unused_data)
            while content[at : at + 1] == b"\0":  # padding
                at += 1
        else:
            at = content.find(_GZIP, start + 1)
            at = len(content) if at < 0 else at
            yield "broken", (start, at - start)


def _scan(content: bytes) -> Iterator[tuple[int, bytes | None, int, bool]]:
    """(offset, record, bytes that belong to none, whether they are a damaged gzip member's) in the order of the file.

    Offsets count the data as decompressed, those of damaged members the file's bytes. A record must
    end before a blank line, another record or the end; where there is none the scan goes on at the
    next gzip member or line that starts one.
    """
    data, base, at, bad, members = bytearray(), 0, 0, None, []

    def take(last: bool) -> Iterator[tuple[int, bytes | None, int, bool]]:
        nonlocal at, bad
        while at < len(data):
            if bad is None:
                while data.startswith(b"\r\n", at):
                    at += 2
                if at == len(data) or (not last and len(data) - at < 5):
                    return
                found = parse(data, at)
                if found is not None:
                    following = found[1]
                    body = data.find(b"\r\n\r\n", at) + 4 + len(found[0].block)
                    if not last and len(data) - body < 9:
                        return
                    if data.startswith((b"\r\n\r\n", b"WARC/", b"\r\nWARC/"), body) or following == len(data):
                        yield base + at, bytes(data[at:following]), 0, False
                        at = following
                        continue
                elif not last and data.startswith(b"WARC/", at):
                    end = data.find(b"\r\n\r\n", at)
                    if end < 0 and data.find(b"\nWARC/", at) < 0:
                        return
                    if end >= 0 and (_get(_lines(bytes(data[at:end]))[1], "Content-Length") or "").isdigit():
                        return
                bad = base + at
            line = data.find(b"\nWARC/", at) + 1
            onward = [x for x in (line, *(m - base for m in members)) if x > max(at, bad - base)]
            if not onward:
                at = len(data) if last else max(at, len(data) - 5)
                if last:
                    yield bad, None, base + at - bad, False
                    bad = None
                return
            at = min(onward)
            yield bad, None, base + at - bad, False
            bad = None

    for kind, piece in _pieces_of(content):
        if kind == "member":
            members.append(base + len(data))
        elif kind == "data":
            data += piece
            yield from take(False)
        else:
            yield from take(True)
            yield piece[0], None, piece[1], True
        if at:
            del data[:at]
            base, at = base + at, 0
            members = [m for m in members if m >= base]
    yield from take(True)


def _splitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            for row in _scan(content.as_py()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()]), *(pa.array([v], t) for v, t in zip(row, types))],
                    names=["path", "offset", "record", "bad_bytes", "bad_member"],
                )


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record, bad_bytes, bad_member) of WARC files, plain or gzipped.

    Stretches that hold no whole record are rows without one, with their place and length; those
    of a damaged gzip member count the file's bytes, all others the data as decompressed. A file
    comes as one row of its stored bytes and is decompressed piece by piece.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_splitting, "path string, offset long, record binary, bad_bytes long, bad_member boolean")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record) of all records of WARC files; :func:`scan_warc` also has what belongs to none."""
    return scan_warc(spark, path).where("record is not null").select("path", "offset", "record")


def write_warc(derived: DataFrame, path: str, column: str = "derived") -> None:
    """The derived records as gzipped WARC files, one for each task."""
    records = derived.select(F.decode(F.col(column)["record"], "UTF-8").alias("value"))
    records.write.text(path, compression="gzip", lineSep="\r\n\r\n")
