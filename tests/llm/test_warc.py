"""Records parsed and built, derivatives and what they refer to, files read and written."""

import base64
import gzip
import hashlib
import json

from assayer.llm import warc

HTML = '<html><head><title> A &amp; B </title></head><body><p>One</p><a class=x href="/l?a=1&amp;b=2">two</a><script>no</script></body></html>'


def response(body=HTML.encode("latin-1"), media="text/html; charset=latin-1", stored=None, name="<urn:uuid:1>"):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nX-Folded: a\r\n b\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", "http://x.org/"), ("WARC-Date", "2020-01-02T03:04:05Z")]
    return warc.build([*headers, *([("WARC-Payload-Digest", stored)] if stored else [])], http)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives():
    made = dict(warc.derive_record(response(stored=sha1(HTML.encode()))))
    assert list(made) == ["metadata", "conversion"]
    for kind, record in made.items():
        assert (record.get("WARC-Type"), record.get("WARC-Refers-To"), record.get("WARC-Target-URI"), record.get("WARC-Date")) == (
            kind, "<urn:uuid:1>", "http://x.org/", "2020-01-02T03:04:05Z")
        assert record.get("WARC-Block-Digest") == sha1(record.block)
        assert warc.parse(warc.build(*record))[0].block == record.block
    assert made["conversion"].block.decode() == "One\ntwo"
    told = json.loads(made["metadata"].block)
    assert told["source"]["WARC-Record-ID"] == "<urn:uuid:1>" and told["http"]["headers"]["X-Folded"] == "a b"
    assert told["payload"] == {"digest": sha1(HTML.encode()), "stored_digest": sha1(HTML.encode()), "unchanged": True, "bytes": len(HTML)}
    assert (told["title"], told["links"]) == ("A & B", ["/l?a=1&b=2"])
    assert json.loads(dict(warc.derive_record(response(stored="sha1:X")))["metadata"].block)["payload"]["unchanged"] is False
    assert dict(warc.derive_record(response("é".encode("latin-1"))))["conversion"].block.decode() == "é"
    assert dict(warc.derive_record(response(b"", "text/html; charset=nonsense")))["conversion"].block == b""
    again = dict(warc.derive_record(response()))
    assert [r.get("WARC-Record-ID") for r in again.values()] == [r.get("WARC-Record-ID") for r in made.values()]
    request = response().replace(b"WARC-Type: response", b"WARC-Type: request ")
    assert [warc.derive_record(x) for x in (None, b"", b"WARC/1.1\r\n", request, response()[:-5])] == [[]] * 5


def test_repeated_headers_are_kept_in_order():
    http = [["Set-Cookie", "a=1"], ["Via", "x"], ["set-cookie", "b=2"], ["Set-Cookie", "c=3"], ["Via", "y"]]
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n<p>x").encode()
    own = [["WARC-Type", "response"], ["WARC-Concurrent-To", "<urn:uuid:2>"], ["WARC-Record-ID", "<urn:uuid:1>"], ["WARC-Concurrent-To", "<urn:uuid:3>"]]
    told = json.loads(dict(warc.derive_record(warc.build([(k, v) for k, v in own], block)))["metadata"].block)
    assert told["http"]["header_list"] == http
    assert told["source_headers"] == [*own, ["Content-Length", str(len(block))]]


def test_pages_to_derivatives(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/", HTML, "x"), (1, "http://a.org/", HTML, "x"), (2, None, None, "x"), (3, "http://c.org/", "<p>" + "long " * 50_000, "x")],
        "page_id long, url string, html string, record string",
    )
    got = warc.derive(warc.responses(pages))
    assert got.columns == ["page_id", "url", "derived"]
    rows = got.collect()
    assert sorted((r["page_id"], r["derived"]["type"]) for r in rows) == sorted((i, k) for i in (1, 1, 2, 3) for k in ("conversion", "metadata"))
    texts = {r["page_id"]: r["derived"]["block"] for r in rows if r["derived"]["type"] == "conversion"}
    assert texts == {1: "One\ntwo", 2: "", 3: ("long " * 50_000).strip()}
    assert len({r["derived"]["refers_to"] for r in rows}) == 3 and len({r["derived"]["record_id"] for r in rows}) == 6
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


def test_files(spark, tmp_path):
    records = [response(name=f"<urn:uuid:{i}>") for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"\r\n\r\n".join(records) + b"\r\n\r\nWARC/1.1\r\nbroken")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[:2]))
    read = warc.read_warc(spark, f"{tmp_path}/*.warc*")
    assert read.count() == 7
    warc.write_warc(warc.derive(read), f"{tmp_path}/out")
    back = warc.read_warc(spark, f"{tmp_path}/out/*.gz").collect()
    kinds = [warc.parse(bytes(r["record"]))[0].get("WARC-Type") for r in back]
    assert sorted(kinds) == ["conversion"] * 7 + ["metadata"] * 7


def test_bad_records_do_not_end_a_file(spark, tmp_path, monkeypatch):
    good = [response(name=f"<urn:uuid:{i}>") for i in range(6)]
    end = b"\r\n\r\n"
    size = good[0].split(b"Content-Length: ")[1].split(b"\r\n")[0]
    length = b"Content-Length: " + size
    bad = [
        good[0].replace(length, b"X: 1"), good[0].replace(length, b"Content-Length: 9"),
        good[0].replace(length, b"Content-Length: %d" % (int(size) + 40)), good[0].replace(length, b"Content-Length: 99999999"), b"stray\nbytes",
    ]
    mixed = [x for pair in zip(good, bad) for x in pair] + good[5:]
    (tmp_path / "a.warc").write_bytes(end.join(mixed) + end)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r + end) for r in mixed))
    packed = [gzip.compress(r + end) for r in good]
    packed[2] = packed[2][:60] + b"\xff" * 40 + packed[2][100:]
    (tmp_path / "c.warc.gz").write_bytes(b"".join([*packed[:4], b"junk", *packed[4:]]))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b"".join(r + end for r in mixed)))
    cut = [good[0], good[1][:-20], good[2]]
    (tmp_path / "e.warc.gz").write_bytes(b"".join(map(gzip.compress, cut)))
    expected = {"a.warc": good, "b.warc.gz": good, "c.warc.gz": good[:2] + good[3:], "d.warc.gz": good, "e.warc.gz": [good[0], good[2]]}
    rows = warc.scan_warc(spark, f"{tmp_path}/*.warc*").collect()
    for name, records in expected.items():
        own = [r for r in rows if r["path"].endswith(name)]
        assert [bytes(r["record"]).rstrip(b"\r\n") for r in own if r["record"] is not None] == records, name
        assert all(r["bad_bytes"] > 0 for r in own if r["record"] is None)
        assert sum(r["record"] is None for r in own) >= (5 if len(name) and name[0] in "abd" else 1)
    plain = end.join(mixed) + end
    for r in rows:
        if r["path"].endswith("a.warc") and r["record"] is not None:
            assert plain.startswith(bytes(r["record"]), r["offset"])
    whole = {n: list(warc._scan((tmp_path / n).read_bytes())) for n in expected}
    for chunk in (1, 7, 100):
        monkeypatch.setattr(warc, "_CHUNK", chunk)
        for name, rows in whole.items():
            got = [(r[0], r[1].rstrip(b"\r\n")) for r in warc._scan((tmp_path / name).read_bytes()) if r[1]]
            assert got == [(r[0], r[1].rstrip(b"\r\n")) for r in rows if r[1]], (name, chunk)
