import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from casetrail.llm import warc as W

LONG = "<p>" + "día y noche " * 9000 + "</p>"
SAME = "<html>" + "x" * 1200


def expected(pages):
    """What comes back by the rules; ids are unique where payloads are long and equal."""
    rows = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        last = max(ids, default=None)
        again = len(payload) >= W.LEAST_REVISIT and page_id != last
        rows.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(rows, key=str)


PAGES = [(1, "http://a/", SAME), (2, "http://b/\r\nWARC/1.1\r\nx", SAME), (3, "http://c/ d", SAME), (4, None, None), (5, "u", ""),
         (6, "http://l/", LONG), (7, "http://s/", "short"), (8, "http://t/", "short"), (9, "v", "a WARC/1.1\r\nWARC/1.1\r\n\r\nb" * 50),
         (10, "w", "ends with WARC/1.1"), (11, "x", "\r\n\r\n0\r\n\r\n"), (12, "http://y/WARC/1.1", LONG), (None, "z", "no id")]


@pytest.mark.parametrize("sizes", [{}, {"segment": 700, "chunk": 100}, {"segment": 37, "chunk": 5}])
def test_pages_come_back(spark, sizes):
    pages = [(i, u, (h if len(h) < 5000 else h[:5000] + h[-5:]) if h else h) for i, u, h in PAGES] if sizes else PAGES
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit(1)).withColumn("file", F.lit("f"))
    found = W.archived(table, **sizes).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == expected(pages)
    assert {r.status for r in found} == {"whole"}


def test_payloads_are_returned_and_segments_used(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    W.write_archives(pages, str(tmp_path / "w"))
    records = W.read_records(spark, str(tmp_path / "w"))
    assert records.where("type = 'continuation'").count() >= 3
    back = {r.doc_id: bytes(r.payload).decode() for r in W.captures(records).where("record_type = 'response'").collect()}
    assert back["12"] == LONG and "6" not in back
    assert back["9"] == PAGES[8][2] and back["3"] == SAME and back["11"] == PAGES[10][2]


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", SAME)] * 4 + [(2, "u", "s")] * 2 + [(None, "u", SAME)], "page_id long, url string, html string")
    found = [(r.page_id, r.record_type, r.refers_to) for r in W.archived(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, "response", None)] + [(1, "revisit", 1)] * 3 + [(2, "response", None)] * 2
                                            + [(None, "revisit", 1)], key=str)


def test_no_pages(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def record(fields, block):
    return W._head([*fields, ("Content-Length", len(block))]) + block + W.GAP


def test_foreign_archives_and_faults(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhas WARC/1.1\r\nWARC-Type: response\r\n\r\ninside"
    plain = body.partition(W.GAP)[2]
    framed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: CHUNKED\r\n\r\n5;x=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: 1\r\n\r\n"
    sha = hashlib.sha1(b"hello world").hexdigest()

    def response(name, block, *more):
        return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *more], block)

    def rest(origin, k, block, *more):
        return record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{origin}:{k}>"), ("WARC-Segment-Origin-ID", f"<{origin}>"),
                       ("WARC-Segment-Number", k), *more], block)

    first, total = ("WARC-Segment-Number", 1), ("WARC-Segment-Total-Length", len(framed))
    archive = [
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<info>")], b"software: x"),
        response("plain", body), response("framed", framed, ("WARC-Payload-Digest", f"sha1:{sha}")),
        response("wrong digest", framed, ("WARC-Payload-Digest", "sha1:00")), response("cut", framed[:-25]),
        rest("parts", 3, framed[60:], total), rest("parts", 2, framed[30:60]), response("parts", framed[:30], first),
        rest("parts", 2, framed[30:60]),
        response("gap", framed[:30], first), rest("gap", 3, framed[60:], total),
        response("short", framed[:30], first), rest("short", 2, framed[30:50], total),
        response("open", framed[:30], first), rest("open", 2, framed[30:]),
        rest("orphan", 2, framed[30:], total),
        record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<again>"), ("WARC-Refers-To", "<framed>")], b""),
    ]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(archive))
    (folder / "c.warc.gz").write_bytes(gzip.compress(response("packed", body)) + gzip.compress(response("packed too", framed)))
    (folder / "b.warc").write_bytes(response("other file", framed) + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ntruncated")
    found = {r.record_id: (r.status, bytes(r.payload) if r.payload is not None else None) for r in W.read_archives(spark, str(folder)).collect()}
    assert found == {
        "plain": ("whole", plain), "framed": ("whole", b"hello world"), "wrong digest": ("damaged", b"hello world"), "cut": ("damaged", None),
        "parts": ("whole", b"hello world"), "gap": ("incomplete", None), "short": ("incomplete", None), "open": ("incomplete", None),
        "orphan": ("incomplete", None), "again": ("whole", None), "other file": ("whole", b"hello world"),
        "packed": ("whole", plain), "packed too": ("whole", b"hello world")}


def foreign(version, fields, block=b""):
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/" + version + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def response(version, i, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return foreign(version, [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:r{i}>"), ("WARC-Target-URI", "http://a.example/")], block)


@pytest.mark.parametrize("zipped", [False, True])
def test_other_minor_versions_and_marks_in_payloads(spark, tmp_path, zipped):
    content = b"".join(response(v, i, p) for i, (v, p) in enumerate([
        (b"1.0", b"one"), (b"1.0", b"says WARC/1.0 in between"), (b"1.1", b"three"), (b"1.0", b"")]))
    name = "a.warc.gz" if zipped else "a.warc"
    (tmp_path / name).write_bytes(gzip.compress(content) if zipped else content)
    plain = b"".join(response(b"1.0", 10 + i, b"p%d" % i) for i in range(3))
    (tmp_path / "b.warc").write_bytes(plain)
    found = {r.record_id: (r.status, bytes(r.payload)) for r in W.read_archives(spark, str(tmp_path)).collect()}
    assert found == {"urn:r0": ("whole", b"one"), "urn:r1": ("whole", b"says WARC/1.0 in between"), "urn:r2": ("whole", b"three"),
                     "urn:r3": ("whole", b""), **{f"urn:r{10 + i}": ("whole", b"p%d" % i) for i in range(3)}}


def test_a_file_without_a_record_is_reported(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"nothing of the kind")
    (tmp_path / "b.warc").write_bytes(response(b"1.0", 1, b"x"))
    found = W.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.type) for r in found) == [("a.warc", "broken"), ("b.warc", "response")]


def test_continuations_without_an_origin_stay_apart(spark, tmp_path):
    parts = b"".join(foreign(b"1.1", [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:c{i}>"), ("WARC-Segment-Number", 2)], b"part")
                     for i in range(5))
    parts += foreign(b"1.1", [("WARC-Type", "continuation"), ("WARC-Segment-Number", 3)], b"nameless")
    (tmp_path / "a.warc").write_bytes(parts)
    found = W.read_archives(spark, str(tmp_path)).collect()
    assert len(found) == 6 and {r.status for r in found} == {"incomplete"}
    assert {r.record_id for r in found} >= {f"urn:c{i}" for i in range(5)}
