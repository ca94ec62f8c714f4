"""WARC archives: writing with segments, chunked framing and revisits, and reading with reassembly of segments.

Archives are WARC/1.1 records (1.x is read), written and read by Spark's text source, gzipped as archives usually are: a task writes a
file and a task reads it as a stream; plain archives are split among tasks. The record separator of the reader is the beginning of the version line. The writer ends a chunk
inside any such line in a payload, so its archives never break; in foreign archives a record whose length does not match
sends its file to a second, sequential reader.

Continuation records are grouped by the identifier of their first record, a group being one payload. Segments are ordered by
number; they must be 1 to n without gaps and have the total length that the last one states. Then chunked framing is
taken off and the payload's digest compared.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm.rows import SMALL_ROWS, anchored, col, join_counted, lean, placed
from casetrail.session import broadcast_if_small, shared_folder, stash

VERSION = b"WARC/1.1\r\n"
FAMILY = b"WARC/1."
"""What every version line begins with; the digit of the minor version and a line break follow."""
_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
GAP = b"\r\n\r\n"
SEGMENT = 32 * 1024
CHUNK = 8 * 1024
LEAST_REVISIT = 1_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

RECORD = ("file string, record_id string, type string, doc_id string, url string, origin string, segment int, total long, "
          "refers string, digest string, block binary")


# --- writing --------------------------------------------------------------------------------------------------------


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing. No chunk has a whole version mark, so no framed payload has a version line."""
    cuts = {m.start() + 4 for m in re.finditer(re.escape(FAMILY), payload)}
    cuts = sorted({*cuts, *range(0, len(payload), chunk), len(payload)})
    parts = [payload[a:b] for a, b in zip(cuts, cuts[1:])]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records(record_id: str, doc_id: str | None, url: str | None, payload: bytes, digest: str, refers: str | None,
            segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one capture, each without the two line breaks that end it."""
    known = [("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None), ("X-Document-Id", doc_id)]
    if refers is not None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Refers-To", f"<{refers}>"),
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *known,
                     ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", 0)])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[a:a + segment] for a in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *known, ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
        if k > 1:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", k))
        if k == len(parts) > 1:
            own.append(("WARC-Segment-Total-Length", len(block)))
        yield _head([*own, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Archives of all ``pages`` under ``folder``.

    Of captures with equal payloads of ``LEAST_REVISIT`` bytes or more the one with the greatest id is the response and the
    others revisit it; a null id is the least. Of rows with equal ids and payloads the last by place is the response. Null
    payloads are empty. Every row has its own record id, so repeated rows stay apart.
    """
    pages = anchored(pages)
    payload = F.coalesce(col(html).cast("string"), F.lit("")).cast("binary")
    record = F.md5(F.concat_ws("#", F.col("file"), F.col("pos").cast("string")).cast("binary"))
    record = F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                            for x in (F.lit("-"), F.substring(record, a, n))][1:]).alias("record_id")
    rows = placed(pages, page_id=col(page_id), payload=payload, url=col(url).cast("string"))
    narrow = stash(rows.select("file", "pos", record, "page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("size"))
                   .where(F.col("size") >= LEAST_REVISIT))
    last = F.max_by("record_id", F.struct("page_id", "file", "pos")).alias("refers")
    same = stash(narrow.groupBy("sha").agg(last, F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = join_counted(narrow.select("sha", "file", "pos", "record_id"), same, "sha", how="inner")
    again = stash(again.where("refers <> record_id").select("file", "pos", "refers"))
    whole = rows.select("file", "pos", record, F.col("page_id").cast("string").alias("page_id"), "url", "payload",
                        F.sha1("payload").alias("digest")).join(broadcast_if_small(again, SMALL_ROWS), ["file", "pos"], "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[bytes] = []
            for row in batch.to_pylist():
                own += records(row["record_id"], row["page_id"], row["url"], row["payload"], row["digest"], row["refers"], segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["record"])

    found = whole.drop("file", "pos").mapInArrow(lean(written, 200), "record binary")
    records_ = found.select(F.col("record").cast("string").alias("value"))
    records_.write.option("lineSep", GAP.decode()).option("compression", "gzip").text(folder)


# --- reading --------------------------------------------------------------------------------------------------------


def parsed(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated fields the first, angle brackets taken off."""
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip().removeprefix("<").removesuffix(">"))
    return fields


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch("[0-9]{1,18}", value) else None


def record_of(text: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of what follows ``FAMILY``; None if that is no version line or the length is not as stated."""
    if not re.match(rb"[0-9]\r\n", text):
        return None
    head, gap, rest = text[3:].partition(GAP)
    fields = parsed(head)
    size = _number(fields.get("content-length"))
    if not gap or size is None or rest[size:] not in (GAP, b"") or len(rest) < size:
        return None
    return fields, rest[:size]


def _row(file: str, fields: dict[str, str], block: bytes) -> dict:
    digest = fields.get("warc-payload-digest", "")
    return {"file": file, "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "doc_id": fields.get("x-document-id"),
            "url": fields.get("warc-target-uri"), "origin": fields.get("warc-segment-origin-id"),
            "segment": _number(fields.get("warc-segment-number")), "total": _number(fields.get("warc-segment-total-length")),
            "refers": fields.get("warc-refers-to"), "digest": digest.removeprefix("sha1:") or None, "block": block}


def _sequential(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a whole archive by their lengths; what cannot be read up to the next version line is passed over."""
    line = _VERSION_LINE.search(content)
    while line:
        start = line.end()
        gap = content.find(GAP, start)
        fields = parsed(content[start:gap]) if gap >= 0 else {}
        size = _number(fields.get("content-length"))
        if size is None or gap + 4 + size > len(content):
            line = _VERSION_LINE.search(content, start)
            continue
        yield fields, content[gap + 4:gap + 4 + size]
        line = _VERSION_LINE.search(content, gap + 4 + size)


_ARROW = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("doc_id", pa.string()),
                    ("url", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
                    ("refers", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives of WARC 1.x in a folder (see ``RECORD``), landed.

    A file in which no record can be read is one row of type ``broken``.
    """
    texts = spark.read.option("lineSep", FAMILY.decode()).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, value in zip(batch.column("file"), batch.column("value")):
                text = value.as_py()
                if text and text.strip():  # what stands before the first version line is no record
                    found = record_of(text)
                    rows.append(_row(file.as_py(), *found) if found else {"file": file.as_py(), "type": "broken"})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    found = stash(texts.mapInArrow(lean(read), RECORD))
    broken = found.where("type = 'broken'").select("file").distinct()
    if broken.isEmpty():
        return found
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file"), "content").join(broken, "file")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content")):
                whole, none = content.as_py(), True
                for fields, block in _sequential(gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole):
                    none = False
                    yield pa.RecordBatch.from_pylist([_row(file.as_py(), fields, block)], _ARROW)
                if none:
                    yield pa.RecordBatch.from_pylist([{"file": file.as_py(), "type": "broken"}], _ARROW)

    return stash(found.join(broken, "file", "left_anti").unionByName(files.mapInArrow(again, RECORD)))


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None
        parts.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes | None) -> bytes | None:
    """The payload in an HTTP response, out of chunked framing if it has it; None if it cannot be read."""
    head, gap, body = (block or b"").partition(GAP)
    if not gap:
        return None
    return dechunked(body) if parsed(head).get("transfer-encoding", "").lower() == "chunked" else body


def captures(found: DataFrame) -> DataFrame:
    """One row per response and revisit in ``found`` (records, landed): ``record_id``, ``record_type``, ``doc_id``, ``url``,
    ``refers`` (record id of the response that a revisit stands for), ``digest`` (as stated), ``payload`` (null for revisits)
    and ``status``: ``whole``; ``incomplete`` when segments are missing, differ or do not have the stated total length;
    ``damaged`` when framing or digest are wrong. Repeated records count once where they are equal. A continuation record that
    names no origin is incomplete by itself, under its own id.
    """
    names = ["record_id", "type", "doc_id", "url", "refers", "digest"]
    alone = found.where("type in ('response', 'revisit') and segment is null").select(*names, "block", F.lit(True).alias("complete"))
    parts = found.where("segment is not null and type in ('response', 'continuation')").groupBy(
        F.coalesce(F.when(F.col("type") == "response", F.col("record_id")).otherwise(F.col("origin")), "record_id",
                   F.concat_ws("#", F.col("file"), F.xxhash64("block").cast("string"))).alias("record_id")).agg(
        F.array_sort(F.collect_set(F.struct("segment", "total", "block"))).alias("parts"),
        *[F.max(F.when(F.col("type") == "response", F.col(c))).alias(c) for c in names[1:]])
    numbers = F.transform("parts", lambda p: p["segment"])
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    complete = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.element_at("parts", -1)["total"] == total)
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda b, p: F.concat(b, p["block"]))
    joined = parts.where("type is not null").select(*names, block.alias("block"), F.coalesce(complete, F.lit(False)).alias("complete"))
    lost = parts.where("type is null").select("record_id", F.lit("response").alias("type"), *[c for c in names[2:]],
                                              F.lit(None).cast("binary").alias("block"), F.lit(False).alias("complete"))
    rows = alone.unionByName(joined).unionByName(lost).withColumn("payload", F.lit(None).cast("binary"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = zip(batch.column("type"), batch.column("complete"), batch.column("block"))
            payloads = [payload_of(b.as_py()) if t.as_py() == "response" and c.as_py() else None for t, c, b in wanted]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*names, "complete"]], pa.array(payloads, pa.binary())],
                                             [*names, "complete", "payload"])

    read = rows.drop("block").select(*names, "complete", "payload").schema
    right = (F.col("type") == "revisit") | F.coalesce(F.sha1("payload") == F.col("digest"), F.col("payload").isNotNull() & F.col("digest").isNull())
    status = F.when(~F.col("complete"), "incomplete").when(right, "whole").otherwise("damaged")
    return rows.drop("payload").mapInArrow(lean(decoded), read).select(
        "record_id", F.col("type").alias("record_type"), "doc_id", "url", "refers", "digest", "payload", status.alias("status"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``captures`` of the archives in a folder."""
    return captures(read_records(spark, folder))


def archived(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write ``pages`` as archives, read them back: per page ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` (the id of the response's page), ``url`` and ``status``; size and digest are those of the full payload.

    A revisit has its response's size and digest; if the response is not there, both are null. No pages give no rows.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/casetrail/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **how)
    rows = stash(read_archives(spark, folder).select(
        "record_id", F.col("doc_id").cast("long").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", "refers", "url", "status"))
    own = rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).drop("refers")
    again = rows.where("record_type = 'revisit'").select("record_id", "page_id", "record_type", "refers", "url", "status")
    times = again.groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    meant = stash(rows.where("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(times, "refers"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "status"]
    return own.select(*columns).unionByName(join_counted(again, meant, "refers").select(*columns))
