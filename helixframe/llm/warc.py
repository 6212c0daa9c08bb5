"""WARC archives: writing captures of pages, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record; the first and last name the second by WARC-Concurrent-To.
Archives are written by Spark's text writer: a record ends with two CRLF, which
is the writer's line end, so a file is a valid WARC file, gzipped as a whole. Files are bounded
by bytes: pages of like sizes share files, of as many pages as fit. Reading inflates an archive
piece by piece and goes by Content-Length, never by searching for a separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import BATCH_BYTES, cleanup, drop, forget, scratch, store

CRLF = "\r\n"
PRIMARY = ("response", "revisit", "resource")
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, content_type string, payload_bytes bigint, payload_digest string, fields string, payload binary"


def base32_of_hex(digest):
    """Column: upper-case base32 of a 40-digit hex digest."""
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id, uri, headers: list, content_type: str, block):
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Target-URI: "), uri]
    for name, value in headers:
        lines += [F.lit(f"{CRLF}{name}: "), value]
    return F.concat(*lines, F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


#: Largest payloads of the classes of pages that share files; above the last, a page has a file of its own.
CLASSES = (1 << 16, 1 << 20, 1 << 24)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> None:
    """Writes three records for each row of pages (page_id, url, html).

    An archive has about `file_bytes` bytes of payload at most, or one page that is longer. An empty table gives no records;
    repeated rows are written as often as they occur; columns of other names are ignored.

    Of rows whose payloads are equal and have at least `least_bytes` bytes, those with
    the largest page_id are responses and the others revisits. Null html is an
    empty payload; a null page_id is written as `null` and never revisited. Null
    urls become urn:page:<page_id>; line ends in urls are escaped.
    """
    key = F.coalesce(F.col("page_id").cast("bigint").cast("string"), F.lit("null"))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        key.alias("key"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), key)), r"[\x00-\x20]", "%20").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_of_hex(F.sha1(F.col("payload").cast("binary")))).withColumn("size", F.octet_length("payload"))
    kind = sum((F.col("size") > u).cast("int") for u in CLASSES)
    known = store(rows.select("page_id", "digest", "size", kind.alias("kind")), "warc-digests")
    # only payloads that occur again need their first holder; this small table's size decides how it is joined
    again = known.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    again = store(again.select(F.col("digest").alias("d"), "holder"), "warc-repeats")
    kinds = [r["kind"] for r in known.select("kind").distinct().collect()]
    rows = rows.join(again, rows.digest == again.d, "left")
    response = F.concat(F.lit("urn:capture:response:"), "key", F.lit(":"), "digest")
    revisit = F.coalesce(F.col("holder") != F.col("page_id"), F.col("holder").isNotNull())
    own = F.when(revisit, F.concat(F.lit("urn:capture:revisit:"), "key", F.lit(":"), "digest")).otherwise(response)
    other = F.concat(F.lit("urn:capture:response:"), F.col("holder").cast("string"), F.lit(":"), "digest")
    rows = rows.withColumn("revisit", revisit).withColumn("own", own).withColumn("other", other)
    uri, when = F.col("uri"), ("WARC-Date", F.lit(date))
    together = ("WARC-Concurrent-To", F.concat(F.lit("<"), "own", F.lit(">")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1)
    request = _record("request", F.concat(F.lit("urn:capture:request:"), "key", F.lit(":"), "digest"), uri, [when, together], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    full = _record("response", F.col("own"), uri, [when, digest], "application/http; msgtype=response", F.concat(http, "payload"))
    short = _record("revisit", F.col("own"), uri, [when, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.concat(F.lit("<"), "other", F.lit(">")))], "application/http; msgtype=response", http)
    metadata = _record("metadata", F.concat(F.lit("urn:capture:metadata:"), "key", F.lit(":"), "digest"), uri, [when, together], "application/warc-fields", F.concat(F.lit("page-id: "), "key", F.lit(CRLF)))
    records = F.explode(F.array(request, F.when(F.col("revisit"), short).otherwise(full), metadata))
    for k in kinds:
        most = 3 * max(1, file_bytes // CLASSES[k]) if k < len(CLASSES) else 3
        part = rows if len(kinds) == 1 else rows.where(kind == k)
        with cleanup(pages.sparkSession):
            part.select(records.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)
    if not kinds:
        rows.select(records.alias("value")).write.mode("append").text(path)
    forget(known, again)


HEAD = re.compile(rb"\r\n\r\n")


def inflated(data, step: int = 1 << 18, most: int = 4 << 20):
    """The bytes of an archive, plain or of any number of gzip members, in pieces of at most `most`."""
    data = memoryview(data).cast("B")
    if data[:2] != b"\x1f\x8b":
        for a in range(0, len(data), most):
            yield data[a : a + most]
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.unconsumed_tail or data[at : at + step]
            if not member.unconsumed_tail:
                at += len(piece)
                if not len(piece):
                    raise ValueError("the archive is cut short")
            yield member.decompress(piece, most)
        at -= len(member.unused_data)


def parse(data):
    """(headers with lower-case names, block) of each record of one archive. Holds one record and a piece of the archive."""
    pieces, held, at, done = inflated(data), bytearray(), 0, 0

    def fill(n: int) -> bool:
        """Whether n bytes follow `at`, after reading on as far as it takes."""
        nonlocal at, done
        if len(held) - at < n and at:
            del held[:at]
            done, at = done + at, 0
        while len(held) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        if fill(2) and held[at : at + 2] == b"\r\n":
            at += 2
            continue
        n, end = 1024, -1
        while end < 0:
            whole = fill(n)
            end = held.find(b"\r\n\r\n", at)
            if held[at : at + 5] != b"WARC/" or end < 0 and not whole:
                raise ValueError(f"no WARC record at byte {done + at}")
            n *= 4
        headers: dict[str, list[str]] = {}
        for line in held[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        head, size = end + 4 - at, int(headers["content-length"][0])
        if not fill(head + size):
            raise ValueError(f"the record at byte {done + at} is cut short")
        yield headers, bytes(memoryview(held)[at + head : at + head + size])
        at += head + size


def digest_of(payload) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under path. payload_bytes and payload_digest are of the whole payload.

    For a revisit, which carries none, they are its HTTP Content-Length and its WARC-Payload-Digest.
    An archive is read by one task, which hands on its records in batches of about 4 MB as they are parsed; broken archives
    raise an error, empty ones and none give no rows. Records of the same id are all returned; null where a header is missing.
    """
    bare = lambda v: v[0].strip("<>") if v else None

    def row(h, block: bytes):
        kind = h.get("warc-type", [""])[0]
        content = h.get("content-type", [""])[0]
        payload, size, digest = block, None, None
        if content.startswith("application/http"):
            m = HEAD.search(block)
            payload = memoryview(block)[m.end() if m else len(block) :]
            if kind == "revisit":
                given = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: m.end()] if m else block)
                size = int(given[1]) if given else None
                digest = (h.get("warc-payload-digest", [""])[0].partition(":")[2]) or None
        if kind != "revisit":
            size, digest = len(payload), digest_of(payload)
        fields = block.decode("utf-8", "replace") if content == "application/warc-fields" else None
        return bare(h.get("warc-record-id")), kind, [x.strip("<>") for x in h.get("warc-concurrent-to", [])], bare(h.get("warc-target-uri")), h.get("warc-date", [None])[0], bare(h.get("warc-refers-to")), content, size, digest, fields, bytes(payload) if with_payload else None

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                rows, size = [], 0
                for h, block in parse(data.as_buffer()):
                    rows.append(row(h, block))
                    size += 500 + len(block) * with_payload
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, and structs main, request, metadata.

    A capture is a response, revisit or resource with the records joined to it by
    WARC-Concurrent-To: those that name it, those it names, and those that name
    one of the latter. Records with the same id are one record; a main record
    that occurs n times gives n equal rows. Records that belong to no main record are left out;
    a null where a capture has no request or metadata.
    """
    main = F.col("type").isin(*PRIMARY)
    mains = records.where(main & F.col("record_id").isNotNull()).select(F.col("record_id").alias("m")).distinct()
    edges = records.select("record_id", main.alias("is_main"), F.explode("concurrent_to").alias("target"))
    direct = edges.where(~F.col("is_main")).join(mains, F.col("target") == F.col("m")).select("record_id", F.col("m").alias("capture_id"))
    named = edges.where("is_main").join(mains.withColumnRenamed("m", "t"), F.col("target") == F.col("t"), "left_anti").select(F.col("target").alias("record_id"), F.col("record_id").alias("capture_id"))
    near = direct.unionByName(named).distinct()
    far = edges.where(~F.col("is_main")).select(F.col("record_id").alias("r"), "target").join(near.withColumnRenamed("record_id", "t"), F.col("target") == F.col("t")).select(F.col("r").alias("record_id"), "capture_id")
    member = near.unionByName(far).distinct()
    part = F.struct(*[c for c in records.columns])
    keyed = records.where(main).select(F.col("record_id").alias("capture_id"), part.alias("p")).unionByName(
        records.where(~main).select("record_id", part.alias("p")).join(member, "record_id").select("capture_id", "p")
    )
    kind = F.col("p.type")
    grouped = keyed.where("capture_id is not null").groupBy("capture_id").agg(
        F.count(F.when(kind.isin(*PRIMARY), 1)).alias("copies"),
        F.max(F.when(kind.isin(*PRIMARY), F.col("p"))).alias("main"),
        F.max(F.when(kind == "request", F.col("p"))).alias("request"),
        F.max(F.when(kind == "metadata", F.col("p"))).alias("metadata"),
    )
    return grouped.select("capture_id", "copies", "main", "request", "metadata", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The captures of pages after writing and reading their archives, without payloads; archives go when they are read.

    Nulls, repeated rows, long payloads, empty tables and columns of other names are as in `write` and `assemble`.
    """
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    records = store(read(pages.sparkSession, path, with_payload=False), "warc-records")
    drop(pages.sparkSession, path)
    return assemble(records.drop("payload"))
