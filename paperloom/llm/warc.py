"""WARC archives: writing page records in segments, reading them back and putting segments together.

Records are made by native expressions and written by Spark's text writer, whose
line separator is the two line ends that close a record, so archives may lie in
any store that Spark reaches.  Reading groups continuation records by the record
they continue, orders them by segment number, verifies the total length, undoes
the chunked transfer framing and compares the payload digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.scratch import cut

LEAST_REVISIT = 1000  # bytes of a payload that may be replaced by a revisit record
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 5_000  # bounds an archive by this many segments, about 300 MB before compression
#: Bytes of blocks in one batch of read records.
BATCH_BYTES = 8 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sliced(data: Column, size: int) -> Column:
    """Slices of ``size`` bytes; none of empty data."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _text(data: Column) -> Column:
    return data.cast("string")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit("\r\n")), F.lit(""))


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The WARC records of pages (page_id, url, html) as one string column ``value``, without the closing line ends.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes those with the
    largest page_id are responses, the others revisit it.  Null ids are below all
    others; where all are null, all are responses.  A null html is an empty payload.
    Only counted digests meet in the aggregate, so a group of copies of any size is
    one row there.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("order_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    largest = base.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("order_id").alias("rep"), F.count("*").alias("copies"))
    rep = largest.where("copies > 1 and rep is not null").select("digest", "rep")
    b = base.join(rep, "digest", "left")
    revisit = F.col("rep").isNotNull() & ~F.col("order_id").eqNullSafe(F.col("rep"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    chunks = F.transform(_sliced(F.col("payload"), CHUNK_BYTES), lambda x: F.concat(F.hex(F.octet_length(x)), F.lit("\r\n"), _text(x), F.lit("\r\n")))
    chunked = F.concat(F.lit(http + "Transfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    block = F.when(revisit, F.lit(http + "\r\n")).otherwise(chunked).cast("binary")
    b = b.select("page_id", "url", "digest", revisit.alias("revisit"), _record_id(F.col("page_id"), F.col("digest")).alias("id"), _record_id(F.col("rep"), F.col("digest")).alias("refers"), block.alias("block"))
    b = b.withColumn("total", F.octet_length("block"))
    s = b.select("*", F.posexplode(_sliced(F.col("block"), SEGMENT_BYTES)).alias("seg", "piece")).drop("block")
    many, first = F.col("total") > SEGMENT_BYTES, F.col("seg") == 0
    last = (F.col("seg") + 1) * SEGMENT_BYTES >= F.col("total")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.when(first, F.col("id")).otherwise(_record_id(F.col("id"), F.col("seg").cast("string")))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.when(first, F.col("url"))),
        _field("WARC-Page-ID", F.when(first, F.col("page_id"))),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Profile", F.when(first & F.col("revisit"), F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(first & F.col("revisit"), F.col("refers"))),
        _field("WARC-Segment-Number", F.when(many, F.col("seg") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(many & last, F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length("piece")),
        F.lit("\r\n"),
    )
    return s.select(F.concat(head, _text(F.col("piece"))).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes gzipped archives of at most ``RECORDS_PER_FILE`` records each; a failed task's files are replaced."""
    out = page_records(pages, date).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(raw: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, read one record at a time."""
    stream = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    number = 0
    while line := stream.readline():
        number += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} has no WARC header")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the header of record {number} has no end")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} isn't closed")
        yield head, block


def dechunk(body: bytes) -> bytes:
    """Undoes chunked transfer framing; ValueError if it is cut off or malformed."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk isn't closed")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunk(body) if chunked else body


def assemble(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a segmented record: numbers from 1 on without a gap, of the declared total length."""
    by = dict(sorted(parts))
    if list(by) != list(range(1, len(by) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(by.values())
    if total is None or len(block) != total:
        raise ValueError("total length differs")
    return block


RECORD = "record_id string, page_id string, record_type string, refers_to_id string, declared string, origin string, seg int, total long, block binary, payload_bytes long, payload_digest string, error string"
READ = "record_id string, page_id string, record_type string, refers_to_id string, declared string, payload_bytes long, payload_digest string, error string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _settled(row: dict, block: bytes) -> dict:
    """Payload size and digest of a whole response, or what is wrong with it."""
    try:
        payload = http_payload(block)
        digest = hashlib.sha1(payload).hexdigest()
        if row["declared"] not in (None, digest):
            raise ValueError("payload digest differs")
        return row | {"payload_bytes": len(payload), "payload_digest": digest}
    except ValueError as e:
        return row | {"error": str(e)}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(RECORD)
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                seg, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
                row = {n: None for n in schema.names} | {
                    "record_id": head["warc-record-id"],
                    "page_id": head.get("warc-page-id"),
                    "record_type": head["warc-type"],
                    "refers_to_id": head.get("warc-refers-to"),
                    "declared": head["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in head else None,
                    "origin": head.get("warc-segment-origin-id", head["warc-record-id"]),
                }
                if seg is not None:
                    row |= {"seg": int(seg), "total": int(total) if total else None, "block": block}
                elif row["record_type"] == "response":
                    row = _settled(row, block)
                rows.append(row)
                size += len(row["block"] or b"") + 1024
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(READ)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            row = {n: r.get(n) for n in schema.names}
            if r["parts"]:
                try:
                    row = _settled(row, assemble([(p["seg"], p["block"]) for p in r["parts"]], r["total"]))
                except ValueError as e:
                    row["error"] = str(e)
                if row["record_id"] is None:
                    row |= {"record_id": r["origin"], "record_type": "response"}
            rows += [row] * max(1, r["copies"])
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``, segments put together.

    ``error`` tells what is wrong with a damaged response (a segment missing, a
    wrong total length, framing cut off, digest differs); it has no payload then.
    Repeated records come as often as they were written.  Only segments of one
    record meet in a group, equal ones once; whole records pass it without their block.  An archive,
    of one gzip member or many, is unpacked as a stream: a task holds its packed bytes and one batch of records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(_parsed, RECORD)
    head = F.coalesce(F.col("seg"), F.lit(1)) == 1
    part = F.when(F.col("seg").isNotNull(), F.struct("seg", "block"))
    names = ("record_id", "page_id", "record_type", "refers_to_id", "declared")
    grouped = rows.groupBy("origin").agg(
        *(F.max(F.when(head, F.col(c))).alias(c) for c in names),
        F.max("total").alias("total"),
        F.max("payload_bytes").alias("payload_bytes"),
        F.max("payload_digest").alias("payload_digest"),
        F.max("error").alias("error"),
        F.collect_set(part).alias("parts"),
        F.sum(head.cast("int")).alias("copies"),
    )
    return grouped.mapInArrow(_joined, READ)


def resolved(records: DataFrame) -> DataFrame:
    """Pages from records: revisits get size and digest of the response that they refer to.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, error.  A
    revisit whose response is missing, or has another digest than it declares, has an error.
    """
    table = cut(records, "warc-records")
    found = table.where("record_type = 'response'").groupBy("record_id").agg(
        F.max("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes"), F.max("payload_digest").alias("to_digest")
    )
    back = table.where("record_type = 'revisit'").join(found.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    wrong = F.when(F.col("to_digest").isNull(), "response is missing").when(F.col("to_digest") != F.col("declared"), "payload digest differs")
    whole = table.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"), "error")
    return whole.unionByName(
        back.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"), wrong.alias("error"))
    )
