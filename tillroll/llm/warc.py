"""WARC archives: one request, response (or revisit) and metadata record per capture, and back.

Writing is a projection to one string per record and Spark's text writer, whose line separator is
the two line ends that close a record; files are gzip-compressed and hold a bounded number of
records. Reading follows Content-Length through each file. Records become captures by joining
requests and metadata to the response or revisit that their WARC-Concurrent-To names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.common import map_batches, small_side, staged

#: Payloads of at least so many bytes are stored once.
DEDUP_BYTES = 1000
RECORDS_PER_FILE = 6000
#: Rows of payload digests that are sent to every task; beyond that pages are shuffled by digest.
DIGEST_ROWS = 200_000

_RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("http_head", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string())])
_RECORDS_SQL = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "http_head string, payload binary, payload_bytes long, payload_digest string, declared_digest string")


def _record_id(kind: str, page_id: str, url: str, digest: str, number: Column):
    """A name that follows from the page and its number among equal ones alone, so that a task run
    again writes the same record."""
    parts = [F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.coalesce(F.col(url), F.lit("-")), F.col(digest)]
    parts.append(F.when(number > 1, number.cast("string")))
    return F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws("\n", F.lit(kind), *parts)), F.lit(">"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with number, which counts equal rows from 1. Only rows that may have an equal are moved."""
    key = F.xxhash64("page_id", "url", "payload")
    several = staged(rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "repeats")
    if several.isEmpty():
        return rows.withColumn("number", F.lit(1))
    keyed, several = rows.withColumn("key", key), small_side(several, DIGEST_ROWS)
    equal = keyed.join(several, "key", "left_semi").withColumn(
        "number", F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy("size")))
    return keyed.join(several, "key", "left_anti").withColumn("number", F.lit(1)).unionByName(equal).drop("key")


def _record(kind: str, headers: dict, block) -> F.Column:
    """One record without its closing line ends; headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives of pages (page_id, url, html) in the folder at path.

    The payload is html in UTF-8, empty if null. Of rows with equal payloads of at least
    DEDUP_BYTES bytes the one with the largest page_id (of those the largest url) is a response,
    the others are revisits of it; a null page_id is the smallest. A null url gives no target. Each
    of several equal rows is a capture of its own, of the kind of the first.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    rows = _numbered(rows)
    # Only digests that several rows have; the count and the largest row combine inside tasks.
    shared = (
        rows.filter(F.col("size") >= DEDUP_BYTES).groupBy("digest")
        .agg(F.count("*").alias("rows"), F.max(F.struct("page_id", "url")).alias("best")).filter("rows > 1")
        .select("digest", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"))
    )
    rows = rows.join(small_side(staged(shared, "digests"), DIGEST_ROWS), "digest", "left")
    again = F.col("best_id").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("best_id")) & F.col("url").eqNullSafe(F.col("best_url")))
    rows = rows.withColumn("again", again & (F.col("size") >= DEDUP_BYTES))
    capture, target = _record_id("capture", "page_id", "url", "digest", F.col("number")), F.col("url")
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": target}
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = "application/http; msgtype="
    response = _record("response", {
        "WARC-Record-ID": capture, **common, "WARC-Payload-Digest": digest, "Content-Type": F.lit(http + "response"),
    }, F.concat(head, F.col("payload")))
    revisit = _record("revisit", {
        "WARC-Record-ID": capture, **common, "WARC-Payload-Digest": digest, "Content-Type": F.lit(http + "response"),
        "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "WARC-Refers-To": _record_id("capture", "best_id", "best_url", "digest", F.lit(1)),
    }, head)
    request = _record("request", {
        "WARC-Record-ID": _record_id("request", "page_id", "url", "digest", F.col("number")), **common, "WARC-Concurrent-To": capture,
        "Content-Type": F.lit(http + "request"),
    }, F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", {
        "WARC-Record-ID": _record_id("metadata", "page_id", "url", "digest", F.col("number")), **common, "WARC-Concurrent-To": capture,
        "Content-Type": F.lit("application/warc-fields"),
    }, F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _parse(stream) -> Iterator[tuple]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the line ends after a record
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers.get("content-length") or 0))
        kind, head, payload = headers.get("warc-type"), None, block
        if headers.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            head = top.decode("utf-8", "replace")
        declared = headers.get("warc-payload-digest")
        yield (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
               headers.get("warc-target-uri"), headers.get("warc-date"), head, payload, len(payload),
               hashlib.sha1(payload).hexdigest(), declared.partition(":")[2].lower() if declared else None)


def _emit_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = pa.BufferReader(content.as_buffer())
            stream = io.BufferedReader(data if content.as_buffer()[:2].to_pybytes() != b"\x1f\x8b" else gzip.GzipFile(fileobj=data))
            rows, size = [], 0
            for row in _parse(stream):
                rows.append(row)
                size += row[8] + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives (plain or gzip) in the folder at path; payload_bytes and
    payload_digest (SHA-1, hex) are of the payload that was read, declared_digest is the header's.
    A file is read by one task and has to be below Spark's limit for a value, 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_batches(files, _emit_records, _RECORDS_SQL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, date, response, request, metadata.

    response is the response or revisit record with payload_bytes and payload_digest of the full
    payload, which a revisit takes from the record it refers to (null if that is missing);
    request is the concurrent request or null; metadata is an array of payload texts. Records
    repeated under one id count once; requests and metadata without a capture give no row.
    """
    main = records.filter("record_type IN ('response', 'revisit') AND record_id IS NOT NULL").dropDuplicates(["record_id"])
    # A response refers to itself here, so its rows have keys of their own instead of null.
    main = main.withColumn("origin", F.coalesce("refers_to", "record_id"))
    stored = main.filter("record_type = 'response'").select(
        F.col("record_id").alias("origin"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    main = main.join(stored, "origin", "left").select(
        "record_id", "target_uri", "date", F.struct(
            "record_type", "refers_to", "http_head", "payload", F.col("full_bytes").alias("payload_bytes"),
            F.col("full_digest").alias("payload_digest"), "declared_digest").alias("response"))
    beside = records.filter("record_type IN ('request', 'metadata')").dropDuplicates(["record_id"])
    beside = beside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.min(F.when(F.col("record_type") == "request", F.struct(F.col("record_id").alias("request_id"), "http_head"))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", F.decode("payload", "UTF-8")))).alias("metadata"))
    return main.join(beside, "record_id", "left")


def digest_rows(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures of write()'s
    archives: page_id is read from the metadata, refers_to is the page_id of the response."""
    number = F.regexp_extract(F.concat_ws("\n", "metadata"), r"page-id: (-?\d*)", 1)
    rows = found.select(
        "record_id", F.when(number != "", number.cast("long")).alias("page_id"), "response.payload_bytes",
        "response.payload_digest", "response.record_type",
        F.coalesce("response.refers_to", "record_id").alias("origin"))
    # Both sides of the join are these narrow rows, so the archives aren't parsed once for each.
    rows = staged(rows, "digest-rows")
    origins = rows.filter("record_type = 'response'").select(F.col("record_id").alias("origin"), F.col("page_id").alias("of"))
    refers_to = F.when(F.col("record_type") == "revisit", F.col("of")).alias("refers_to")
    return rows.join(origins, "origin", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", refers_to)
