"""WARC archives written and read by Spark, and captures assembled from their records.

A capture is three records: the request and the metadata name the response (or revisit) in
WARC-Concurrent-To. Files come from Spark's text writer, whose line separator is the blank
pair of lines that ends a record; so they survive lost executors like any other output.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_folder, written

DATE, AGENT = "2024-01-01T00:00:00Z", "tessera"
END = "\r\n\r\n"
RECORDS_PER_FILE = 3000


def base32_sha1(column: str):
    """Upper-case base32 SHA-1 of a string column: 4 times 5 bytes as 8 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(column), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts):
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str, rid, content_type: str, headers: list, block):
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), rid]
    for name, value in headers:
        lines += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*lines, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes request, response or revisit, and metadata records of every page under path, gzipped.

    Of pages with equal payloads of at least least_bytes, the one with the smallest id is the
    response and the others revisit it, those without an id among them; where none has an id, all are responses. A null payload is empty, a null url the empty string.
    Rows that repeat id, url and payload get the same record ids: they are one capture.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(html_col, F.lit("")).alias("html"),
    )
    digests = rows.select("page_id", "url", base32_sha1("html").alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least_bytes)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = digests.groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n"))
    first_rid = _uuid(F.lit("response"), F.col("first.page_id").cast("string"), F.col("first.url"), F.col("digest"))
    firsts = firsts.filter("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first_id"), first_rid.alias("first_rid"))
    revisits = digests.join(firsts, "digest").filter("page_id > first_id or page_id is null").select("page_id", "digest", "first_rid").distinct()
    # few rows of ids against the pages: by id and not by digest, so a payload that many share is no hot key
    rows = rows.withColumn("digest", base32_sha1("html"))
    revisits = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_rid")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rid = _uuid(F.lit("response"), page, F.col("url"), F.col("digest"))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), "^$", "/")
    rows = rows.select("*", rid.alias("rid"), F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(f"\r\nUser-Agent: {AGENT}{END}")).alias("ask"), page.alias("page"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    uri, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http, concurrent = "application/http; msgtype=", ("WARC-Concurrent-To", F.col("rid"))
    full = _record("response", F.col("rid"), http + "response", [uri, digest], F.concat(head, F.col("html")))
    again = _record("revisit", F.col("rid"), http + "response", [uri, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.col("first_rid"))], head)
    ask = _record("request", _uuid(F.lit("request"), F.col("rid")), http + "request", [uri, concurrent], F.col("ask"))
    meta = _record("metadata", _uuid(F.lit("metadata"), F.col("rid")), "application/warc-fields", [uri, concurrent], F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(ask, F.when(F.col("r_digest").isNull(), full).otherwise(again), meta)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "kind string, record_id string, concurrent_to string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, payload binary, fields string"


def _parse(raw: io.BufferedReader, keep_payload: bool) -> Iterator[tuple]:
    while True:
        line = raw.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        headers = {}
        while (line := raw.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = raw.read(int(headers["content-length"]))
        kind, payload, size, digest, fields = headers["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                named = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                size, digest, payload = int(named[b"content-length"]), headers["warc-payload-digest"].partition(":")[2], None
        elif kind == "metadata":
            fields = block.decode()
        yield kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), headers.get("warc-payload-digest", "").partition(":")[2] or None, size, digest, payload if keep_payload else None, fields


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row per record of the archives under path, payloads measured and digested as they are read. A task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        for batch in batches:
            for content in batch.column("content"):
                with gzip.open(io.BytesIO(content.as_buffer())) as raw:
                    rows = []
                    for record in _parse(io.BufferedReader(raw, 1 << 16), keep_payload):
                        rows.append(record)
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, refers_to_page, request, response, metadata, assembled through WARC-Concurrent-To.

    A record repeated with the same id counts once. A response without its request or metadata
    keeps null there; requests and metadata without a response are left out. page_id comes from the
    metadata; refers_to_page is the page of the response whose record id a revisit names, null where
    no such response is among the records. The records are read once: a capture's meet in one
    aggregation by the id they share, and the captures are stored.
    """
    is_response = F.col("kind").isin("response", "revisit")
    own = F.struct("record_id", "kind", "target_uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload")
    by = records.withColumn("capture_id", F.when(is_response, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture_id is not null").groupBy("capture_id")
    found = by.agg(
        F.min(F.when(is_response, own)).alias("response"),
        F.min(F.when(F.col("kind") == "request", F.struct("record_id", "target_uri"))).alias("request"),
        F.min(F.when(F.col("kind") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    ).filter("response is not null")
    page = F.expr("try_cast(nullif(regexp_extract(metadata.fields, 'page-id: ?([^\\\\r\\\\n]*)', 1), '') as bigint)")
    found = written(found.select(page.alias("page_id"), "request", "response", "metadata"), "captures")
    targets = found.filter("response.kind = 'response'").select(F.col("response.record_id").alias("target"), F.col("page_id").alias("refers_to_page"))
    named = found.select(F.col("response.refers_to").alias("target")).filter("target is not null").distinct()
    targets = targets.join(named, "target", "left_semi").groupBy("target").agg(F.min("refers_to_page").alias("refers_to_page"))
    return found.join(targets, F.col("response.refers_to") == F.col("target"), "left").select("page_id", "refers_to_page", "request", "response", "metadata")


def archive_pages(pages: DataFrame, least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Writes the pages as archives into the shared folder and returns the captures read back from them. An empty table gives an empty one; other columns are left out."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return captures(read_records(pages.sparkSession, path, keep_payload))
