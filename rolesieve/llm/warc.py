"""WARC archives of captured pages, written by Spark and read back as one nested row per capture."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import stored

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Fixed values of the format.
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, "
          "payload binary, payload_bytes long, intact boolean, fields map<string,string>")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record as text, without the blank lines that end it."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Record-ID: "), record_id]
    for name, value in headers:
        lines += [F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, r"[\r\n]+", " ")))]
    return F.concat(*lines, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def capture_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Each page's request, its response or revisit, and its metadata record, as rows of text ``value``.

    Of pages with equal payloads, which are told by digests, that with the smallest page_id holds the
    payload.  Only digests are grouped; they are summed up in the tasks, and the join of ids with the
    few digests that come again is left to adaptive execution, which splits a digest of many pages.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    keys = stored(p.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = keys.join(stored(firsts.select("digest", "first"), "firsts"), "digest").where("page_id > first")
    again = stored(again.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to")), "revisits")
    nth = Window.partitionBy("page_id", "digest").orderBy("url")
    p = p.join(again, ["page_id", "digest"], "left").withColumn("copy", F.row_number().over(nth))
    name = lambda page, copy, kind: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(":"), copy.cast("string"), F.lit(f":{kind}>"))
    main = name(F.col("page_id"), F.col("copy"), "capture")
    uri = ("WARC-Target-URI", F.coalesce("url", F.lit("")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END))
    captured = F.when(F.col("refers_to").isNull(), _record("response", main, [uri, digest], "application/http; msgtype=response", F.concat(http, "html"))).otherwise(
        _record("revisit", main, [uri, digest, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", name(F.col("refers_to"), F.lit(1), "capture"))],
                "application/http; msgtype=response", http))
    request = _record("request", name(F.col("page_id"), F.col("copy"), "request"), [("WARC-Concurrent-To", main), uri], "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20"), F.lit(" HTTP/1.1"), F.lit(_END)))
    fields = F.concat(F.lit("page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayloadLength: "), F.octet_length("html").cast("string"),
                      F.coalesce(F.concat(F.lit("\r\nrefersToPage: "), F.col("refers_to").cast("string")), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", name(F.col("page_id"), F.col("copy"), "metadata"), [("WARC-Concurrent-To", main), uri], "application/warc-fields", fields)
    return p.select(F.explode(F.array(request, captured, metadata)).alias("value"))


def write(records: DataFrame, path: str, per_file: int = 60_000) -> None:
    """Write record texts as gzipped archives, by Spark's own writer into any store it knows."""
    (records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a binary stream; blank lines between are skipped."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, payload, fields = headers["warc-type"], None, {}
    digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n") if x)}
    own = hashlib.sha256(payload).hexdigest() if payload is not None else None
    return {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "payload_digest": own or digest, "payload": payload,
        "payload_bytes": None if payload is None else len(payload), "intact": None if payload is None or digest is None else own == digest, "fields": list(fields.items()),
    }


def read(spark: SparkSession, path: str, most: int = 4 << 20) -> DataFrame:
    """Records of the gzipped archives under a folder, a row each; a task streams through its archives."""
    kind = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
        ("payload_digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for headers, block in parse(stream):
                        rows.append(_row(headers, block))
                        held += len(block) + 500
                        if held > most:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(work, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, capture, request, metadata), joined by concurrent-to.

    Captures are responses and revisits.  A missing request or metadata record is null; of several,
    that with the smallest id is taken; a record of no capture is left out.
    """
    nested = F.struct(*(c for c in records.columns))
    first = lambda kind: records.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", "target_uri", "fields"), "record_id").alias(kind))
    captures = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", nested.alias("capture"))
    return captures.join(first("request"), "record_id", "left").join(first("metadata"), "record_id", "left")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read them back as transactions().

    Null html is an empty payload and a null url an empty address; a null page_id makes a response.
    Repeated rows are captures of their own and, where they hold the smallest id, all responses.  An
    empty table gives no rows; other columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "archives")
    write(capture_records(pages, least), path)
    return transactions(read(pages.sparkSession, path))


def digest(captures: DataFrame) -> DataFrame:
    """The columns of the contract from the rows of transactions()."""
    field = lambda name: F.col("metadata.fields")[name]
    page = F.when(field("page") != "", field("page")).cast("long")
    return captures.select(
        page.alias("page_id"), F.coalesce("capture.payload_bytes", field("payloadLength").cast("long")).alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.record_type").alias("record_type"),
        field("refersToPage").cast("long").alias("refers_to"), F.col("request.record_id").isNotNull().alias("has_request"),
        F.coalesce("capture.intact", F.lit(True)).alias("intact"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id > first THEN first END AS refers_to, true AS has_request, true AS intact
FROM f
"""
