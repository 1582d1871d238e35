"""WARC archives with revisit records for repeated payloads.

Headers (page id, payload digest and length) are computed first and shuffled by digest without the
payloads; each digest's smallest page id becomes the original response. The pages then join that
small table, and every row is written as one WARC/1.1 record with a fresh header: a ``response``
with its payload or a ``revisit`` that names the original and carries only the HTTP header.

Spark's text writer stores one record a row with the record terminator CRLF CRLF as line separator,
so archives land in whatever store Spark writes to. Reading parses records by Content-Length, so
payloads may hold any separator, and joins revisit records to the responses that they name.

Edge cases: a null payload is empty; payloads shorter than ``min_bytes`` are always responses; rows
that repeat the smallest page id of a digest are all responses; a null page id never becomes the
original of other pages, and pages that all lack an id are all responses; control characters in a
URL are percent-encoded; a null URL omits the header; an empty table writes no record. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_path

END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [x or b"" for x in batch["payload"].cast("binary").to_pylist()]
        yield pa.record_batch([batch["page_id"], pa.array(map(_base32_sha1, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())], names=["page_id", "payload_digest", "payload_bytes"])


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}{END}".encode()


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, original_url: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record without its terminator."""
    digest = _base32_sha1(payload)
    named = "none" if page_id is None else str(page_id)
    block = _http(len(payload)) + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{named}:{digest}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Refers-To-Date", DATE)]
        if original_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _clean(original_url)))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields).encode() + END.encode() + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch["payload"].cast("binary").to_pylist()
        rows = zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), payloads, batch["refers_to"].to_pylist(), batch["original_url"].to_pylist(), batch["revisit"].to_pylist(), strict=True)
        made = [record(i, u, p or b"", r, o, v).decode() for i, u, p, r, o, v in rows]
        yield pa.record_batch([pa.array(made, pa.string())], names=["value"])


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to, original_url) for each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    heads = settle(rows.select("page_id", "payload").mapInArrow(_headers_of, "page_id long, payload_digest string, payload_bytes long"), "warc-heads")
    long_enough = heads.where(F.col("payload_bytes") >= min_bytes)
    first = long_enough.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    revisits = long_enough.join(first, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to")
    # Only repeated payloads reach this point, so these joins touch their headers and not the pages' bodies.
    originals = rows.select(F.col("page_id").alias("refers_to"), F.col("url").alias("original_url")).join(revisits.select("refers_to").distinct(), "refers_to", "left_semi").groupBy("refers_to").agg(F.min("original_url").alias("original_url"))
    told = revisits.join(originals, "refers_to", "left").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to", "original_url").distinct()
    keyed = rows.withColumn("_key", _base32_of_sha1(F.coalesce(F.col("payload"), F.lit(""))))
    joined = keyed.join(told, keyed["page_id"].eqNullSafe(told["_page"]) & (keyed["_key"] == told["_digest"]), "left")
    return joined.select("page_id", "url", "payload", F.col("_digest").isNotNull().alias("revisit"), "refers_to", "original_url")


def _base32_of_sha1(text):
    """Upper-case base32 of the SHA-1 as a column: each 5 hex digits are 4 symbols."""
    hexed = F.sha1(text.cast("binary"))
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        number = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [alphabet.substr((F.shiftright(number, 15 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, max_records: int = 5_000, compression: str = "gzip") -> None:
    """Write deduplicated archives under ``path``, at most ``max_records`` records a file."""
    resolved = resolve_revisits(pages, id_col, url_col, payload_col, min_bytes)
    resolved.mapInArrow(_records, "value string").write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", max_records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (header fields, payload) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 8] != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in data[at : body - 4].decode().split("\r\n")[1:])
        end = body + int(fields["Content-Length"])
        block = data[body:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no terminator at byte {end}")
        yield fields, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = lambda urn: None if (x := urn.split(":")[2]) == "none" else int(x)
    for batch in batches:
        for content in batch["content"]:
            data = content.as_py()
            rows: list[tuple] = []
            size = 0
            for f, payload in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                revisit = f["WARC-Type"] == "revisit"
                rows.append((page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], page(f["WARC-Refers-To"]) if revisit else None, f["WARC-Payload-Digest"].removeprefix("sha1:"), None if revisit else len(payload), None if revisit else payload.decode()))
                size += len(payload)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as stored; revisits have null ``payload`` and ``payload_bytes``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parsed, READ_SCHEMA)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record with revisits resolved to the response that they name."""
    records = read_records(spark, path)
    columns = [c for c in records.columns if with_payload or c != "payload"]
    plain = records.where("record_type = 'response'").select(columns)
    revisits = records.where("record_type = 'revisit'").drop("payload", "payload_bytes")
    bodies = [c for c in ("payload_bytes", "payload") if c in columns]
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", *bodies).dropDuplicates(["refers_to", "payload_digest"])
    return plain.unionByName(revisits.join(originals, ["refers_to", "payload_digest"], "left").select(columns))


def write_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    return read_warc(pages.sparkSession, path, with_payload=False)
