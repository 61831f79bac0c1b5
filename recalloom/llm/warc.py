"""WARC archives: records written by Spark's text sink, read back by a salvaging reader.

Writing: one record per row, payload the text in UTF-8. Of rows with equal payloads of at least
``min_revisit_bytes`` the one with the largest id is a response, the others are revisits that
refer to it; smaller payloads are all responses.

Reading: records are checked (version line, headers, length, ending, digests of block and payload). After a
failed check the reader searches for the next version line or gzip member that passes, goes on
from there, and reports the bytes in between as a gap.

Edges: null text is an empty payload. A null id is smaller than any other; rows repeated with
the largest id and the same payload are all responses. An empty table gives no archives and no
records. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_bounded, stored

# Archives are read whole by one task each, so they are kept short.
RECORDS_PER_FILE = 2000

_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

READ_SCHEMA = ("file string, kind string, start bigint, end bigint, record_type string, record_id string, uri string, "
               "refers_to string, payload_digest string, payload_length bigint, payload binary, reason string")


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time are four letters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def with_roles(pages: DataFrame, id_col: str, text_col: str, min_revisit_bytes: int) -> DataFrame:
    """``id, text, digest, bytes, refers_to``; ``refers_to`` is null for responses."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                        *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(pages.columns)])
    rows = rows.withColumn("digest", sha1_base32(F.col("text").cast("binary"))).withColumn("bytes", F.octet_length("text"))
    # Only digests travel; of these only those of several rows are joined back.
    repeated = (rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
                .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"))
    repeated = broadcast_if_bounded(stored(repeated, "payloads"))
    joined = rows.join(repeated, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))).drop("last")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                   min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` below ``path`` as archives of at most ``RECORDS_PER_FILE`` records."""
    rows = with_roles(pages, id_col, text_col, min_revisit_bytes)
    url = F.col(f"other_{pages.columns.index(url_col)}")
    url = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit, crlf = F.col("refers_to").isNotNull(), "\r\n"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(crlf + crlf))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("text")))
    rows = rows.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                       "\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Block-Digest: sha1:"), sha1_base32(F.col("block").cast("binary")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(crlf + crlf), F.col("block"), F.lit(crlf))
    # The sink ends each row by CR LF, the second of the two that end a record.
    (rows.select(record.alias("value")).write.option("lineSep", crlf)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _payload_fits(headers: dict[str, str], block: bytes) -> bool:
    """Whether the payload has the digest stated for it; true where none is stated.

    Two records run together may have a block that fits the headers nearest to it.
    """
    stated = headers.get("warc-payload-digest", "")
    if not stated.lower().startswith("sha1:"):
        return True
    if headers.get("content-type", "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return stated[5:].upper() == base64.b32encode(hashlib.sha1(block).digest()).decode()


def _parse(data: bytes, at: int) -> tuple[int, dict] | str:
    """(end, record) of the record at ``at``, or which check failed."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "headers cut off"
    headers: dict[str, str] = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys():
        return "header missing"
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        return "bad length"
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return "block cut off" if end + 4 > len(data) else "no end after block"
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    if stated.lower().startswith("sha1:") and stated[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return "block digest differs"
    if headers["warc-type"].lower() == "response" and not _payload_fits(headers, block):
        return "payload digest differs"
    return end + 4, {"headers": headers, "block": block}


def _member(data: bytes, at: int) -> tuple[int, list[dict]] | str:
    """(end, records) of the gzip member at ``at``, or which check failed."""
    unpack = zlib.decompressobj(31)
    try:
        plain = unpack.decompress(memoryview(data)[at:])
    except zlib.error:
        return "bad gzip member"
    if not unpack.eof:
        return "gzip member cut off"
    records, inside = [], 0
    while inside < len(plain):
        found = _parse(plain, inside)
        if isinstance(found, str):
            return f"in gzip member: {found}"
        inside, record = found
        records.append(record)
    return len(data) - len(unpack.unused_data), records


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, record) and ("gap", start, end, reason), in order, covering all bytes."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        zipped = data.startswith(b"\x1f\x8b\x08", at)
        found = _member(data, at) if zipped else _parse(data, at)
        if isinstance(found, str):
            if bad < 0:
                bad, why = at, found
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad >= 0:
            yield "gap", bad, at, why
            bad = -1
        end, records = found
        for record in records if zipped else [records]:
            yield "record", at, end, record
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), why


def _row(file: str, kind: str, start: int, end: int, what: dict | str) -> tuple:
    if kind == "gap":
        return file, kind, start, end, None, None, None, None, None, None, None, what
    headers, block = what["headers"], what["block"]
    payload, length = block, len(block)
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, split, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        payload = payload if split else b""
        length = int(stated[1]) if stated else len(payload)
    return (file, kind, start, end, headers["warc-type"].lower(), headers["warc-record-id"], headers.get("warc-target-uri"),
            headers.get("warc-refers-to"), headers.get("warc-payload-digest"), length, payload, None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``READ_SCHEMA``: a row per recovered record, and one of kind ``gap`` per lost span."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for found in salvage(data.as_py()):
                    rows.append(_row(file, *found))
                    held += found[2] - found[1]
                    if held > 8 << 20:
                        schema = schema or _arrow_schema()
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    schema = schema or _arrow_schema()
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, READ_SCHEMA)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in READ_SCHEMA.split(", "))])


def page_of(record_id: Column) -> Column:
    """The id that ``write_archives`` put into a record id; null for a row without one."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint")
