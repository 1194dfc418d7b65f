"""WARC: a native writer and a salvage reader.

Writing: one record a row, put together by column functions and written by Spark's text writer with
the record end as line separator, so the files are plain WARC, land on any file system Spark
reaches, and are committed task by task.  Reading: a file is parsed record by record; where a check fails
(version line, headers, length, digest, gzip member) the reader looks for the next version line or
gzip member that holds a valid record, goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .marks import marked, marks_of
from .work import Work, parts_for, utf8

PIECE = 1 << 14
END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hex digits, with column functions: ten hex digits are eight signs."""
    signs = F.concat(*(F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(signs, "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _record(kind, page_id, url, digest, refers_to, stamp: str):
    """Head of a record with an id made from page_id; the payload, empty for a revisit, follows it."""
    uri = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), uri(page_id), F.lit("\r\nWARC-Target-URI: "), clean,
        F.lit(f"\r\nWARC-Date: {stamp}\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(refers_to.isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(refers_to))).otherwise(""),
    )


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null where the page is a response)."""
    body = utf8(F.col("html").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("hash", F.sha1("payload"))
    work = Work(pages.sparkSession, "warc-plan")
    dup = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    dup = work.put(dup, "repeated")
    # A bitmap of fixed size tells which payloads may be repeated; only those go through the join.
    marks = marks_of(dup.select(F.xxhash64("hash").alias("h")), "h")

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(marked(marks, h.to_numpy().view(np.uint64)))

    flagged = rows.withColumn("maybe", may_repeat(F.xxhash64("hash")))
    found = flagged.where("maybe").join(dup, "hash", "left").unionByName(flagged.where("not maybe").withColumn("first", F.lit(None).cast("long"))).drop("maybe")
    return found.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).withColumn("digest", base32(F.col("hash"))).drop("hash", "first")


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 8 << 20, stamp: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored).

    Null html: an empty payload.  Of equal payloads of at least ``min_bytes`` bytes, the smallest page_id is the
    response and the others revisit it; rows that repeat the smallest page_id are responses too.
    A null page_id: a response of its own with the id ``<urn:page:null>``, read back as null.
    An empty table gives no records.  A revisit says its full payload's length in a header of its own.
    """
    total, n = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")) + 500), F.count("*")).first()
    rows = plan(pages, min_bytes)
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    head = _record(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("refers_to"), stamp)
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    sized = F.concat(head, F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    files = rows.select(F.concat(F.encode(sized, "UTF-8"), body).cast("string").alias("value"))
    each = max(1, n // parts_for(total, file_bytes))
    files.select("value").write.option("lineSep", END.decode()).option("maxRecordsPerFile", each).text(path)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers in lower case, block, end.  ValueError where a check fails."""
    m = _VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = data.find(END, m.end())
    if stop < 0:
        raise ValueError("no end of headers")
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("bad length")
    first = stop + len(END)
    last = first + int(headers["content-length"])
    if data[last : last + 4] != END:
        raise ValueError("no record end at the stated length")
    block = data[first:last]
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if stated and headers.get("warc-type") != "revisit" and stated != digest_of(block):
        raise ValueError("payload digest differs")
    return headers, block, last + 4


def _member(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record in the gzip member at ``at``; ValueError where it doesn't inflate to one record."""
    z, parts, view, end = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not z.eof and end < len(data):  # piece by piece: what follows the member isn't touched
            piece = view[end : end + PIECE]
            parts.append(z.decompress(piece))
            end += len(piece)
    except zlib.error as e:
        raise ValueError("bad gzip member") from e
    if not z.eof:
        raise ValueError("cut gzip member")
    plain, after = b"".join(parts), end - len(z.unused_data)
    headers, block, end = parse(plain)
    if end != len(plain):
        raise ValueError("more than a record in a member")
    return headers, block, after


_START = re.compile(rb"WARC/\d+\.\d+\r?\n|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """(kind, start, end, headers, block, reason) in file order; kind is 'record' or 'gap'."""
    at = gap = 0
    reason = ""
    while at < len(data):
        try:
            headers, block, end = _member(data, at) if data.startswith(b"\x1f\x8b", at) else parse(data, at)
        except ValueError as e:
            reason = reason or str(e)
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap < at:
            yield "gap", gap, at, {}, b"", reason
        yield "record", at, end, headers, block, ""
        at, gap, reason = end, end, ""
    if gap < len(data):
        yield "gap", gap, len(data), {}, b"", reason


READ = "file string, kind string, start long, end long, headers map<string,string>, block binary, reason string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all files under ``path``, damaged ones included."""

    def run(batches):
        names = [x.split()[0] for x in READ.replace("map<string,string>", "map").split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, end, headers, block, reason in salvage(data.as_py()):
                    rows.append((name, kind, start, end, list(headers.items()), block, reason))
                    size += len(block)
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the records say of each page; the digest and length of responses are those of the bytes read."""
    records = read(spark, path).where("kind = 'record'")
    ident = lambda c: F.nullif(F.regexp_extract(F.col("headers")[c], r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    own = F.col("headers")["warc-type"] == "response"
    return records.select(
        ident("warc-record-id").alias("page_id"),
        F.when(own, F.octet_length("block")).otherwise(F.col("headers")["x-payload-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(own, base32(F.sha1("block"))).otherwise(F.substring(F.col("headers")["warc-payload-digest"], 6, 32)).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        F.when(~own, F.regexp_extract(F.coalesce(F.col("headers")["warc-refers-to"], F.lit("")), r"<urn:page:(-?\d+)>", 1).cast("long")).alias("refers_to"),
    )
