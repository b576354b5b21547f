"""Content-addressed archive of WARC records.

A record is its header block, byte for byte, and its payload. The archive has two tables: headers (record, place, header,
key of the payload) and payloads (key, bytes), each payload once. The key is the payload's SHA-256 digest, its length and a
second hash (xxhash64): the digest counts as verified where all its payloads agree in length and second hash, and payloads that
ever shared a digest without that would be kept apart. Which record's copy is stored (the least id, then the first row) is decided
from keys alone, so payload bytes are shuffled only by `restore`, which rebuilds the records by a join on the key and checks
each payload's digest anew.

`parse` cuts WARC files (plain, or compressed member by member) into records; `records_of_pages` makes response records of a table of pages.

Defined results: rows without payload (null) are headers with a null key and restore to their header alone; an empty payload is
a payload; rows that repeat an id are records of their own; null ids are carried; a null url leaves out its header line; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

BROADCAST_ROWS = 2_000_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def records_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """record_id, header, payload: a response record for each page."""
    p = pages.select(F.col("page_id").cast("long").alias("record_id"), "url", F.encode("html", "UTF-8").alias("payload"))
    name = F.sha2(F.concat_ws(" ", F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"), 256)
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Record-ID: <urn:sha256:"), name, F.lit(">")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2("payload", 256)),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("string")),
    ]
    return p.select("record_id", F.encode(F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END)), "UTF-8").alias("header"), "payload")


def parse(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header block, payload) of each record of a WARC file. Of damaged records (no end of the header, no length, or no blank
    lines where the payload should end) nothing is given, and the next line that begins with WARC/ begins the next one; a damaged
    compressed member is left out up to the next that can be unpacked. The last record may lack its blank lines."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_members(data))
    at = 0 if data.startswith(b"WARC/") else data.find(b"\nWARC/") + 1 or len(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        header = data[at : end + 4] if end >= 0 else b""
        size = next((line.split(b":", 1)[1].strip() for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
        after = end + 4 + int(size) if size.isdigit() else -1
        whole = b"\r\nWARC/" not in header and 0 <= after <= len(data) and (after == len(data) or data.startswith(b"\r\n", after))
        if whole:
            yield at, header, data[end + 4 : after]
            while data.startswith(b"\r\n", after):
                after += 2
            if data.startswith(b"WARC/", after):
                at = after
                continue
        at = data.find(b"\nWARC/", after - 1 if whole else at) + 1 or len(data)


def _members(data: bytes) -> Iterator[bytes]:
    """The unpacked members of a compressed file that are whole."""
    while data:
        member = zlib.decompressobj(31)
        try:
            out = member.decompress(data) + member.flush()
        except zlib.error:
            out = b""
        if member.eof and out:
            yield out
        data = member.unused_data if member.eof else data[1:]
        data = data[max(0, data.find(b"\x1f\x8b\x08")) :] if b"\x1f\x8b\x08" in data else b""


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, record_id (offset in the unpacked file), header, payload of WARC files; a file is read as a whole by one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = list(parse(content))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["file", "record_id", "header", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, record_id long, header binary, payload binary")


def archive(records: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written. headers: record_id, row_id, header, digest, length, second, verified. payloads: digest, length, second,
    payload. The records must be made row by row from a table or checkpoint, as they are read twice and known by their place."""
    r = records.select(F.monotonically_increasing_id().alias("row_id"), F.col("record_id").cast("long").alias("record_id"), "header", "payload")
    key = [F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length"), F.xxhash64("payload").alias("second")]
    some = F.col("payload").isNotNull()
    made = r.select("row_id", "record_id", "header", *[F.when(some, k).alias(n) for k, n in zip(key, ("digest", "length", "second"))])
    made = written(made, "warc-headers")
    names = ["digest", "length", "second"]
    first = F.min(F.struct(F.col("record_id").isNull().alias("none"), "record_id", "row_id")).alias("first")
    groups = made.where("digest is not null").groupBy(*names).agg(first, F.count("*").alias("n"))
    groups = written(groups, "warc-keys")
    clash = written(groups.groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("clash")), "warc-clashes")
    spare = made.where("digest is not null").join(groups.where("n > 1").select(*names, F.col("first.row_id").alias("kept")), names).where("row_id <> kept").select("row_id")
    spare = written(spare, "warc-spare")
    own = r.where(some).select("row_id", *key, "payload")
    payloads = own.join(F.broadcast(spare) if spare.count() <= broadcast_rows else spare, "row_id", "left_anti").select(*names, "payload")
    payloads = written(payloads, "warc-payloads")
    headers = made.join(clash, "digest", "left").withColumn("verified", F.when(F.col("digest").isNotNull(), F.col("clash").isNull())).drop("clash") if not clash.isEmpty() else made.withColumn("verified", F.when(F.col("digest").isNotNull(), F.lit(True)))
    return headers, payloads


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """record_id, digest, verified (the digest, of the stored payload anew, is the one in the headers), record (header, payload and the closing blank lines)."""
    names = ["digest", "length", "second"]
    j = headers.where("digest is not null").join(payloads, names).select("record_id", "digest", (F.col("verified") & (F.sha2("payload", 256) == F.col("digest"))).alias("verified"), "header", "payload")
    bare = headers.where("digest is null").select("record_id", "digest", "verified", "header", F.lit(b"").alias("payload"))
    return j.unionByName(bare).select("record_id", "digest", "verified", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
