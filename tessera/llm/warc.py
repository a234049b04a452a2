"""WARC archives with segmented records, written and read back.

Captures become WARC/1.1 records: a response for each different payload, revisits for the others. Bodies have
chunked transfer framing, and records over a size are cut into a first segment and continuation records. The
reader finds records by their lengths, groups segments by the identifier of their origin, orders them by
segment number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

#: Bytes of a record's block from which it is cut into segments, bytes of a chunk, bytes of a file before compression.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 32_768, 8_192, 32_000_000
#: What ends a record, and a record's header.
GAP = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HEX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare base-32 SHA-1 of a binary column: 40 hex digits in four groups that are 8 digits of base 32 each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), HEX_32, BASE_32)


def chunked(payload: bytes, size: int) -> Iterator[bytes]:
    """A payload in chunked transfer framing."""
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        yield b"%x\r\n%b\r\n" % (len(part), part)
    yield b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        if line_end < 0:
            return None
        try:
            size = int(body[at:line_end].split(b";")[0], 16)
        except ValueError:
            return None
        at = line_end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def header(fields: list[tuple[str, str | int | None]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + GAP


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: int, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one capture, each without the gap that ends it: a revisit, or a response in one or more segments.

    The number is the row's own, so that captures of one page and payload are different records; a reference names page and digest.
    """
    own = f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{number}>"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        told = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        yield header([*told, *common, ("Content-Length", len(HTTP_HEAD))]) + HTTP_HEAD
        return
    block = HTTP_HEAD + b"".join(chunked(payload, chunk_bytes))
    if len(block) <= segment_bytes:
        yield header([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Length", len(block))]) + block
        return
    for segment, k in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[k : k + segment_bytes]
        last = k + segment_bytes >= len(block)
        if segment == 1:
            told = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common]
        else:
            told = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{segment}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own)]
        yield header([*told, ("WARC-Segment-Number", segment), ("WARC-Segment-Total-Length", len(block) if last and segment > 1 else None), ("Content-Length", len(part))]) + part


def with_decisions(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least min_bytes all but the one of largest id refer to that."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    kept = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"))
    refers = F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    return rows.join(kept, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a WARC record for each row of pages into gzip files under path.

    A null payload is empty; a null URL leaves its field out; a null id is written as "none". Spark's text
    writer puts the bytes down, so path can be in any store that Spark writes to; its line separator is the gap
    after a record. Files have about FILE_BYTES, from the mean size of payloads. The payloads are shuffled once,
    by digest, to meet the decision which of them is the response; a hot digest is split by Spark.
    """
    spark = pages.sparkSession
    small_batches(spark)
    mean = pages.agg(F.avg(F.octet_length(payload_col))).first()[0] or 0
    in_file = max(1, int(FILE_BYTES / (min(mean, segment_bytes) + 700)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                records = list(record_bytes(*row, date, segment_bytes, chunk_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    decided = with_decisions(pages, min_bytes, id_col, url_col, payload_col).withColumn("number", F.monotonically_increasing_id())
    records = decided.mapInArrow(batched(run), "record binary")
    out = records.select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", GAP.decode()).option("compression", "gzip").option("maxRecordsPerFile", in_file).text(path)


def batched(run):
    """Joins the small batches that run() makes for single rows into some of about a megabyte."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 1_000_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


class Reader:
    """Finds records by their lengths in a stream that comes as the pieces between gaps.

    A block that ends in line breaks moves the place where the stream is cut; only lengths count. Line breaks
    before a record belong to the gap.
    """

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.held = bytearray()

    def read(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records that are whole with this piece and the gap after it."""
        self.held += piece + GAP
        while True:
            if self.fields is None:
                self.held = self.held.lstrip(b"\r\n")
                head, gap, rest = self.held.partition(GAP)
                if not gap:
                    return
                lines = head.decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins with {lines[0][:40]!r}")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                self.held = rest
            length = int(self.fields["content-length"])
            if len(self.held) < length:
                return
            fields, block = self.fields, bytes(self.held[:length])
            self.fields, self.held = None, self.held[length:]
            yield fields, block

    def close(self) -> None:
        if self.fields is not None or self.held.strip(b"\r\n"):
            raise ValueError(f"{(self.fields or {}).get('warc-record-id')} has no end")


RECORD = "record_id string, kind string, digest string, refers_to string"
KINDS = [pa.string()] * 4


def archive_records(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """The records of the archives under path, in whatever store Spark reads: either those cut into segments or all others.

    Segments have RECORD, origin, segment, total and block; others have RECORD, payload and payload_digest.
    Spark's text reader streams a compressed file as one sequence of pieces between gaps, so that a worker holds
    one record, not a file.
    """
    small_batches(spark)
    pieces = spark.read.option("lineSep", GAP.decode()).text(path)
    more = "origin string, segment int, total long, block binary" if segments else "payload binary, payload_digest string"
    kinds = [*KINDS, *([pa.string(), pa.int32(), pa.int64(), pa.binary()] if segments else [pa.binary(), pa.string()])]

    def rows(batch: pa.RecordBatch, reader: Reader) -> Iterator[tuple]:
        for piece in batch.column(0).cast(pa.binary()).to_pylist():
            for f, block in reader.read(piece):
                told = f.get("warc-payload-digest")
                own = (f["warc-record-id"], f["warc-type"], told and told.rpartition(":")[2], f.get("warc-refers-to"))
                segment, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                if segments and segment:
                    yield *own, f.get("warc-segment-origin-id", own[0]), int(segment), total and int(total), block
                elif not segments and not segment:
                    yield *own, *payload_of(own[1], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            if found := list(rows(batch, reader)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[c.split()[0] for c in f"{RECORD}, {more}".split(", ")])
        reader.close()

    return pieces.mapInArrow(run, f"{RECORD}, {more}")


def payload_of(kind: str | None, block: bytes | None) -> tuple[bytes | None, str | None]:
    """(payload, its digest) of a whole response's block; none for other records and broken ones."""
    head, gap, body = (block or b"").partition(GAP)
    if kind != "response" or not gap:
        return None, None
    payload = dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body
    return payload, None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole records (RECORD, block) from segments: those of one origin joined in order.

    A record whose segment numbers are not 1, 2, ... or whose length is not the total length has a null block.
    A group is one record's segments; a segment that was stored twice counts once.
    """
    found = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "digest", "refers_to")],
    )
    found = found.withColumn("block", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"])))
    right = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    checked = F.when(right & F.col("kind").isNotNull() & (F.octet_length("block") == F.col("total")), F.col("block"))
    return found.select(F.col("origin").alias("record_id"), "kind", "digest", "refers_to", checked.alias("block"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, digest, refers_to, payload, payload_digest) of the archives under path.

    payload is the decoded body of a response, null for a revisit or a broken record; payload_digest is taken
    from it; digest is the one that the record tells. Only segments are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, digests = zip(*map(payload_of, batch.column(1).to_pylist(), batch.column(4).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payloads, pa.binary()), pa.array(digests, pa.string())], names=[*batch.schema.names[:4], "payload", "payload_digest"])

    joined = reassembled(archive_records(spark, path, True)).mapInArrow(run, f"{RECORD}, payload binary, payload_digest string")
    return archive_records(spark, path, False).unionByName(joined)


def page_number(record_id: Column) -> Column:
    """The page of a record of write_archives()."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)", 1).try_cast("long")


def referred(record_id: Column) -> Column:
    """How a revisit names a record of write_archives(): without the number of its row."""
    return F.regexp_replace(record_id, r"^(<urn:page:[^:]+:[^:>]+):.*$", "$1>")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives into the shared folder, reads them back and returns a row for each page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit has the size of the
    payload that it refers to. A row that repeats page and payload comes back as often as it was written; a null id comes back null and is never referred to.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    told = captures(spark, path).select("record_id", "kind", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce("payload_digest", "digest").alias("payload_digest"))
    told = written(told, "captures")
    responses, revisits = told.filter("kind = 'response'"), told.filter("kind = 'revisit'").drop("payload_bytes")
    sizes = responses.groupBy(referred(F.col("record_id")).alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    everything = responses.unionByName(revisits.join(sizes, "refers_to", "left"))
    return everything.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_number(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS n, array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * g::INT, 10))::BIGINT >> (35 - 5 * k)::INT) & 31)::INT, 1)), '')), '') AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS kept FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to FROM k
"""
