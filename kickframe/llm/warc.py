"""WARC archives: a writer on Spark's text sink and a reader that salvages damaged archives.

Archives are written by Spark's own commit protocol to any file system: plain records end with two line
ends, which is then the sink's line separator; compressed records are a gzip member each, and the separator
is an empty member, which every gzip reader skips. The reader takes each archive apart by the lengths that its records
state and checks what it can (gzip's own checks, the record's end, its digest). After a failed check it
looks for the next gzip member or version line, goes on from there, and reports the bytes between as a
quarantined gap. A gzip member is unpacked as far as it goes and searched in the same way, so a damaged
record costs its neighbours in the member nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.llm._common import arrow_schema, text_of

#: Equal payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: Records to an archive at most, and bytes after which it is closed, so that one fits in a task.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 16_000_000
#: Bytes that are unpacked at once.
BLOCK = 1 << 16
#: Parts into which the pages of one payload are dealt to learn what they refer to.
SALTS = 32
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # a null value leaves its line out
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), block)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, body, digest, n, refers_to): of equal payloads of ``least`` bytes or more all but the smallest id refer to that.

    Rows that repeat the smallest id are not revisits. A null id is never referred to; if equal payloads
    have only null ids, none is a revisit. Equal payloads meet by digest, without their bodies and dealt into
    SALTS parts, so a very common page is no burden; bodies move once, by id.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(body_col).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("n", F.octet_length("body"))
    names = rows.select("id", "digest", F.col("n").alias("size"))
    firsts = names.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("times")).where("times > 1 and first_id is not null")
    firsts = firsts.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = names.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    marks = salted.join(firsts, ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
    marks = marks.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("first_id").alias("refers_to")).distinct()
    met = rows.join(marks, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    return met.select("id", "url", "body", "digest", "n", "refers_to")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_REVISIT, archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES, gzipped: bool = True) -> None:
    """Write one record per row of ``pages`` to archives below ``path``; other columns are ignored, a null body is empty.

    Repeated rows are written each, a very long body is a record of an archive of its own or its last, and an
    empty table writes no record.
    """
    r = plan_records(pages, id_col, url_col, body_col, least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    record = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", urn("id")),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
            ("WARC-Date", F.lit(_DATE)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, urn("refers_to"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("X-Payload-Length", F.col("n").cast("string")),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ],
        block,
    )
    records = r.select(record.cast("binary").alias("value"))
    separator = _EMPTY_MEMBER if gzipped else b"\r\n\r\n"
    schema = arrow_schema("value binary")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per archive, without the separator that the sink puts at its end."""
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip.compress(record.as_py() + b"\r\n\r\n", 4, mtime=0) if gzipped else record.as_py())
                size += len(held[-1])
                if len(held) >= archive_records or size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], schema=schema)

    # the sink writes a string's bytes as they are; Latin-1 keeps the separator's
    whole = records.mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
    writer = whole.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
    writer.option("lineSep", separator.decode("latin-1")).text(path)


@dataclass
class Record:
    """A record, or with ``gap`` the reason for which the bytes were quarantined."""

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    gap: str | None = None


class Damaged(Exception):
    pass


def _plain(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` and where the next begins."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without colon")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Damaged("no length or type")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where it should")
    block = data[start:stop]
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and headers["warc-type"] != "revisit" and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damaged("the digest does not match")
    return Record(at, stop + 4 - at, headers, block), stop + 4


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds as far as it goes, where it ends, and what is wrong with it."""
    unzip, out, fed = zlib.decompressobj(31), [], at
    while not unzip.eof and fed < len(data):
        before, block = unzip.copy(), data[fed : fed + BLOCK]
        try:
            out.append(unzip.decompress(block))
        except zlib.error as e:
            # the block again in small steps, up to the fault
            try:
                for k in range(0, len(block), 64):
                    out.append(before.decompress(block[k : k + 64]))
            except zlib.error:
                pass
            return b"".join(out), fed, f"gzip: {e}"
        fed += len(block)
    if not unzip.eof:
        return b"".join(out), fed, "the gzip member does not end"
    return b"".join(out), fed - len(unzip.unused_data), None


def _member(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member at ``at``, the gaps within it, and where the next begins."""
    inner, end, wrong = _unpacked(data, at)
    found = list(_records(inner)) if wrong is None or _VERSION.search(inner) else []
    if wrong is not None:
        after = _NEXT.search(data, at + 1)
        end = after.start() if after else len(data)
        # what is cut off is part of the member's own gap
        found = [r for r in found if not r.gap] + [Record(at, 0, gap=wrong)]
    return [Record(at, end - at, r.headers, r.block, r.gap and (r.gap if wrong else f"in a gzip member: {r.gap}")) for r in found], end


def _records(data: bytes) -> Iterator[Record]:
    """All whole records of plain data in order, and the gaps between them."""
    at, n = 0, len(data)
    while at < n:
        try:
            record, end = _plain(data, at)
        except Damaged as e:
            after = _VERSION.search(data, at + 1)
            end = after.start() if after else n
            record = Record(at, end - at, gap=str(e))
        yield record
        at = end


def salvage(data: bytes) -> Iterator[Record]:
    """All whole records of an archive in order, and the gaps between them.

    Records of a damaged gzip member are kept if their length, their end and, where one is stated, their
    digest are right. Headers may be of any length.
    Time is linear in the data but for members that are damaged again and again and version lines after which no headers end.
    """
    at, n = 0, len(data)
    while at < n:
        if data[at : at + 2] == b"\x1f\x8b":
            records, end = _member(data, at)
        else:
            try:
                record, end = _plain(data, at)
            except Damaged as e:
                after = _NEXT.search(data, at + 1)
                end = after.start() if after else n
                record = Record(at, end - at, gap=str(e))
            records = [record]
        yield from records
        at = end


_DDL = "file string, offset bigint, length bigint, gap string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_length bigint, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record below ``path`` and for each quarantined gap (``gap`` is its reason, else null).

    ``offset`` and ``length`` are the bytes in the archive, of a gzip member for all that it holds.
    Neighbouring gaps stay separate rows. Repeated records are a row each; an empty folder gives no rows.
    """

    schema = arrow_schema(_DDL)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in salvage(content.as_py()):
                    h = r.headers
                    length = h.get("x-payload-length", "")
                    rows.append((file.as_py(), r.offset, r.length, r.gap, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(length) if length.isdigit() else None, None if r.gap else r.block))
                    size += len(r.block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _DDL)
