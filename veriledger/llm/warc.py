"""WARC archives: a writer, and a sequential reader.

Writing: one gzip member a record. Of pages with equal payloads the smallest page_id is written
in full as a response; the others are revisit records that refer to it and carry the full
payload's digest and length. Each task writes archives of about ``ARCHIVE_BYTES`` to the shared
folder under names no other attempt uses, closes them, and only then names them in the
manifest; archives of an attempt that failed are in no manifest and are never read.

Reading: the file is read in pieces of fixed size; zlib decompresses it incrementally, one
member a record; the record's Content-Length frames its block; payload and block digests are
checked against the bytes. Memory is bounded by one record.

Defined results: null html is an empty payload; null ids are written last and are never
referred to while an id with the same payload exists; null urls get a urn of the page; repeated
rows with one page_id and payload (ties): one of those with the least url is the response and the others revisit it; a very long page
is one record, held in memory whole, as Content-Length stands before it; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path

ARCHIVE_BYTES = 64_000_000
CHUNK = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, serial: int = 0) -> str:
    """A record id that names its page: the id in the low half of a UUID, a serial number in the high half."""
    low = (1 << 64) - 1 if page_id is None else page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=(serial & ((1 << 63) - 1)) << 65 | (page_id is None) << 64 | low)}>"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 & 1:
        return None
    low = value & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None, serial: int = 0) -> bytes:
    """One record, uncompressed."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if refers else payload)
    head = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_urn(page_id, serial)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to))] if refers else []),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class WarcError(ValueError):
    """An archive that is cut off or whose framing or digests do not hold."""


def members(source) -> Iterator[bytes]:
    """Decompressed gzip members of a file object, one at a time, read in pieces."""
    z, out, pending = zlib.decompressobj(31), [], b""
    while True:
        data = pending or source.read(CHUNK)
        pending = b""
        if not data:
            if out or z.unconsumed_tail:
                raise WarcError("archive ends inside a record")
            return
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            pending, z, out = z.unused_data, zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; framing is checked."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/\d\.\d", first):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the record")
    return headers, rest[:size]


def read_records(source) -> Iterator[dict]:
    """Verified records of an archive: page_id, type, digest and length of the full payload, payload, refers_to."""
    for member in members(source):
        headers, block = parse(member)
        if headers["warc-block-digest"] != "sha1:" + sha1_base32(block):
            raise WarcError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        revisit = headers["warc-type"] == "revisit"
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
            raise WarcError("payload digest differs")
        yield {
            "page_id": page_of(headers["warc-record-id"]), "record_type": headers["warc-type"], "payload_digest": digest, "payload_bytes": length, "target_uri": headers["warc-target-uri"],
            "payload": None if revisit else payload, "refers_to": page_of(headers["warc-refers-to"]) if revisit else None,
        }


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, revisit, first_id): which pages revisit another, and which one.

    Ids are first reduced by digest in each task, so a payload that a third of all pages share
    is a few rows. Payloads that occur once need no partner; those that occur more often are
    written as a narrow table, whose known size lets Spark choose: a broadcast under its
    threshold, else one shuffle of the pages by digest, where it splits a large partition.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    ids = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n"))
    shared = ids.groupBy("digest").agg(first.alias("f"), F.sum("n").alias("copies")).where("copies > 1")
    shared = materialise(shared.select(F.col("digest").alias("_digest"), F.col("f.page_id").alias("first_id"), (F.col("f.n") > 1).alias("repeated")), "payloads")
    marked = rows.join(shared, rows["digest"] == shared["_digest"], "left").withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first_id")))
    marked = marked.withColumn("revisit", F.col("_digest").isNotNull() & ~F.col("is_first"))
    if shared.where("repeated").limit(1).count():
        # The id written in full stands on several rows: one of them is the response. Rows alike in all are one row and a number.
        tied = F.col("is_first") & F.coalesce("repeated", F.lit(False))
        alike = marked.where(tied).groupBy("digest", "page_id", "url", "first_id").agg(F.count("*").alias("copies"), F.first("html").alias("html"))
        lead = alike.groupBy("digest").agg(F.min(F.struct(F.col("url").isNotNull().alias("named"), "url")).alias("lead")).withColumnRenamed("digest", "_lead_of")
        spread = alike.join(lead, alike["digest"] == lead["_lead_of"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        spread = spread.withColumn("revisit", (F.col("copy") > 1) | ~F.col("url").eqNullSafe(F.col("lead.url")))
        columns = ["page_id", "url", "html", "revisit", "first_id"]
        marked = marked.where(~tied).select(columns).unionByName(spread.select(columns))
    return marked.select("page_id", "url", "html", "revisit", "first_id")


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives to the shared folder; the manifest (path, records, bytes) of those that were closed."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    spark.range(0).write.mode("overwrite").parquet(f"{root}/made")  # makes the folder, through Spark
    ready = with_revisits(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        out, path, count, size, serial = None, "", 0, 0, 0
        attempt = uuid.uuid4().hex

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

        number = 0
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, text, revisit, first = (b.column(c)[k].as_py() for c in range(5))
                if out is None:
                    path = f"{folder}/{attempt}-{number:05d}.warc.gz"
                    out, count, size, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                serial += 1
                # The response of a payload has serial 0, so that references need no lookup.
                data = gzip_member(record(page_id, url, text.encode("utf-8"), revisit, first, serial if revisit else 0))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    manifest = ready.mapInArrow(run, "name string, records long, bytes long")
    return materialise(manifest, "manifest").withColumn("path", F.concat(F.lit(root + "/"), F.col("name")))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of all archives of a manifest, each archive read by one task from start to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    held: list[dict] = []
                    for r in read_records(source):
                        held.append(r)
                        if len(held) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names)

    schema = RECORDS + (", payload binary" if payloads else "")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, schema)


def unmatched_revisits(records: DataFrame) -> DataFrame:
    """Revisit records whose page and digest no response of ``records`` has: none in whole archives."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
    revisits = records.where("record_type = 'revisit'")
    return revisits.join(responses, revisits["refers_to"].eqNullSafe(responses["_page"]) & (revisits["payload_digest"] == responses["_digest"]), "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: one row a page."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
