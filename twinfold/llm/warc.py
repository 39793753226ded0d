"""WARC archives with an index: each record's place is written down, and reads are coalesced byte ranges.

Every task writes its pages as records, each a gzip member of its own, to
archives in the shared folder, and returns the index: archive, offset, length,
URL and digest. Reading sorts the index rows of the selected records by
archive and offset and joins neighbouring ranges into one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, new_path, stored

#: A new archive begins beyond this size.
ARCHIVE_BYTES = 64 << 20
#: Ranges so close to each other are one read, of at most so many bytes (or one record).
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Archive bytes that one task reads, on average.
TASK_BYTES = 32 << 20
#: Winners of repeated payloads are broadcast up to so many rows of about 50 bytes, else joined by a shuffle.
BROADCAST_ROWS = 100_000

_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base32: 40 bits, 8 letters at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _BASE32_HEX, _BASE32)


def marked_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every page."""
    payload = F.coalesce(column(pages, "html", "string"), F.lit(""))
    records = pages.select(
        column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload_digest(payload).alias("payload_digest"),
    )
    repeated = (
        records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    )
    repeated = stored(repeated.select("payload_digest", "payload_bytes", "first_id"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return records.join(repeated, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    header = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + ("" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        header += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    header.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(header).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _file_system(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


_INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one record per row to archives under ``folder``; the stored index of where each one is.

    A task that is run again writes other archives; the index names only those of the task that succeeded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places = []
                columns = [batch.column(k) for k in range(batch.num_columns)]
                for k in range(batch.num_rows):
                    page_id, url, payload, size, digest, kind, refers_to = (c[k].as_py() for c in columns)
                    member = gzip.compress(_record(page_id, url, payload.encode(), size, digest, kind, refers_to), 1, mtime=0)
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    places.append((name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.int64()),
                     pa.array([p[2] for p in places], pa.int64()), columns[1], columns[4], columns[0], columns[5]],
                    ["archive", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stored(records.mapInArrow(run, _INDEX), "warc-index")


_READ = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, read back in coalesced ranges; a wrong digest is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        open_name, source = None, None

        def read(name: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
            nonlocal open_name, source
            if name != open_name:
                if source is not None:
                    source.close()
                open_name, source = name, system.open_input_file(f"{root}/{name}")
            low, high = ranges[0][0], ranges[-1][0] + ranges[-1][1]
            data = source.read_at(high - low, low)
            for at, n in ranges:
                yield zlib.decompress(data[at - low:at - low + n], wbits=31)

        def rows(name: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            out = []
            for record in read(name, ranges):
                fields, payload = _parse(record)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} does not have its digest")
                out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload.decode() if with_payload else None,
                            int(fields["X-Payload-Bytes"]), digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        name, ranges = None, []
        for batch in batches:
            for archive, at, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                apart = ranges and (archive != name or at - sum(ranges[-1]) > GAP_BYTES or at + n - ranges[0][0] > READ_BYTES)
                if apart:
                    yield rows(name, ranges)
                    ranges = []
                name = archive
                ranges.append((at, n))
        if ranges:
            yield rows(name, ranges)

    places = index.select("archive", "offset", "length")
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    ranged = places.repartitionByRange(max(1, tasks), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(run, _READ)


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write a record per page; the index and the folder of the archives.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is a
    response and the others revisit it. Rows that repeat the winning page_id are responses too, and so are all
    rows of a payload that has no page_id at all. A null html is an empty payload, a null url an empty target;
    other columns are ignored; an empty table gives an empty index.
    """
    folder = new_path(pages.sparkSession, "warc")
    return write_archives(marked_records(pages, least_bytes), folder), folder
