"""Operator 10: WARC archives, written from pages and read back as a chunked record table.

Writing: payloads are grouped by SHA-1 before anything is written. Of equal payloads the one with
the largest page_id becomes a ``response``, the others ``revisit`` records without a body. Every
task streams its records into gzip members of a file of its own below the shared folder; the
manifest names the files of successful attempts only, so a repeated task leaves no double records.

Reading: one task per file. A record becomes rows of (record_id, chunk_no) with at most
``CHUNK_BYTES`` of payload, and each row carries the digest and length of the payload so far, so no
record is held whole. Lengths and digests are compared with the headers.

Defined results: null html is an empty payload; null url has no target header; a null page_id
refers to the largest page_id of its payload, if there is one; identical rows with the largest
page_id are all responses; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import scratch_path, settle
from ..functions.skew import small_side
from .registry import query, table
from .words import lean

#: Payload bytes in a row of the record table, and read at once.
CHUNK_BYTES = 1 << 20
#: Payload bytes after which a task starts a new file.
FILE_BYTES = 256 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "path string, record_id string, record_type string, page_id long, url string, refers_to long, "
    "chunk_no int, is_last boolean, payload binary, payload_bytes long, payload_digest string"
)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def base32_digest(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _slices(payload: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(payload), CHUNK_BYTES):
        yield payload[at:at + CHUNK_BYTES]


class ArchiveWriter:
    """Appends records to one archive, each a gzip member."""

    def __init__(self, out):
        self.out = out

    def write(self, page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None) -> None:
        digest = hashlib.sha1()
        for part in _slices(payload):
            digest.update(part)
        digest = base32_digest(digest)
        revisit = refers_to is not None
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        http += b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload)
        header = [
            "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
        ]
        if page_id is not None:
            header.append(f"X-Page-ID: {page_id}")
        if url is not None:
            header.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
        if revisit:
            header.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
            header += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(press.compress("\r\n".join(header).encode() + b"\r\n\r\n" + http))
        for part in () if revisit else _slices(payload):
            self.out.write(press.compress(part))
        self.out.write(press.compress(b"\r\n\r\n") + press.flush())


def read_archive(stream) -> Iterator[dict]:
    """Rows of the record table from the bytes of an archive."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=stream), CHUNK_BYTES)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        header = {}
        while (line := source.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            header[key.lower()] = value
        left = int(header["content-length"])
        while left > 0:
            line = source.readline()
            left -= len(line)
            if line == b"\r\n":
                break
        row = {
            "record_id": header["warc-record-id"], "record_type": header["warc-type"], "url": header.get("warc-target-uri"),
            "page_id": int(header["x-page-id"]) if "x-page-id" in header else None,
            "refers_to": int(header["x-refers-to-page-id"]) if "x-refers-to-page-id" in header else None,
        }
        length, stated = int(header["x-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:")
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "is_last": True, "payload": None, "payload_bytes": length, "payload_digest": stated}
            continue
        if left != length:
            raise ValueError(f"{row['record_id']}: {left} payload bytes, {length} stated")
        digest, done, chunk_no = hashlib.sha1(), 0, 0
        while True:
            part = source.read(min(CHUNK_BYTES, length - done))
            if not part and done < length:
                raise ValueError(f"{row['record_id']} is cut off")
            digest.update(part)
            done += len(part)
            so_far = base32_digest(digest)
            if done == length and so_far != stated:
                raise ValueError(f"{row['record_id']}: digest {so_far}, {stated} stated")
            yield row | {"chunk_no": chunk_no, "is_last": done == length, "payload": part, "payload_bytes": done, "payload_digest": so_far}
            chunk_no += 1
            if done == length:
                break


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record per page below ``folder``; returns the manifest (path, n_records, n_bytes), settled."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html")).withColumn("_digest", F.sha1("_html"))
    repeated = settle(
        keyed.filter(F.octet_length("_html") >= least_bytes).groupBy("_digest")
        .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and _largest is not null").drop("_n")
    )
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_largest")), F.col("_largest"))
    decided = keyed.join(small_side(repeated), "_digest", "left").select("page_id", "url", refers.alias("refers_to"), "_html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}" if task else f"part-{uuid.uuid4().hex}"
        made, out, writer = [], None, None
        for batch in batches:
            page_ids, urls, refers_to, html = batch.columns
            for i in range(len(batch)):
                if out is None:
                    made.append([f"{folder}/{name}-{len(made)}.warc.gz", 0, 0])
                    out = system.open_output_stream(f"{root}/{name}-{len(made) - 1}.warc.gz")
                    writer = ArchiveWriter(out)
                payload = memoryview(html[i].as_buffer())
                writer.write(page_ids[i].as_py(), urls[i].as_py(), payload, refers_to[i].as_py())
                made[-1][1] += 1
                made[-1][2] += len(payload)
                if made[-1][2] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["path", "n_records", "n_bytes"],
        )

    return settle(decided.mapInArrow(lean(write), MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names."""
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "chunk_no": pa.int32(), "is_last": pa.bool_(), "payload": pa.binary(), "payload_bytes": pa.int64()}
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(place) as stream:
                    for row in read_archive(stream):
                        rows.append(row | {"path": path})
                        held += len(row["payload"] or b"")
                        if held >= 4 * CHUNK_BYTES or len(rows) >= 2000:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    files = manifest.count()  # stored rows, one per file
    return manifest.select("path").repartition(max(files, 1)).mapInArrow(lean(read), RECORDS)


_SQL = r"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS digest FROM payloads),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(digest, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))::INTEGER) & 31), 1)
    FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < largest THEN largest END AS refers_to
FROM grouped
"""


@query("op10_warc", _SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
