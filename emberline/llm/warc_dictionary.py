"""WARC archives with a Zstandard dictionary.

Each task writes archives of bounded size. It gathers the first records of an
archive, builds a dictionary from them, writes it in a leading skippable frame
(magic 0x184D2A5D) and compresses every record into a frame of its own, so that a
record can be read with the dictionary alone. Records too few or too small to train on
are the dictionary themselves, as raw content.

Pages with equal payloads of ``min_bytes`` or more are stored once: the page with the
smallest id is a response, the others are revisits that name it and repeat its HTTP
headers without the payload.

Scale. The first page of each payload comes from a grouped minimum over digests, so a
payload that a third of all pages share is one row after partial aggregation; the
join that brings it back is on plain exchanges, which AQE splits. Archives go to the
shared folder under a name of their own for each attempt, and only those that
finished attempts report are read, so a lost executor costs its tasks and no more.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, shared_path, small_batches, written

# Fixed value: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, which state the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{quote(page_id)}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and stated payload length of one record; raises if lengths do not agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"not one WARC record: {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, payload, int(re.search(rb"Content-Length: (\d+)", http)[1])


def dictionary(sample: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary built from records; where they are too few or too alike in size to train on, the end of their text as raw content."""
    if len(sample) >= 8 and sum(map(len, sample)) >= 4096:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, sample)) // 4), sample).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[-size:]


class Archive:
    """One archive on a file system that Arrow reaches; records are held until the dictionary can be built."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.held: list[bytes] = []
        self.size = self.count = self.bytes = 0
        self.out = self.press = None

    def add(self, data: bytes) -> None:
        self.count += 1
        self.bytes += len(data)
        if self.out:
            self._write(data)
        else:
            self.held.append(data)
            self.size += len(data)
            if self.size >= SAMPLE_BYTES:
                self._open()

    def _open(self) -> None:
        system, path = FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        # A few very long records must not crowd out the others.
        found = dictionary([x[:1 << 16] for x in self.held])
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(found)) + found)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(found), write_content_size=True)
        for data in self.held:
            self._write(data)
        self.held = []

    def _write(self, data: bytes) -> None:
        self.out.write(self.press.compress(data))

    def close(self) -> None:
        if not self.out:
            self._open()
        self.out.close()


def _write_archives(folder: str, archive_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, names = None, ["path", "records"]

        def done(a: Archive) -> pa.RecordBatch:
            a.close()
            return pa.RecordBatch.from_arrays([pa.array([a.path]), pa.array([a.count], pa.int64())], names)

        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(folder)
                archive.add(record(page_id, url, payload, first, revisit))
                if archive.bytes >= archive_bytes:
                    yield done(archive)
                    archive = None
        if archive:
            yield done(archive)

    return rows


def read_archive(path: str) -> Iterator[bytes]:
    """The records of one archive, one frame at a time."""
    system, name = FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        data, words = f.read(8), None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
            words, data = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", data[4:])[0])), b""
        reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
        frame, parts = None, []
        while data or (data := f.read(CHUNK)):
            frame = frame or reader.decompressobj()
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                yield b"".join(parts)
                data, frame, parts = frame.unused_data, None, []
        if frame:
            raise ValueError(f"{path} ends inside a record")


def _read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, n = [], 0
            for data in read_archive(path):
                fields, payload, length = parse(data)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != length or digest32(payload) != digest):
                    raise ValueError(f"damaged payload in {path}: {fields['WARC-Record-ID']}")
                rows.append((_id(fields["WARC-Record-ID"]), length, digest, kind, _id(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]))
                n += 1
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            if n != records:
                raise ValueError(f"{path} holds {n} of {records} records")
            if rows:
                yield batch_of(rows)


def _id(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:"):-1]) or None if urn else None


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in the shared folder; one row ``(path, records)`` per archive.

    Null html is an empty payload. Rows that tie on the smallest id of a payload are
    all responses; a null id is largest and is written as an empty one. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    lean = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("code"))
    firsts = (lean.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("code").alias("first_code"))
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    firsts = written(firsts.select("first_code", "first"), "firsts")
    joined = lean.join(firsts, F.col("code") == F.col("first_code"), "left")
    revisit = F.col("first_code").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = joined.select(name.alias("page_id"), "url", "payload", F.when(revisit, F.coalesce(F.col("first").cast("string"), F.lit(""))).alias("first"), revisit.alias("revisit"))
    folder = shared_path(spark, "warc")
    return written(rows.mapInArrow(_write_archives(folder, archive_bytes), "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of ``archives(path, records)``: page_id (text), payload_bytes, payload_digest, record_type, refers_to, url.

    Every payload is read back and checked against its digest. An archive is read by one task, and tasks are no more than
    16 times the shuffle partitions, whatever the number of archives.
    """
    n = max(1, min(archives.count(), 16 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return archives.repartition(n, "path").mapInArrow(
        _read_archives, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")


def op1_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from their archives."""
    pages = read_table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = read_archives(write_archives(pages))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + CAST(i // 8 AS INTEGER) * 10, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
