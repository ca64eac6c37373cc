"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, followed by a seek table in a skippable
frame (the public seekable format: sizes of every frame, then a nine-byte footer). An index maps each record id to its
frame and its offset inside the frame's content, so one record is read by decompressing one frame.

Bundles are written by the tasks that hold the records, each attempt under a name of its own; the manifest that Spark
commits names only the bundles of attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import materialise, scratch_path

#: Fixed values of the seekable format: magic of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 64 << 20, 3
MIN_DUPLICATE = 1000
#: Copies of a response's id that wait for its revisits: one payload may be a third of all records.
SPREAD = 16

INDEX = "page_id long, url string, bundle string, frame int, at long, length long"


class BundleWriter:
    """Collects records into frames; ``finish`` adds the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.parts, self.table, self.held, self.size, self.total = frame_bytes, [], [], [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self._close_frame()
        at = self.size
        self.held.append(record)
        self.size += len(record)
        return len(self.table), at

    def _close_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.held))
        self.parts.append(packed)
        self.table.append((len(packed), self.size))
        self.total += len(packed)
        self.held, self.size = [], 0

    def finish(self) -> bytes:
        if self.held:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Reads frames of a bundle through a random-access file."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags:
            raise ValueError("not a seekable Zstandard bundle")
        sizes = struct.iter_unpack("<II", self._read(size - 9 - 8 * n, 8 * n))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def record(self, frame: int, at: int, length: int) -> bytes:
        if self.last[0] != frame:
            start, packed, plain = self.frames[frame]
            self.last = (frame, self.decompressor.decompress(self._read(start, packed), max_output_size=plain))
        return self.last[1][at : at + length]


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only and names the record that has its payload."""
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def classify_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, else the largest id with an equal payload.

    Payloads are grouped by SHA-256 with partial aggregation; only groups of two or more come back. Null payloads are empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int"))
    large = rows.where(F.octet_length("payload") >= min_duplicate)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    joined = rows.join(first, ["digest", "part"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


Store = Callable[[str], tuple[pyarrow.fs.FileSystem, str]]


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and root of a URI as Spark takes it: Hadoop's names of the S3 connectors stand for that store, and dbfs
    for the folder where it is mounted."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = f"file:///dbfs/{rest.lstrip('/')}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_bundles(records: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, store: Store = open_store) -> DataFrame:
    """Write ``records`` (page_id, url, payload, refers_to) as bundles under ``path``, a URI that every executor can
    reach; returns the committed index. ``store`` opens other stores than ``open_store`` knows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(path)
        fs.create_dir(root, recursive=True)
        writer, rows, name = BundleWriter(frame_bytes), [], f"{uuid.uuid4().hex}.warc.zst"

        def flush() -> pa.RecordBatch:
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(writer.finish())
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                payload, page, url = payload.as_py(), page.as_py(), url.as_py()
                record = warc_record(page, url, payload, hashlib.sha1(payload).hexdigest(), refers.as_py())
                frame, at = writer.add(record)
                rows.append({"page_id": page, "url": url, "bundle": name, "frame": frame, "at": at, "length": len(record)})
                if writer.total > bundle_bytes:
                    yield flush()
                    writer, rows, name = BundleWriter(frame_bytes), [], f"{uuid.uuid4().hex}.warc.zst"
        if rows:
            yield flush()

    return materialise(records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, path: str, store: Store = open_store) -> DataFrame:
    """Read the indexed records back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Digest and length of a response are taken from the payload itself and must agree with its headers; a revisit has
    them in its headers only and its ``payload`` is null. The index is sorted by place, so each frame is read once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(path)
        name, reader = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for x in batch.slice(at, 512).to_pylist():
                    if x["bundle"] != name:
                        name, reader = x["bundle"], BundleReader(fs.open_input_file(f"{root}/{x['bundle']}"))
                    fields, payload = parse_record(reader.record(x["frame"], x["at"], x["length"]))
                    kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                        raise ValueError(f"record {x['page_id']} is damaged")
                    rows.append((_urn(fields["WARC-Record-ID"]), n, digest, kind, _urn(fields.get("WARC-Refers-To")), x["url"], payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    placed = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "at")
    return placed.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A null payload is an empty one; a null id stays null and, like any row that has the id of its group's response, is
    a response. Repeated ids are written as often as they occur. An empty table gives no bundle and no rows. Other columns
    are ignored, whatever their names.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    path = path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) else f"file://{path}"
    return read_records(write_bundles(classify_records(pages, **names), path), path)


ORACLE_SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
g AS (SELECT page_id, x, CASE WHEN strlen(x) >= 1000 THEN max(page_id) OVER (PARTITION BY x) ELSE page_id END AS first FROM t)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha1(x) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
