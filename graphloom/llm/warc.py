"""WARC records in seekable Zstandard bundles (operator 3).

A bundle is a run of independent Zstandard frames and, at its end, a seek table in a skippable frame: for each frame
its compressed and its decompressed size, then the number of frames, a descriptor byte and a magic number. A record
is found by its frame and its offset inside the decompressed frame.
"""

from __future__ import annotations

import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, prepare
from .storage import opener

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Bytes of records in a frame, and of frames in a bundle, before a new one is begun.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Payloads of fewer bytes are never made revisits.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(2**63)


def record(page_id: int, ordinal: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{ordinal}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record at this offset")
    head = dict(line.split(": ", 1) for line in lines[1:])
    return head, data[end + 4 : end + 4 + int(head["Content-Length"])]


class BundleWriter:
    def __init__(self, level: int = 3):
        import zstandard

        self._compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the decompressed frame, length)."""
        place = (len(self.frames), self.filled, len(data))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= FRAME_BYTES:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        if self.open:
            packed = self._compress(b"".join(self.open))
            self.frames.append((len(packed), self.filled))
            self.parts.append(packed)
            self.size += len(packed)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Random access: the seek table is read from the end, a frame when it is asked for."""

    def __init__(self, path: str):
        import zstandard

        self._decompress = zstandard.ZstdDecompressor().decompress
        self.path, self.store = path, opener(path)
        size = self.store.size(path)
        count, _, magic = struct.unpack("<IBI", self.store.read(path, size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self.store.read(path, size - 9 - 8 * count, 8 * count)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed
        self.held: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        if self.held[0] != frame:
            at, packed, plain = self.frames[frame]
            self.held = (frame, self._decompress(self.store.read(self.path, at, packed), max_output_size=plain))
        return parse_record(self.held[1], offset)


def _write(folder: str):
    def run(batches):
        writer, rows, name = None, [], ""

        def flush():
            path = f"{folder}/{name}.warc.zst"
            opener(path).write(path, writer.finish())
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([path] * len(rows)), *(pa.array(c, pa.int64()) for c in cols[1:])], ["page_id", "bundle", "frame", "offset", "length"])

        for b in batches:
            for page, html, url, digest, refers, ordinal in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if writer is None:
                    writer, rows, name = BundleWriter(), [], ordinal
                rows.append((page, *writer.add(record(page, ordinal, url, (html or "").encode(), digest, refers))))
                if writer.size >= BUNDLE_BYTES:
                    yield flush()
                    writer = None
        if writer is not None:
            yield flush()

    return run


def write_bundles(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html); (page_id, bundle, frame, offset, length).

    Of records with equal payloads of LEAST_REVISIT bytes or more, those with the largest page_id are responses and
    the others revisits of it; the largest is found by an aggregate on the digest, not by gathering the copies.
    A task writes its bundles one after another, at most BUNDLE_BYTES in memory.
    """
    spark = pages.sparkSession
    prepare(spark)
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_ = F.octet_length("html") >= LEAST_REVISIT
    first = materialize(own.where(long_).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first"), "copies")
    # only ids are joined with the copies: payloads are not moved for it
    ids = own.where(long_).select("page_id", "digest").join(first, "digest").where("page_id <> first").distinct()
    refers = materialize(ids.select("page_id", "digest", F.col("first").alias("refers_to")), "revisits")
    rows = own.join(refers, ["page_id", "digest"], "left")
    rows = rows.select("page_id", "html", "url", "digest", "refers_to", F.sha1(F.concat_ws(" ", F.col("page_id").cast("string"), F.col("digest"), F.col("url"), F.monotonically_increasing_id())).alias("ordinal"))
    folder = folder or new_path(spark, "warc")
    return materialize(rows.mapInArrow(_write(folder), "page_id long, bundle string, frame long, offset long, length long"), "warc-index")


def _read(batches):
    from hashlib import sha1

    reader = None
    for b in batches:
        out = []
        for bundle, frame, offset in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if reader is None or reader.path != bundle:
                reader = BundleReader(bundle)
            head, block = reader.record(frame, offset)
            digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Page-ID"])
            if head["WARC-Type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {page} is damaged")
                out.append((page, len(payload), digest, "response", None))
            else:
                out.append((page, int(head["X-Payload-Length"]), digest, "revisit", int(head["X-Refers-To-Page-ID"])))
        cols = list(zip(*out, strict=True)) or [()] * 5
        unid = lambda c: pa.array([None if x == NO_ID else x for x in c], pa.int64())
        yield pa.RecordBatch.from_arrays([unid(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), unid(cols[4])], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_bundles(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read through the index."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("bundle", "frame", "offset").repartition(n, F.xxhash64("bundle", "frame")).sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back, one row for each row of ``pages``.

    Null html is an empty payload, a null url has no target header, a null page_id stays null. Rows that repeat a
    page_id and payload are all responses or all revisits. An empty table gives no bundle and no row; other columns
    are ignored.
    """
    return read_bundles(write_bundles(pages))
