"""WARC archives in seekable Zstandard bundles: independent frames, a footer seek table, an index of records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.llm.common import filesystem, stored, track
from waypoint.session import scratch_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Frames that one row of the read-back stands for.
STRETCH = 8
INDEX = "page_id bigint, record_id string, record_type string, bundle string, frame int, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def warc_record(page_id, url, kind: str, refers_to, payload: bytes, size: int, digest: str, date: str) -> bytes:
    """One record; a revisit carries the HTTP header only, with the length of the payload that it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_urn(refers_to)}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset of a decompressed frame, and the offset behind it."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {
        "page_id": _page(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "refers_to": _page(head["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }, end + 4 + len(block) + 4


class Bundle:
    """Writes one bundle: frames as they fill, at the end the seek table."""

    def __init__(self, folder: str, frame_bytes: int) -> None:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # another try of the task writes another file
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=3, write_content_size=True), frame_bytes
        self.frames: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.filled = self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame."""
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.filled
        self.parts.append(record)
        self.filled += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            data = b"".join(self.parts)
            packed = self.packer.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.size += len(packed)
            self.parts, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Reads the seek table from the end of a bundle, then any frame by itself."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = filesystem(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        total = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, total - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(12 * count, total - 9 - 12 * count)
        self.frames, at = [], 0
        for packed, size, check in struct.iter_unpack("<III", table):
            self.frames.append((at, packed, size, check))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, size, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError("damaged frame")
        return data


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    columns = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in columns], [c for c, _ in columns])


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to; html is null in revisits.

    Equal payloads have equal SHA-1 and length. The largest page_id of a payload of at least ``min_bytes``
    answers for the others. Payloads are counted by digest before the join; those met once drop out
    there, and a digest held by many pages is one that adaptive execution splits in the join.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html").withColumns(
        {"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body)}
    )
    first = (
        own.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = own.join(first, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper"))
    joined = joined.withColumn("refers_to", refers)
    return joined.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", "refers_to"
    )


def write_bundles(
    marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write records below ``folder`` (shared by all executors) and give the index of them.

    Each task writes bundles of its own, at most ``bundle_bytes`` and one frame large; a frame holds whole
    records, at most ``frame_bytes`` or a single record, so a task holds one frame. The index says for
    each record its bundle, frame and the offset within the decompressed frame. The index is written
    once; files of lost tasks are not in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, size, digest, refers_to = (batch.column(c)[k].as_py() for c in range(6))
                kind = "response" if refers_to is None else "revisit"
                record = warc_record(page_id, url, kind, refers_to, (html or "").encode(), size, digest, date)
                bundle = bundle or Bundle(folder, frame_bytes)
                frame, offset = bundle.add(record)
                rows.append(
                    {"page_id": page_id, "record_id": _urn(page_id), "record_type": kind, "bundle": bundle.name, "frame": frame, "offset": offset, "length": len(record)}
                )
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if rows and bundle is None:
                yield _batch(rows, INDEX)
                rows = []
        if bundle:
            bundle.close()
        if rows:
            yield _batch(rows, INDEX)

    return stored(marked.mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame, with digests verified.

    Stretches of ``stretch`` frames are dealt to a fixed number of partitions (the session's shuffle
    partitions), which adaptive execution leaves as they are: a few short rows stand for all the work.
    Each stretch opens its bundle once and reads the seek table and its own frames.
    """
    shape = RECORDS if payloads else RECORDS.rpartition(", ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                reader = BundleReader(folder, name)
                for k in range(part * stretch, min((part + 1) * stretch, len(reader.frames))):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        record, at = parse_record(data, at)
                        rows.append(record)
                    yield _batch(rows, shape)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = index.select("bundle", F.expr(f"frame div {stretch}").alias("part")).distinct()
    return stretches.repartition(parts, "bundle", "part").mapInArrow(run, shape)


def fetch_records(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Records of the wanted page ids (column page_id): only the frames that hold them are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = frame = reader = data = None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != name:
                    name, frame, reader = x["bundle"], None, BundleReader(folder, x["bundle"])
                if x["frame"] != frame:
                    frame, data = x["frame"], reader.frame(x["frame"])
                rows.append(parse_record(data, x["offset"])[0])
            yield _batch(rows, RECORDS)

    places = index.join(wanted.select("page_id").distinct(), "page_id").select("bundle", "frame", "offset")
    return places.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: null html is an empty payload; payloads under 1000 bytes are always responses; rows that
    repeat the largest page_id are responses too; a null page_id is below all others and written as
    ``urn:x-page:null``; a null url has no target header; an empty table gives an empty table; other columns are not read.
    """
    folder = track(scratch_path(pages.sparkSession, "warc"))
    index = write_bundles(mark_revisits(pages), folder)
    return read_bundles(index, folder).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
),
k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n
"""
