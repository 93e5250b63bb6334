"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames and frames into archives; a skippable
footer frame holds the seek table (compressed and plain size of every frame), so that a reader
gets any record by decompressing one frame. The index maps a record's identifier to archive,
frame and its offset within the plain frame.

Of equal payloads of some length one response is stored and the others are revisit records that
refer to it. Archives go to any file system that Arrow opens (local, hdfs, s3, gs), under a
temporary name first and then renamed, so that a task that runs again leaves the same files.

Defined cases. A null payload is empty; a null url leaves out WARC-Target-URI; a null page_id is
written as ``null`` and comes back as null. Rows that repeat a page_id each have a record; among
rows with the largest page_id of a payload one that sorts first by url is the response. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pfs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.store import join_frequent_apart, settle, shared_dir

#: Equal payloads of this many bytes are stored once.
REVISIT_BYTES = 1000
#: Plain bytes after which a frame is closed, compressed bytes after which an archive is, and rows of an archive, about.
FRAME_BYTES, ARCHIVE_BYTES = 1 << 18, 16 << 20
#: Fixed values of the seekable format: magic of the skippable frame and of its footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record; a revisit (refers_to is set) holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_records(frame: bytes):
    """(offset, headers, HTTP header, payload) of each record of a plain frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in frame[at:end].decode().split("\r\n")[1:])
        block = frame[end + 4 : end + 4 + int(head["Content-Length"])]
        cut = block.index(b"\r\n\r\n") + 4
        yield at, head, block[:cut], block[cut:]
        at = end + 4 + len(block) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[frame[0] : frame[0] + frame[1]], max_output_size=frame[2])


class _Archive:
    """Frames of one archive as they fill."""

    def __init__(self):
        self.packed, self.sizes, self.plain, self.total, self.places = [], [], bytearray(), 0, []
        self.coder = zstandard.ZstdCompressor(level=3)

    def add(self, rid: str, record: bytes) -> None:
        self.places.append((rid, len(self.sizes), len(self.plain)))
        self.plain += record
        if len(self.plain) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.plain:
            frame = self.coder.compress(bytes(self.plain))
            self.sizes.append((len(frame), len(self.plain)))
            self.packed.append(frame)
            self.total += len(frame)
            self.plain = bytearray()

    def data(self) -> bytes:
        self.close_frame()
        return b"".join(self.packed) + seek_table(self.sizes)


_INDEX = pa.schema([("record_id", pa.string()), ("archive", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())])


def _writer(folder: str):
    def run(batches):
        fs, path = pfs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)

        def finish(archive):
            data = archive.data()
            name = f"{hashlib.sha1(data).hexdigest()}.warc.zst"
            part = f"{path}/.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as out:
                out.write(data)
            fs.move(part, f"{path}/{name}")
            r, f, o = zip(*archive.places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array([name] * len(r)), pa.array(f, pa.int32()), pa.array(o, pa.int64())], schema=_INDEX)

        archive = _Archive()
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                archive.add(record_id(row["page_id"]), build_record(row["page_id"], row["url"], payload, row["digest"], row["size"], row["refers_to"]))
                if archive.total >= ARCHIVE_BYTES:
                    yield finish(archive)
                    archive = _Archive()
        if archive.places:
            yield finish(archive)

    return run


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with size, digest, and refers_to where the record is a revisit."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    full = full.withColumn("tag", F.xxhash64("page_id", "url", "digest"))
    bare = settle(full.where(F.col("size") >= least).select("page_id", "url", "size", "digest", "tag"))
    first = bare.groupBy("digest", "size").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "page_id", "tag")).alias("kept"), F.count("*").alias("_count")).where("_count > 1")
    again = settle(
        join_frequent_apart(bare, settle(first), ["digest", "size"], bare.count())
        .where(F.col("tag") != F.col("kept.tag"))
        .select("tag", F.col("kept.page_id").alias("refers_to"))
        .groupBy("tag").agg(F.first("refers_to").alias("refers_to"))
    )
    out = full.join(again, "tag", "left")
    # Rows alike in all columns: one of them is the response, if that is what they are.
    twice = settle(bare.groupBy("tag").agg(F.count("*").alias("_count")).where("_count > 1"))
    if twice.isEmpty():
        return out.drop("tag")
    some = settle(join_frequent_apart(out, twice, ["tag"], bare.count()).withColumn("n", F.monotonically_increasing_id()))
    lead = settle(some.groupBy("tag").agg(F.min("n").alias("lead"), F.count("*").alias("_count")))
    some = join_frequent_apart(some, lead, ["tag"], some.count())
    some = some.withColumn("refers_to", F.when(F.col("refers_to").isNull() & (F.col("n") != F.col("lead")), F.col("page_id")).otherwise(F.col("refers_to")))
    return out.join(twice, "tag", "left_anti").unionByName(some.select(out.columns)).drop("tag")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives and return the index: record_id, archive, frame, frame_offset."""
    return settle(plan_records(pages).mapInArrow(_writer(folder), "record_id string, archive string, frame int, frame_offset bigint"))


_READ = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, archive string, frame int, frame_offset bigint"


def _page(value: str | None):
    return None if value is None or value == "<urn:page:null>" else int(value[len("<urn:page:") : -1])


def _reader(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            for k, frame in enumerate(read_seek_table(data)):
                rows = []
                for at, head, http, payload in parse_records(read_frame(data, frame)):
                    kind = head["WARC-Type"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    rows.append((head["WARC-Record-ID"], _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, _page(head.get("WARC-Refers-To")), digest, size, payload if kind == "response" else None, path.rsplit("/", 1)[-1], k, at))
                names = [c.split()[0] for c in _READ.split(", ")]
                kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "frame": pa.int32(), "frame_offset": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in a folder; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(_reader, _READ)


def read_record(folder: str, archive: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """Headers and payload of one record, from its archive's seek table and one frame."""
    fs, path = pfs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{archive}") as f:
        size = f.size()
        n = struct.unpack("<I", f.read_at(4, size - 9))[0]
        sizes = list(struct.iter_unpack("<II", f.read_at(8 * n, size - 9 - 8 * n)))
        packed = f.read_at(sizes[frame][0], sum(s for s, _ in sizes[:frame]))
    plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=sizes[frame][1])
    _, head, _, payload = next(parse_records(plain[offset:]))
    return head, payload


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and report each record."""
    folder = shared_dir(pages.sparkSession)
    write_archives(pages.select("page_id", "url", "html"), folder)
    back = read_archives(pages.sparkSession, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "frame", "frame_offset")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND keep <> page_id THEN keep END AS refers_to
FROM m
"""
