"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the seek table
of the seekable format (a skippable frame with each frame's sizes and a magic
number), so a reader finds any frame from the footer alone.  The index maps a
record's identifier to its bundle, frame and offset within the frame.

Payloads are compared by length and SHA-256: of equal ones the record with the
largest ``page_id`` is a response and the others revisit it.  The largest id of
each payload is aggregated before the shuffle and joined back, so a payload
that many pages share is a skewed join key, not a group in one task.

Tasks write bundles of bounded size to the shared folder through its own file
system, under a temporary name first; a task that runs again writes the same
bytes to the same names.

Defined results: a null html is an empty payload; a null url leaves the header
out; a null ``page_id`` is a response if no record of that payload has an id,
else a revisit; rows that repeat the largest id are all responses; an empty
table writes nothing and reads as no rows.  Other columns are not read.  A record
is one frame at least, held whole by one task; one of 4 GiB or more is an error,
as the seek table has 32 bits for its size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.skew import dealt_join

from .shared import new_path, written

#: Bytes of records in a frame, and compressed bytes in a bundle, after which the next begins.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, seq: str = "") -> str:
    """A record's identifier: the same for the same page in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{seq}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit holds the response's head without its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URI)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URI = "".join(chr(c) for c in range(0x21, 0x7F))


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record from ``at`` on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """Frames of records, and the seek table that ends them."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset within the frame) of a new record."""
        place = len(self.frames), self.held
        self.open.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def size(self) -> int:
        return sum(s for s, _ in self.sizes)

    def close(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from a bundle's last bytes."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", tail, len(tail) - 9 - width * (n - k))
        out.append((start, packed, size))
        start += packed
    return out


def frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    start, packed, size = entry
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, length long"


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal payloads all but the
    largest refer to it.  A payload of very many pages is a hot key, which can be
    split."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_key", F.concat_ws(":", F.octet_length("html"), F.sha2("html", 256)))
    first = rows.groupBy("payload_key").agg(F.max("page_id").alias("head"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("head")), F.lit(None)).otherwise(F.col("head"))
    return dealt_join(rows, first, "payload_key").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the bundles of ``pages`` to ``folder`` and returns the index."""
    dealt = revisits(pages, page_id, url, html).sortWithinPartitions("page_id", "url", "html")

    def run(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task, attempt, k = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        bundle, index = Bundle(), []

        def close():
            name = f"{root}/part-{task:06d}-{k:04d}.warc.zst"
            with fs.open_output_stream(f"{root}/_{task}-{k}-{attempt}") as f:
                f.write(bundle.close())
            fs.move(f"{root}/_{task}-{k}-{attempt}", name)
            columns = list(zip(*((record_id(p), p, f"part-{task:06d}-{k:04d}.warc.zst", *rest) for p, *rest in index), strict=True))
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for page, address, text, head in zip(*(batch.column(i) for i in range(4)), strict=True):
                page = page.as_py()
                raw = record(page, address.as_py(), text.as_py().encode(), head.as_py())
                index.append((page, *bundle.add(raw), len(raw)))
                if bundle.size() >= BUNDLE_BYTES:
                    yield close()
                    bundle, index, k = Bundle(), [], k + 1
        if index:
            yield close()

    path = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return written(dealt.mapInArrow(run, INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, frame int, frame_offset long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles of a folder, frame by frame from their seek
    tables; a response's digest is computed anew and must match its header."""
    bundles = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                for k, entry in enumerate(seek_table(raw)):
                    out = []
                    for at, headers, block in parse(frame(raw, entry)):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        if headers["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                            raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
                        number = lambda key: int(headers[key]) if key in headers else None  # noqa: B023, E731
                        out.append((number("X-Page-ID"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page-ID"), headers.get("WARC-Target-URI"), k, at))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

    return bundles.mapInArrow(run, RECORDS)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record) of the records in an index, usually a filtered one:
    each is read by a seek to its frame."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['bundle']}") as f:
                    f.seek(max(0, f.size() - 9))
                    n, _, _ = struct.unpack("<IBI", f.read(9))
                    f.seek(f.size() - 9 - 8 * n)
                    start, packed, size = seek_table(f.read())[r["frame"]]
                    f.seek(start)
                    raw = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
                out.append((r["page_id"], raw[r["frame_offset"] : r["frame_offset"] + r["length"]]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["page_id", "record"])

    return index.select("page_id", "bundle", "frame", "frame_offset", "length").mapInArrow(run, "page_id long, record binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a fresh folder of the shared one and reads it back."""
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
