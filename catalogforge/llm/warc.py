"""WARC records in seekable Zstandard bundles.

Equal payloads are found by digest with narrow rows only: the page with the largest id
is the response, the others revisit it. Records then go to bundle files in id order
within a task. A bundle is a run of independent Zstandard frames, each holding a group
of whole records, closed by a seek table in a skippable frame, so any frame can be
reached without its neighbours. An index maps every record to its frame and to its
place in the frame.

Bundles are written straight to the shared folder through ``pyarrow.fs``, under a name
of the attempt first and then renamed. A task that runs again writes the same bytes to
the same name, as its records are sorted.

Defined cases: null payloads count as empty; empty payloads are equal to one another; a
payload held by one page id twice is a response in each row of the largest id; a null
``page_id`` is the smallest and refers as any other; a null ``url`` has no target line;
an empty table writes no bundle; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogforge.llm.common import hot_join
from catalogforge.session import scratch_path, stage

# Bytes of records before a frame closes, and of frames before a bundle closes.
FRAME = 512 << 10
BUNDLE = 128 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

INDEX = (
    "record_id string, page_id long, bundle string, frame int, frame_at long, frame_size long,"
    " place long, size long"
)
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary"
)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, n_bytes, refers_to``: null where a page is a response."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"),
    )
    facts = stage(
        rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n_bytes")),
        "warc-facts",
    )
    firsts = facts.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    found = hot_join(facts, firsts, "digest", "n", facts.count())
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    # One row for each id and payload, also where rows repeat.
    narrow = found.select(
        "page_id", "digest", "n_bytes", F.when(other, F.col("first")).alias("refers_to")
    ).distinct()
    keyed = rows.withColumn("digest", F.sha1("html"))
    match = keyed["page_id"].eqNullSafe(narrow["page_id"]) & (keyed["digest"] == narrow["digest"])
    return keyed.join(narrow, match).select(
        keyed["page_id"], "url", "html", keyed["digest"], "n_bytes", "refers_to"
    )


def _base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _record(page_id, url: str | None, html: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"Content-Length: %d\r\n\r\n" % n_bytes
    if refers_to is None:
        block += html
    else:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of an unpacked frame, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(http.rpartition(b"Content-Length: ")[2])
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != stated:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
    record = {
        "record_id": fields["WARC-Record-ID"],
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": stated,
        "payload_digest": digest,
        "refers_to": None if refers is None else int(refers),
        "payload": payload if kind == "response" else None,
    }
    return record, end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame of (packed, unpacked) sizes, ending with the seekable footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames)
    foot = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body) + len(foot)) + body + foot


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, packed size, unpacked size) of each frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    body, at, frames = file.read(width * count), 0, []
    for i in range(count):
        packed, unpacked = struct.unpack_from("<II", body, width * i)
        frames.append((at, packed, unpacked))
        at += packed
    return frames


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class _Bundle:
    """A bundle being written: rows of the index come out when it closes."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.files, base = _open(folder)
        self.files.create_dir(base, recursive=True)
        self.name, self.path = f"{folder}/{name}", f"{base}/{name}"
        self.draft = f"{self.path}.{attempt}-{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.draft)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.held_size = 0, [], 0
        self.rows: list[tuple] = []

    def add(self, page_id, record: bytes) -> None:
        row = (record_id(page_id), page_id, self.name, len(self.frames), self.held_size, len(record))
        self.rows.append(row)
        self.held.append(record)
        self.held_size += len(record)
        if self.held_size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.held_size))
            self.at, self.held, self.held_size = self.at + len(packed), [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.files.move(self.draft, self.path)
        starts = [0]
        for packed, _ in self.frames:
            starts.append(starts[-1] + packed)
        return [
            (rid, page, name, frame, starts[frame], self.frames[frame][0], place, size)
            for rid, page, name, frame, place, size in self.rows
        ]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles of ``pages`` to ``folder`` and returns the staged index (``INDEX``)."""
    names = ["record_id", "page_id", "bundle", "frame", "frame_at", "frame_size", "place", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bundle, count = TaskContext.get(), None, 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            columns = zip(*found, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, refers = (c[i].as_py() for c in batch.columns)
                if bundle is None:
                    name = f"part-{task.partitionId():06d}-{count:04d}.warc.zst"
                    bundle, count = _Bundle(folder, name, task.attemptNumber()), count + 1
                bundle.add(page_id, _record(page_id, url, html, digest, size, refers))
                if bundle.at >= BUNDLE:
                    yield rows(bundle.close())
                    bundle = None
        if bundle is not None:
            yield rows(bundle.close())

    sorted_rows = decided(pages).sortWithinPartitions("page_id", "digest", "url")
    return stage(sorted_rows.mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record (``RECORD``) of the bundles that ``index`` names, found by their seek tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [
                ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
            ]
        )
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = _open(name)
                with files.open_input_file(path) as file:
                    for at, packed, unpacked in read_seek_table(file):
                        file.seek(at)
                        data = unpacker.decompress(file.read(packed), max_output_size=unpacked)
                        found, place = [], 0
                        while place < len(data):
                            record, place = parse_record(data, place)
                            if not payloads:
                                record["payload"] = None
                            found.append(record)
                        yield pa.RecordBatch.from_pylist(found, kinds)

    # As many tasks as bundles, up to those that a shuffle of the session has four times over; a
    # count that is given is kept, where a few short names would else be merged into one task.
    names = stage(index.select("bundle").distinct(), "warc-bundles")
    tasks = 4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = names.repartition(max(1, min(names.count(), tasks)))
    return dealt.mapInArrow(run, RECORD)


def read_record(entry: dict) -> dict:
    """The one record that a row of the index points to; reads its frame alone."""
    files, path = _open(entry["bundle"])
    with files.open_input_file(path) as file:
        file.seek(entry["frame_at"])
        data = zstandard.ZstdDecompressor().decompress(file.read(entry["frame_size"]))
    return parse_record(data, entry["place"])[0]


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a fresh shared folder and reads every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_bundles(write(pages, folder), payloads=False)
