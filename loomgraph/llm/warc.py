"""WARC archives as seekable Zstandard bundles.

Writing: a record for each page, in bundles of bounded size. Inside a bundle, records are grouped into independent
Zstandard frames of about ``FRAME_BYTES``; a footer in a skippable frame holds the seek table (each frame's compressed and
plain size), and an index table maps each record's id to (bundle, frame, offset in the frame, length). One record is read by
finding its frame in the footer, seeking to it and decompressing that frame alone. Of records with equal payloads of at least ``SHARED_BYTES`` the one
with the smallest id is a response and the others revisit it, without a payload of their own.

Bundles go to a folder that all executors share, through pyarrow's file systems, each attempt of a task to a subfolder of its own, under a
temporary name first and moved when whole. An attempt that dies or is outrun may leave whole bundles; the index lists only bundles of
attempts that succeeded, readers open no others, and the subfolders it doesn't name are removed when it has been written.

A null page is an empty payload; a null url or id becomes an empty header value; a null id is never revisited; rows that repeat the smallest id of a payload are
responses each. Very long pages are whole: a frame holds at least one record. An empty table writes no bundle. Extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, stored

#: Plain bytes of a frame, and compressed bytes of a bundle, at which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Least bytes of a payload that others may revisit.
SHARED_BYTES = 100
#: Zstandard's magic numbers of a skippable frame and of the seek table's footer: fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id long, bundle string, frame int, frame_offset long, length long"
FOUND = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: sizes of its frames, their number, no checksums, the magic number."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(end: bytes) -> list[tuple[int, int]]:
    """Frames (compressed, plain size) from a bundle's last bytes, all of the table at least."""
    count, _, magic = struct.unpack("<IBI", end[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    return [struct.unpack_from("<II", end, len(end) - 9 - 8 * (count - k)) for k in range(count)]


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """A WARC/1.1 record; original is the page that a revisit refers to, None for a response."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%-._~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if original is not None:
        head += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


class BundleWriter:
    """One bundle at a time; rows of the index for what was written come from close()."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.attempt = uuid.uuid4().hex
        self.path = f"{path}/{self.attempt}"
        self.store.create_dir(self.path, recursive=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.press = zstandard.ZstdCompressor(level=3)
        self.begin()

    def begin(self) -> None:
        self.name, self.out = f"{uuid.uuid4().hex}.warc.zst", None
        self.frames: list[tuple[int, int]] = []
        self.at, self.rows, self.held = 0, [], []
        self.plain = 0

    def add(self, record_id: int | None, raw: bytes) -> list[tuple]:
        self.held.append((record_id, self.plain, raw))
        self.plain += len(raw)
        if self.plain >= self.frame_bytes:
            self.flush()
        return self.close() if self.at >= self.bundle_bytes else []

    def flush(self) -> None:
        if not self.held:
            return
        if self.out is None:
            self.out = self.store.open_output_stream(f"{self.path}/.{self.name}.tmp")
        packed = self.press.compress(b"".join(raw for *_, raw in self.held))
        self.out.write(packed)
        for record_id, offset, raw in self.held:
            self.rows.append((record_id, f"{self.attempt}/{self.name}", len(self.frames), offset, len(raw)))
        self.frames.append((len(packed), self.plain))
        self.at += len(packed)
        self.held, self.plain = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        if self.out is None:
            return []
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.store.move(f"{self.path}/.{self.name}.tmp", f"{self.path}/{self.name}")
        rows = self.rows
        self.begin()
        return rows


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as bundles into folder; the index, stored beside them."""
    keyed = pages.select("page_id", "url", "html", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest"))
    first = keyed.filter(F.col("bytes") >= SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # written first, so that the join below knows its size: a small table is broadcast and pages stay where they are read
    revisits = stored(
        keyed.filter(F.col("bytes") >= SHARED_BYTES)
        .select("page_id", "digest")
        .join(first, "digest")
        .filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
        .select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first")
        .distinct(),
        "warc-revisits",
    )
    marked = keyed.join(revisits, keyed["page_id"].eqNullSafe(revisits["id"]) & (keyed["digest"] == revisits["of"]), "left").select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        names = [x.split(" ")[0] for x in INDEX.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for page, url, html, digest, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from out(writer.add(page, record(page, url, (html or "").encode(), digest, original)))
        yield from out(writer.close())

    index = stored(marked.mapInArrow(run, INDEX), "warc-index")
    sweep_attempts(index, folder)
    return index


def sweep_attempts(index: DataFrame, folder: str) -> None:
    """Remove what attempts left that index doesn't name: a subfolder each. Their names, one a task, come to the driver."""
    named = {r.attempt for r in index.select(F.substring_index("bundle", "/", 1).alias("attempt")).distinct().collect()}
    store, path = fs.FileSystem.from_uri(folder)
    for one in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if one.base_name not in named:
            store.delete_dir(one.path)


def seek_entries(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Frames (start, compressed size, plain size) of an open bundle, from the footer at its end."""
    total = f.size()
    count = struct.unpack("<IBI", f.read_at(9, total - 9))[0]
    size = 8 * count + 9
    frames = read_seek_table(f.read_at(size, total - size))
    starts = accumulate((packed for packed, _ in frames), initial=0)
    return [(start, packed, plain) for start, (packed, plain) in zip(starts, frames, strict=False)]


def frames_of(bundle: str) -> list[tuple[int, int, int]]:
    """The seek table of a bundle."""
    store, path = fs.FileSystem.from_uri(bundle)
    with store.open_input_file(path) as f:
        return seek_entries(f)


def read_records(bundle: str, places: list[tuple[int, int, int]]) -> Iterator[bytes]:
    """Records at (frame, offset, length) of a bundle: frames are found in its footer, and each fetched and unpacked once a run."""
    store, path = fs.FileSystem.from_uri(bundle)
    unpack, held, plain = zstandard.ZstdDecompressor(), None, b""
    with store.open_input_file(path) as f:
        frames = seek_entries(f)
        for frame, offset, length in places:
            if held != frame:
                start, packed, size = frames[frame]
                held, plain = frame, unpack.decompress(f.read_at(packed, start))
                if len(plain) != size:
                    raise ValueError(f"frame {frame} of {bundle} is damaged")
            yield plain[offset : offset + length]


def read_back(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The archived records that index lists. With payloads, those of revisits stay null: their original has it."""
    # a task takes whole runs of a bundle's frames: places of a bundle are dealt by frame, so a large bundle isn't one task
    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "frame_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in FOUND.split(", ")]
        for batch in batches:
            table = defaultdict(list)
            for row in batch.to_pylist():
                table[row["bundle"]].append(row)
            for bundle, rows in table.items():
                out, held = [], 0
                places = [(r["frame"], r["frame_offset"], r["length"]) for r in rows]
                for row, raw in zip(rows, read_records(f"{folder}/{bundle}", places), strict=True):
                    headers, payload = parse(raw)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {row['record_id']} of {bundle} is damaged")
                    refers = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                    out.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, headers["WARC-Target-URI"], payload if payloads and kind == "response" else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, FOUND)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for bundles in the shared folder."""
    spark = pages.sparkSession
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
