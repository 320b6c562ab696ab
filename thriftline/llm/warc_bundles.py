"""WARC archives as seekable Zstandard files: records in independent frames, a seek table at the end, and an index."""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import new_path, write_through
from .frames import named, pieces
from .hot_keys import attach

# Fixed values of the seekable format and of the WARC standard.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Bytes of records in a frame, and compressed bytes after which a task begins another archive.
FRAME_BYTES, ARCHIVE_BYTES = 1 << 20, 1 << 28
#: Neighbouring frames that one task reads, so some 64 MiB of records.
RUN_FRAMES = 64
INDEX = "record_id string, archive string, frame int, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:"):-1] if name else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds no payload but its digest and, as an extension field, its length."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if revisit else head + payload
    fields = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:  # a line break would end the field
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the payload, empty for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Archive:
    """Writes one archive: frames one after another, then the seek table in a skippable frame."""

    def __init__(self, store: fs.FileSystem, path: str, level: int):
        self.out = store.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.frame = bytearray()
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Number of the record's frame and its offset in the frame's content."""
        place = len(self.table), len(self.frame)
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.frame:
            content = bytes(self.frame)
            packed = self.zstd.compress(content)
            self.out.write(packed)
            self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.written += len(packed)
            self.frame.clear()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Seekable:
    """Reads single frames of an archive by its seek table; keeps the last one."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        entries = struct.iter_unpack("<III", self.file.read_at(12 * frames, size - 9 - 12 * frames))
        self.frames, at = [], 0
        for packed, content, check in entries:
            self.frames.append((at, packed, content, check))
            at += packed
        self.number, self.content = -1, b""
        self.zstd = zstandard.ZstdDecompressor()

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.number:
            at, packed, size, check = self.frames[frame]
            self.content = self.zstd.decompress(self.file.read_at(packed, at), max_output_size=size)
            if xxhash.xxh64_intdigest(self.content) & 0xFFFFFFFF != check:
                raise ValueError("a frame doesn't match its checksum")
            self.number = frame
        return self.content[offset:offset + length]


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page, sha and response of every page whose payload a page with a larger id has too."""
    html = F.coalesce(named(html_col), F.lit(""))
    seen = pages.select(
        named(id_col).cast("long").alias("page"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    seen = write_through(seen.filter(F.col("n") >= min_bytes).select("page", "sha"), "payload_digests")
    first = seen.groupBy("sha").agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = attach(seen, first, ["sha"], "n", seen.count(), how="inner")  # one payload, such as none, may be that of many pages
    return found.filter(~F.col("page").eqNullSafe(F.col("response"))).select("page", "sha", "response").distinct()


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3,
) -> DataFrame:
    """Write one WARC record per row into archives below ``folder``; returns the index of the records.

    ``folder`` must be one that all executors reach (a path or a URI that Arrow
    knows).  Each task writes its own archives ``*.warc.zst``: frames of about 1
    MiB that can be decompressed one by one, then a footer with the seek table.
    The index maps record_id to archive, frame, offset in the frame and length.
    It is written too, and names only archives of the tasks whose result counts;
    a task that is run again writes files of another name.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the
    largest id is a response and the others revisit it.  Rows with the response's
    own id and payload are responses as well.  Null html is an empty payload, a
    null url leaves out the field, a null id gives a record of the empty page
    name (and is smaller than any other).  Line breaks in a url are escaped.
    A page of any length is one record.  Without rows there is an empty index.
    """
    html = F.coalesce(named(html_col), F.lit(""))
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), html.alias("html"))
    known = revisits(pages, id_col, html_col, min_bytes)
    same = F.col("page_id").eqNullSafe(F.col("page")) & (F.sha1(F.col("html").cast("binary")) == F.col("sha"))
    rows = rows.join(known, same, "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), "response", F.col("sha").isNotNull().alias("revisit"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, archive, name = TaskContext.get().partitionId(), None, ""
        for batch in pieces(batches, 1024):
            index: list[tuple] = []
            for page_id, url, payload, response, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if archive is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    archive = Archive(store, f"{base}/{name}", level)
                data = record(page_id, url, payload, response, revisit, date)
                frame, offset = archive.add(data)
                index.append((record_name(page_id), name, frame, offset, len(data)))
                if archive.written >= ARCHIVE_BYTES:
                    archive.close()
                    archive = None
            if index:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    ["record_id", "archive", "frame", "offset", "length"])
        if archive is not None:
            archive.close()

    return write_through(rows.mapInArrow(written, INDEX), "warc_index")


def read_bundles(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the records that ``index`` names: any part of the index that ``write_bundles`` has returned.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if
    asked for, payload (null for revisits).  A frame is read and decompressed
    once for neighbouring records.  Checksums and digests are verified.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, archive = None, None
        for batch in pieces(batches, 1024):
            found: list[tuple] = []
            for own, frame, offset, length in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                if own != name:
                    name, archive = own, Seekable(store, f"{base}/{own}")
                fields, payload = parse(archive.read(frame, offset, length))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                if kind == "response" and (payload_digest(payload), str(len(payload))) != (digest, fields["warc-payload-length"]):
                    raise ValueError(f"{fields['warc-record-id']}: the payload doesn't match its digest")
                found.append((
                    page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["warc-payload-length"]), digest, kind,
                    page_of(fields.get("warc-refers-to")), payload if kind == "response" else None))
            if found:
                columns = list(zip(*found))[:7 if with_payload else 6]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[:len(columns)])

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = index.select("record_id", "archive", "frame", "offset", "length")
    # A task reads whole runs of frames.  A given number of tasks isn't merged by the small size of the index.
    run = F.floor(F.col("frame") / RUN_FRAMES)
    runs = rows.agg(F.count_distinct("archive", run)).first()[0]
    rows = rows.repartition(max(1, runs), "archive", run).sortWithinPartitions("archive", "frame", "offset")
    return rows.mapInArrow(read, schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to a new shared folder and read every record back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, **options), folder)
