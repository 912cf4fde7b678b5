"""WARC archives compressed with Zstandard: writing, and reading with validation.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary, itself compressed, when there is one; each record is one
Zstandard frame after it. The reader loads the dictionary from that frame,
finds the frames' ends by walking their block headers, and decodes one frame at
a time from a stream, so its memory follows the largest record and not the
archive. Every record is validated: version line, required headers, block
length against Content-Length, the closing blank lines, and for responses the
HTTP length and the payload's SHA-1.

Archives are written by the tasks themselves into a folder that all executors
share (any file system that pyarrow opens by URI), under names that hold a fresh
unique part; the manifest of a finished task names the files that count, so a
retried or speculative task does no harm.

Defined results: a null payload is the empty payload; a null page_id is written
without its header and read back as null, and never is the page that others
revisit; of equal payloads all rows that carry the largest page_id are
responses. A frame that doesn't decode and a record that fails validation have
``error`` set and no payload, and reading goes on with the next frame (a cut end
gives one error row); a wrong dictionary or a damaged one's records are error
rows too; ``strict`` raises instead. A very long payload is a frame like any other and
sets the reader's memory; equal rows are records of their own; an empty table
gives no archive and no row. Only page_id, url and html are read, so no other
column's name clashes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, hot_among, spread_join

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES, CHUNK, LEVEL = 64 << 20, 1 << 20, 3
#: Bounds of the dictionary's training sample (pages, bytes of each) and of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16 << 10, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

MANIFEST = "path string, records long, bytes long"
RECORD = "path string, record_offset long, page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        out[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ValueError where it isn't valid."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no blank line after the headers")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    found = _headers(lines)
    if missing := [h for h in REQUIRED if h.lower() not in found]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not found["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length = int(found["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block and its end have {len(rest)} bytes")
    block, kind = rest[:length], found["warc-type"]
    http, blank, payload = block.partition(b"\r\n\r\n")
    size = len(payload)
    if blank:
        inner = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
        if kind == "response" and inner.isdigit() and int(inner) != size:
            raise ValueError(f"the HTTP length is {inner}, the payload has {size} bytes")
        size = int(inner) if inner.isdigit() else size
    algorithm, _, value = found.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(value).hex() if algorithm == "sha1" else None
    if kind == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload doesn't have its digest")
    number = lambda name: int(found[name]) if name in found else None
    return {
        "page_id": number("x-page-id"), "target_uri": found.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("x-refers-to-page"), "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """One archive: the dictionary's frame, then a frame for each record."""

    def __init__(self, out, dictionary: bytes | None):
        self.out, self.bytes, self.records = out, 0, 0
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True, write_checksum=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.zip.compress(record))
        self.records += 1


class _Stream:
    """Bytes of an input stream, held from the current place on; the front is cut off only when more is read."""

    def __init__(self, source):
        self.source, self.held, self.at, self.gone = source, b"", 0, 0

    @property
    def place(self) -> int:
        return self.gone + self.at

    def have(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            more = self.source.read(max(CHUNK, n - len(self.held) + self.at))
            if not more:
                return False
            self.gone += self.at
            self.held, self.at = self.held[self.at :] + more, 0
        return True

    def look(self, n: int, skip: int = 0) -> bytes:
        """Up to n of the next bytes."""
        self.have(n + skip)
        return self.held[self.at + skip : self.at + skip + n]

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise DamagedFrame("the archive ends inside a frame")
        self.at += n
        return self.held[self.at - n : self.at]

    def seek_frame(self) -> bool:
        """Go on to the next place after this one where a frame may begin; False at the end."""
        self.take(1)
        while self.have(4):
            found = self.held.find(_MAGIC, self.at)
            if found >= 0:
                self.at = found
                return True
            self.at = len(self.held) - 3
            if not self.have(4):
                break
        self.at = len(self.held)
        return False


_MAGIC = struct.pack("<I", FRAME)


class DamagedFrame(ValueError):
    """A frame that can't be read."""


def _frame_length(stream: _Stream) -> int:
    """Length of the Zstandard frame at the stream's place, from its block headers."""
    head = stream.look(18)
    try:
        at = zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise DamagedFrame(f"no frame header: {e}") from e
    checksum = bool(head[4] & 4)
    while True:
        block = stream.look(3, at)
        if len(block) < 3:
            raise DamagedFrame("the archive ends inside a frame")
        field = int.from_bytes(block, "little")
        kind, size = (field >> 1) & 3, field >> 3
        if kind == 3 or size > 1 << 17:
            raise DamagedFrame("no block header where one must be")
        at += 3 + (1 if kind == 1 else size)
        if field & 1:
            return at + 4 * checksum


def _next_frame(stream: _Stream, unzip: zstandard.ZstdDecompressor) -> bytes:
    frame = stream.look(_frame_length(stream))
    try:
        found = unzip.decompressobj()
        content = found.decompress(frame)
    except zstandard.ZstdError as e:
        if stream.look(4, len(frame)) in (b"", _MAGIC):  # its block headers led to where a frame ends
            stream.take(len(frame))
        raise DamagedFrame(f"the frame doesn't decode: {e}") from e
    if not found.eof:
        raise DamagedFrame("the archive ends inside a frame")
    stream.take(len(frame))
    return content


def frames(source) -> Iterator[tuple[int, bytes | DamagedFrame]]:
    """(offset, content) of each record's frame of an archive; of a frame that can't be read, its error.

    After damage reading goes on at the frame's end when that can be trusted to
    begin another frame, and at the next place that looks like a frame's beginning otherwise.
    """
    stream, unzip = _Stream(source), zstandard.ZstdDecompressor()
    while stream.have(1):
        at = stream.place
        try:
            magic = int.from_bytes(stream.look(4), "little")
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                size = int.from_bytes(stream.look(4, 4), "little")
                stream.take(8)
                content = stream.take(size)
                if at == 0 and magic == SKIPPABLE:
                    unzip = _with_dictionary(content)
            elif magic == FRAME:
                yield at, _next_frame(stream, unzip)
            else:
                raise DamagedFrame("neither a Zstandard frame nor a skippable one")
        except DamagedFrame as e:
            yield at, e
            if stream.place == at and not stream.seek_frame():
                return


def _with_dictionary(content: bytes) -> zstandard.ZstdDecompressor:
    try:
        data = zstandard.ZstdDecompressor().decompress(content) if content[:4] == _MAGIC else content
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    except zstandard.ZstdError as e:
        raise DamagedFrame(f"the dictionary's frame doesn't decode: {e}") from e


def train_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of pages (page_id, payload); None where there is too little to learn from."""
    # First the sample's hash bound, from bare hashes; then only the pages within it travel, one for each hash.
    hashes = pages.where(F.octet_length("payload") > 0).select(F.xxhash64("page_id").alias("h"))
    least = hashes.orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if least is None:
        return None
    near = pages.select(F.xxhash64("page_id").alias("h"), F.substring("payload", 1, SAMPLE_BYTES).alias("part")).where((F.col("h") <= least) & (F.octet_length("part") > 0))
    samples = [bytes(r["part"]) for r in near.groupBy("h").agg(F.min("part").alias("part")).orderBy("h").collect()]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def _writer(folder: str, dictionary: bytes | None, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        archive, name, done = None, "", []
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    archive = ArchiveWriter(system.open_output_stream(name, compression=None), dictionary)
                archive.add(build_record(page_id, url, payload, digest, kind, refers_to))
                if archive.bytes >= most:
                    archive.out.close()
                    done.append((name, archive.records, archive.bytes))
                    archive = None
        if archive is not None:
            archive.out.close()
            done.append((name, archive.records, archive.bytes))
        paths, records, sizes = map(list, zip(*done, strict=True)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return write


def with_revisits(pages: DataFrame, ws: Workspace) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to) of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT_BYTES)
    groups = ws.save(large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL"), "groups")
    hot = hot_among(groups, ["digest"], "n", pages.count())
    joined = spread_join(rows, groups.select("digest", "last"), ["digest"], hot, F.col("page_id"))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, ws: Workspace, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes), saved."""
    sample = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    records = with_revisits(pages, ws)
    return ws.save(records.mapInArrow(_writer(folder, train_dictionary(sample), archive_bytes), MANIFEST), "manifest")


def _reader(folder: str, payloads: bool, strict: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = {"record_offset": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for at, raw in frames(source):
                        row = {"path": path, "record_offset": at}
                        try:
                            if isinstance(raw, DamagedFrame):
                                raise raw
                            row |= parse_record(raw)
                        except ValueError as e:
                            if strict:
                                raise ValueError(f"{path}, offset {at}: {e}") from e
                            row["error"] = str(e)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row.get("payload") or b"")
                        if len(rows) >= 2000 or size > 8 * CHUNK:
                            yield pack(rows)
                            rows, size = [], 0
                yield pack(rows)

    return read


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """A row for every record of the archives that ``manifest`` (path) names; archives are read in parallel."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(_reader(folder, payloads, strict), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back, strictly."""
    ws = Workspace(spark, "warc")
    folder = ws.path("archives")
    manifest = write_archives(pages, folder, ws, archive_bytes)
    return read_archives(manifest, folder, payloads=False, strict=True)
