"""WARC archives: a deduplicating writer and a salvage reader.

Writing: pages with equal payloads share one response record, that of the smallest page id; the others are
revisit records that refer to it. Each task writes archives of its own, one gzip member per record.

Reading: every record is checked (member checksum, version line, header digest, lengths, block digest). What is
read is decided anew at every position: a gzip member that opens with a version line, or a version line itself. After a
failed check the reader searches on for the next start of either kind that passes all checks, reads on from
there, and logs the bytes in between as a quarantined gap. Nothing but one record and one block of the file is in memory at a time; a
member is unpacked no further than its header says.

The header digest, an extension field over all other header lines, is required of archives that this writer
made; for those of others pass ``signed=False``, then it is checked where there is one. A number that is
malformed, not absent, breaks its record.

Null payloads are empty ones; empty payloads are payloads like others (`least_bytes` says from which
size on copies become revisits). Rows without a page id are written with an empty id; they count as
larger than any id. Rows that repeat the smallest page id of a payload are all responses. An empty table
gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.llm.common import attempt_name, joined_path, open_folder, record_batches
from savora.session import scratch_path, stored

BLOCK = 1 << 20
ARCHIVE_BYTES = 256 << 20
# Fixed values of the format.
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_FIELD, LENGTH_FIELD = "WARC-X-Page-ID", "WARC-X-Refers-To-Page-ID", "WARC-X-Payload-Length"
HEADER_FIELD = "WARC-X-Header-Digest"
HEADER_BYTES = 64 << 20
ARCHIVES = pa.schema([("folder", pa.string()), ("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
ARCHIVES_DDL = "folder string, archive string, records bigint, bytes bigint"
READ = pa.schema(
    [
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("quarantined", pa.bool_()), ("reason", pa.string()),
        ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ]
)
READ_DDL = (
    "archive string, offset bigint, length bigint, quarantined boolean, reason string, page_id bigint, record_type string, "
    "url string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
)


def digest_of(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: object) -> str:
    return "" if value is None else str(value).replace("\r", " ").replace("\n", " ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record without compression; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = hashlib.sha1(f"{page_id}|{_one_line(url)}|{digest}|{revisit}".encode()).hexdigest()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-8{name[17:20]}-{name[20:32]}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        (PAGE_FIELD, _one_line(page_id)),
        (LENGTH_FIELD, str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), (REFERS_FIELD, _one_line(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSIONS[1] + "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return head + f"{HEADER_FIELD}: sha1:{digest_of(head)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_types(pages: DataFrame, least_bytes: int = 0, payload: str = "html") -> DataFrame:
    """Pages with the digest of their payload, their record type and the page they refer to."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    # Written, so that the join can split a payload that very many pages share.
    first = stored(
        rows.where(large).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"),
        "first-pages",
    )
    revisit = large & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return (
        rows.join(first, "sha1", "left")
        .withColumn("revisit", revisit)
        .select("page_id", "url", "payload", "revisit", F.when(revisit, F.col("first")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, compress: bool = True, payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; the list of archives comes back, only those of successful attempts."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        part, out, name, count, size = TaskContext.get().partitionId(), None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, body, revisit, refers in zip(*batch.columns, strict=True):
                if out is None:
                    name, count, size = attempt_name(f"pages-{part:06d}", ".warc.gz" if compress else ".warc"), 0, 0
                    out = files.open_output_stream(joined_path(root, name), compression=None)
                data = body.as_py()
                data = record(page_id.as_py(), url.as_py(), data, digest_of(data), refers.as_py(), revisit.as_py())
                data = _member(data) if compress else data
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((folder, name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((folder, name, count, size))
        yield from record_batches(done, ARCHIVES)

    rows = with_types(pages, least_bytes, payload).select("page_id", "url", "payload", "revisit", "refers_to")
    return stored(rows.mapInArrow(run, ARCHIVES_DDL), "warc-archives")


class Source:
    """Bytes of a file by position, through one window that is read on as needed."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block, self.size = file, block, file.size()
        self.at, self.window = 0, b""

    def read(self, start: int, count: int) -> bytes:
        if not (self.at <= start and start + count <= self.at + len(self.window)):
            self.at, self.window = start, self.file.read_at(max(0, min(max(count, self.block), self.size - start)), start)
        return self.window[start - self.at:start - self.at + count]

    def find(self, patterns: tuple[bytes, ...], start: int) -> int:
        """Where the first of the patterns begins at or behind ``start``; the file's end if none does."""
        overlap = max(map(len, patterns)) - 1
        while start < self.size:
            data = self.read(start, self.block)
            hits = [p for p in (data.find(x) for x in patterns) if p >= 0]
            if hits:
                return start + min(hits)
            if start + len(data) >= self.size:
                break
            start += len(data) - overlap
        return self.size


class Broken(Exception):
    """A record that fails a check."""


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without a colon")
        found[name.strip().lower()] = value.strip()
    return found


def _header(head: bytes, signed: bool) -> tuple[dict[str, str], int]:
    """The fields of a whole header and the length of the block, once the header has passed its checks."""
    if not (head + b"\r\n").startswith(VERSIONS):
        raise Broken("no version line")
    lines, _, last = head.rpartition(b"\r\n")
    name, _, digest = last.decode("utf-8", "replace").partition(": ")
    if name == HEADER_FIELD:
        if digest != f"sha1:{digest_of(lines + b'\r\n')}":
            raise Broken("header digest")
    elif signed:
        raise Broken("no header digest")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("length of the block")
    return fields, int(length)


def _checked(fields: dict[str, str], rest: bytes) -> dict:
    """The parts of one record whose header is good; ``rest`` is what follows the header's blank line."""
    if rest[-4:] != b"\r\n\r\n":
        raise Broken("end of the block")
    block = rest[:-4]
    if fields.get("warc-block-digest") not in (None, f"sha1:{digest_of(block)}"):
        raise Broken("block digest")
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != digest_of(payload):
        raise Broken("payload digest")

    def number(name: str) -> int | None:
        value = fields.get(name.lower(), "")
        if not value:
            return None
        if not (value.isascii() and value.removeprefix("-").isdigit()):
            raise Broken(f"number in {name}")
        return int(value)

    return {
        "page_id": number(PAGE_FIELD), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": number(REFERS_FIELD),
        "payload_digest": digest, "payload_bytes": number(LENGTH_FIELD), "payload": payload if kind == "response" else None,
    }


def _member_at(source: Source, start: int, signed: bool) -> tuple[dict, int]:
    """The record in the gzip member at ``start``, and the member's end."""
    unpacker, data, at, tail = zlib.decompressobj(31), bytearray(), start, b""
    fields, body, length, seen = None, 0, 0, 0
    try:
        while not unpacker.eof:
            if not tail:
                tail = source.read(at, min(64 << 10, source.size - at))
                if not tail:
                    raise Broken("member cut off")
                at += len(tail)
            data += unpacker.decompress(tail, 1 << 20)
            tail = unpacker.unconsumed_tail
            if fields is None:
                if not data[:10].startswith(tuple(v[:len(data)] for v in VERSIONS)):
                    raise Broken("no version line")
                stop = data.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(data)
                if stop >= 0:
                    fields, length = _header(bytes(data[:stop]), signed)
                    body = stop + 4
                elif len(data) > HEADER_BYTES:
                    raise Broken("header without an end")
            if fields is not None and len(data) > body + length + 4:
                raise Broken("length of the block")
    except zlib.error as error:
        raise Broken(f"member: {error}") from None
    if fields is None or len(data) != body + length + 4:
        raise Broken("length of the block")
    return _checked(fields, bytes(data[body:])), at - len(unpacker.unused_data)


def _plain_at(source: Source, start: int, signed: bool) -> tuple[dict, int]:
    """The record that is written at ``start`` as it is, and its end."""
    # A header has no version line but its first, so the search ends at the next record at the latest.
    ends = (b"\r\n\r\n", *(b"\n" + v for v in VERSIONS))
    stop = source.find(ends, start)
    if source.read(stop, 4) != ends[0]:
        raise Broken("header cut off")
    fields, length = _header(source.read(start, stop - start), signed)
    body = stop + 4
    if body + length + 4 > source.size:
        raise Broken("block cut off")
    return _checked(fields, source.read(body, length + 4)), body + length + 4


def _record_at(source: Source, start: int, signed: bool) -> tuple[dict, int]:
    head = source.read(start, min(10, source.size - start))
    if head.startswith(GZIP_MAGIC):
        return _member_at(source, start, signed)
    if head.startswith(VERSIONS):
        return _plain_at(source, start, signed)
    raise Broken("neither a member nor a version line")


def salvage(source: Source, signed: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, length, record, None) of each good record and (start, length, None, reason) of each gap."""
    at, gap, reason = 0, None, None
    while at < source.size:
        try:
            found, end = _record_at(source, at, signed)
        except Broken as error:
            if gap is None:
                gap, reason = at, str(error)
            at = source.find((GZIP_MAGIC, *VERSIONS), at + 1)
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        yield at, end - at, found, None
        at = end
    if gap is not None:
        yield gap, source.size - gap, None, reason


def read_archives(archives: DataFrame, signed: bool = True) -> DataFrame:
    """All records of the listed archives (``folder``, ``archive``); gaps are the rows with ``quarantined``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = READ.names[5:]

        def rows():
            for batch in batches:
                for folder, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    files, root = open_folder(folder)
                    with files.open_input_file(joined_path(root, archive)) as file:
                        for start, length, found, reason in salvage(Source(file), signed):
                            values = [found[n] for n in names] if found else [None] * len(names)
                            yield archive, start, length, found is None, reason, *values

        yield from record_batches(rows(), READ)

    spread = archives.select("folder", "archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(run, READ_DDL)


def good(read: DataFrame) -> DataFrame:
    return read.where(~F.col("quarantined"))


def quarantine(read: DataFrame) -> DataFrame:
    """The log of gaps."""
    return read.where("quarantined").select("archive", "offset", "length", "reason")
