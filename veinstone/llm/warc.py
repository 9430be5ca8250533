"""WARC archives: a writer with revisit records, and a salvage reader.

Each record is a gzip member of its own. Of records with equal payloads of at least LEAST bytes, that with the smallest
page_id is a response and the others are revisits of it, which keep the HTTP header (and with it the length of the
payload) and the payload's digest, but not the payload. Where page_ids repeat, all rows of the smallest id are
responses, and rows without an id are revisits only where their payload also stands under an id.

The reader checks every member (CRC), record (version line, length) and digest. After a failed check it searches for the
next member or version line from which a record can be read and goes on there. It searches inside members as well: of a
member with a bad byte, a wrong checksum or a missing end it recovers the records whose own digests hold, and of a sound
member with a bad record all others. What it leaves out it reports as gaps, in bytes of the archive and, inside a member, of
what the member holds. Archives and members are streamed: memory is bounded by the largest record (where a damaged length
says more, by the rest of its member).

Null html and url count as empty. Other columns are ignored. Archives are written through pyarrow's file systems under a
temporary name and then moved, so that a task that is run again replaces its own archives. Records of other writers may lack any
header: what isn't there is null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import fresh_path, skew_safe_lookup, table, written

#: Payloads below this size are always responses.
LEAST = 0
#: An archive is closed at this size.
ARCHIVE_BYTES = 64 << 20
LEVEL = 1
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_END, _READ = b"\r\n\r\n", 1 << 16


@dataclass
class Record:
    """A record; start and end are those of its member, or its own if it isn't compressed, in bytes of the archive."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int

    def get(self, name: str) -> str | None:
        """A header, whatever the case of its name."""
        return _header(self.headers, name)


@dataclass
class Gap:
    """Bytes [start, end) of an archive from which not everything could be read, and the first failed check.

    inner_start, inner_end: of what the member there holds, the bytes that are left out; without inner_end all the rest, and
    without both the member as a whole.
    """

    start: int
    end: int
    reason: str
    inner_start: int | None = None
    inner_end: int | None = None


class Damaged(ValueError):
    pass


def _header(headers: dict[str, str], name: str) -> str | None:
    return next((value for key, value in headers.items() if key.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record, uncompressed; the lengths and the block's digest are added."""
    headers = headers | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    head = "".join(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}\r\n" for name, value in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The response or revisit record of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return record_bytes(headers, http + payload)
    return record_bytes(headers | {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, http)


class _Blocks:
    """Reads some bytes at any place, from the last block that was read if they are there."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.base, self.data = file, 0, b""

    def at(self, place: int) -> bytes:
        if not self.base <= place < self.base + len(self.data):
            self.file.seek(place)
            self.base, self.data = place, self.file.read(16 * _READ)
        return self.data[place - self.base : place - self.base + _READ]


class _Stream:
    """Bytes that come one after the other; those from ``base`` on are held."""

    def __init__(self, more: Callable[[], bytes], base: int = 0) -> None:
        self.more, self.base, self.data, self.ended = more, base, bytearray(), False

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def upto(self, end: int) -> bool:
        """Whether there are bytes up to a place."""
        while self.end < end and not self.ended:
            new = self.more()
            self.ended = not new
            self.data += new
        return self.end >= end

    def part(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.base : end - self.base])

    def find(self, patterns: list[bytes], start: int, keep: bool = True) -> tuple[int, bytes] | None:
        """The first place of a pattern, and which. Unless ``keep``, what was searched is let go."""
        longest = max(map(len, patterns))
        while True:
            places = [(p, pattern) for pattern in patterns if (p := self.data.find(pattern, start - self.base)) >= 0]
            if places and (self.ended or min(places)[0] + longest <= len(self.data)):
                place, pattern = min(places)
                return self.base + place, pattern
            if self.ended:
                return None
            start = max(start, self.end - longest + 1)
            if not keep:
                self.drop(start)
            self.upto(self.end + 1)

    def drop(self, before: int) -> None:
        if before > self.base:
            del self.data[: before - self.base]
            self.base = before


def _parse(stream: _Stream, at: int, size: int | None = None) -> tuple[dict[str, str], bytes, int, bool]:
    """Headers, block and end of the record at a place, and whether a digest vouches for the block; size: of the whole, if it is known."""
    if not _VERSION_LINE.match(stream.part(at, at + 16)):
        raise Damaged("no version line")
    head = stream.find([_END, b"\r\n" + VERSION], at)
    if head is None or head[1] != _END:
        raise Damaged("headers do not end")
    lines = re.sub(r"\r\n[ \t]+", " ", stream.part(at, head[0]).decode("utf-8", "replace")).split("\r\n")[1:]
    headers = {name.strip(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
    length = _header(headers, "Content-Length") or ""
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    begin = head[0] + len(_END)
    end = begin + int(length)
    if size is not None and end + len(_END) > size or not stream.upto(end + len(_END)) or stream.part(end, end + len(_END)) != _END:
        raise Damaged("the block does not end where its length says")
    block, said = stream.part(begin, end), _sha1(headers, "WARC-Block-Digest")
    if said not in (None, digest(block)):
        raise Damaged("the block's digest differs")
    if (_header(headers, "WARC-Type") or "").lower() == "response" and (payload := _sha1(headers, "WARC-Payload-Digest")) not in (None, digest(block.partition(_END)[2])):
        raise Damaged("the payload's digest differs")
    return headers, block, end + len(_END), said is not None or payload_vouched(headers)


def payload_vouched(headers: dict[str, str]) -> bool:
    return (_header(headers, "WARC-Type") or "").lower() == "response" and _sha1(headers, "WARC-Payload-Digest") is not None


def _sha1(headers: dict[str, str], name: str) -> str | None:
    """A digest header in the form of digest(); none if there is none, or of another kind."""
    kind, _, value = (_header(headers, name) or "").rpartition(":")
    return value.upper() if kind.lower() in ("", "sha1") and re.fullmatch("[A-Za-z2-7]{32}", value) else None


class _Member:
    """The gzip member at a place, inflated as it is read; ``failure`` tells why it ended before its end."""

    def __init__(self, file: _Blocks, at: int) -> None:
        self.file, self.at, self.read, self.failure, self.waiting = file, at, 0, "", b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        while not self.inflate.eof and not self.failure:
            if not self.waiting:
                self.waiting = self.file.at(self.at + self.read)
                self.read += len(self.waiting)
                if not self.waiting:
                    self.failure = "the member is cut short"
                    return self.inflate.flush()
            before = self.inflate.copy()
            try:
                found = self.inflate.decompress(self.waiting, 16 * _READ)
                self.waiting = self.inflate.unconsumed_tail
            except zlib.error as error:
                self.failure, found = f"gzip: {error}", b""
                for k in range(len(self.waiting)):  # what comes before the bad byte
                    try:
                        found += before.decompress(self.waiting[k : k + 1])
                    except zlib.error:
                        break
            if found:
                return found
        return b""

    @property
    def end(self) -> int:
        return self.at + self.read - len(self.inflate.unused_data)

    def sound(self) -> bool:
        """Whether the member ends with the right checksum: it is read to its end once more."""
        again = _Member(self.file, self.at)
        while again.more():
            pass
        return not again.failure


def _of_member(file: _Blocks, at: int) -> Iterator[Record | Gap | _Member]:
    """What can be read from the member at a place, gaps between, and at the end the member itself.

    Records for which no digest vouches need a sound member.
    """
    member = _Member(file, at)
    stream, place, lost, reason, sound = _Stream(member.more), 0, None, "", None
    found: list[Record | Gap] = []
    while stream.upto(place + 1):
        try:
            headers, block, end, vouched = _parse(stream, place)
            if not vouched:
                sound = member.sound() if sound is None else sound
                if not sound:
                    raise Damaged("nothing vouches for the block in a damaged member")
        except Damaged as error:
            if lost is None:
                lost, reason = place, str(error)
            after = stream.find([VERSION], place + 1, keep=False)
            if after is None:
                break
            place = after[0]
            stream.drop(place)
            continue
        if lost is not None:
            found.append(Gap(at, -1, reason, lost, place))
            lost = None
        found.append(Record(headers, block, at, -1))
        place = end
        stream.drop(place)
        if member.inflate.eof or member.failure or len(found) > 1:  # else it is the member's only record, and its end is needed
            for x in found:
                x.end = member.end
                yield x
            found = []
    while stream.upto(stream.end + 1):
        stream.drop(stream.end)
    for x in found:
        x.end = member.end
        yield x
    if lost is not None and not member.failure:
        yield Gap(at, member.end, reason, lost, stream.end)
    elif not member.failure and stream.end == 0:
        member.failure = "the member is empty"
    member.left = place if lost is None else lost
    yield member


def salvage(file: BinaryIO, size: int) -> Iterator[Record | Gap]:
    """Every record of an archive that can be read, with a gap for each run of bytes from which something can't."""

    def reader(at: int) -> Callable[[], bytes]:
        def more() -> bytes:
            nonlocal at
            found = blocks.at(at)
            at += len(found)
            return found

        return more

    blocks, at, gap = _Blocks(file), 0, None
    while at < size:
        raw = _Stream(reader(at), at)
        first, end, failure, left = raw.part(at, at + len(VERSION)), None, "neither a member nor a version line", None
        if first.startswith(MEMBER):
            for found in _of_member(blocks, at):
                if isinstance(found, _Member):
                    failure, end, left = found.failure, found.end, found.left
                    break
                if gap is not None:
                    yield Gap(gap.start, at, gap.reason, gap.inner_start)
                    gap = None
                yield found
        elif first == VERSION:
            try:
                headers, block, end, _ = _parse(raw, at, size)
                failure = ""
                if gap is not None:
                    yield Gap(gap.start, at, gap.reason, gap.inner_start)
                    gap = None
                yield Record(headers, block, at, end)
            except Damaged as error:
                failure = str(error)
        if not failure:
            if gap is not None:  # a member of which nothing was kept, but that is sound
                yield Gap(gap.start, at, gap.reason, gap.inner_start)
                gap = None
            at = end
            continue
        gap = gap or Gap(at, -1, failure, left or None)
        after = _Stream(reader(at + 1), at + 1).find([MEMBER, VERSION], at + 1, keep=False)
        at = size if after is None else after[0]
    if gap is not None:
        yield Gap(gap.start, size, gap.reason, gap.inner_start)


@dataclass
class _Archive:
    """An archive that is being written; it gets its name when it is closed."""

    files: fs.FileSystem
    path: str
    size: int = 0
    records: int = 0
    stream: object = field(default=None)

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
            self.stream = self.files.open_output_stream(self.draft, compression=None)
        self.stream.write(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.draft, self.path)


def refer(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to): which page each page revisits, if any."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    firsts = pages.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    return skew_safe_lookup(pages, firsts, "key", "pages", F.col("page_id")).select(
        "page_id", "url", "payload",
        F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; (archive, bytes, records) of each."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, done, archive = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                archive = archive or _Archive(files, f"{root}/part-{part:05d}-{len(done):04d}.warc.gz")
                archive.write(member(page_record(page_id, url, payload, refers_to, date)))
                if archive.size >= archive_bytes:
                    archive.close()
                    done, archive = [*done, archive], None
        if archive:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.path.rpartition('/')[2]}" for x in done], pa.string()), pa.array([x.size for x in done], pa.int64()), pa.array([x.records for x in done], pa.int64())], names=["archive", "bytes", "records"])

    return written(refer(pages, least).mapInArrow(batches, "archive string, bytes long, records long"), "warc-archives")


def _salvaged(archives: DataFrame, schema: str, row) -> DataFrame:
    """A row for each record and gap of each archive, as ``row`` makes it; archives: (archive, ...)."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(archive)
                rows, held = [], 0
                with files.open_input_file(path) as file:
                    for found in salvage(file, file.size()):
                        rows.append(row(archive, found))
                        held += len(getattr(found, "block", b"")) if pa.binary() in kinds else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # An archive for each task, however small the list of them is.
    count = max(1, archives.count())
    return archives.select("archive").repartition(min(count, 10_000)).mapInArrow(batches, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record (type, headers as JSON-like text, block) and gap of the archives."""

    def row(archive: str, found: Record | Gap) -> tuple:
        if isinstance(found, Gap):
            return archive, found.start, found.end, found.inner_start, found.inner_end, None, found.reason, None
        return archive, found.start, found.end, None, None, found.get("WARC-Type"), "".join(f"{k}: {v}\n" for k, v in found.headers.items()), found.block

    return _salvaged(archives, "archive string, start long, end long, inner_start long, inner_end long, record_type string, headers string, block binary", row)


def read_pages(archives: DataFrame) -> DataFrame:
    """(archive, start, end, inner_start, inner_end, page_id, payload_bytes, payload_digest, record_type, refers_to, gap): read and digested in one pass.

    Rows with a reason in ``gap`` are quarantined byte ranges.
    """

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def row(archive: str, found: Record | Gap) -> tuple:
        if isinstance(found, Gap):
            return archive, found.start, found.end, found.inner_start, found.inner_end, *[None] * 5, found.reason
        http, _, payload = found.block.partition(_END)
        kind, said = (found.get("WARC-Type") or "").lower() or None, _sha1(found.headers, "WARC-Payload-Digest")
        if kind == "revisit":
            length = re.search(rb"\r\nContent-Length:\s*(\d+)", http, re.I)
            size = int(length[1]) if length else None
        else:
            payload = payload if kind == "response" else found.block
            size, said = len(payload), digest(payload)
        return archive, found.start, found.end, None, None, number(found.get("WARC-Record-ID")), size, said, kind, number(found.get("WARC-Refers-To")), None

    return _salvaged(archives, "archive string, start long, end long, inner_start long, inner_end long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string", row)


def quarantine(found: DataFrame) -> DataFrame:
    """The log of byte ranges that were left out, of rows of read_pages: written to the shared folder."""
    return written(found.where(F.col("gap").isNotNull()).select("archive", "start", "end", "inner_start", "inner_end", "gap"), "warc-quarantine")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    found = written(read_pages(archives), "warc-found")
    quarantine(found)
    return found.where(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""
