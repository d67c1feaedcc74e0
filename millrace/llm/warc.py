"""WARC archives of web pages: writing with revisit records, and reading that survives damage.

The reader checks every record: a gzip member must unpack with its checksum, and the record must have a version
line, headers, a block of the announced length and the announced digests. Where a check fails it looks for the next member
or version line that passes all of them, goes on from there, and logs the bytes in between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .common import portions, stage

REVISIT_FROM = 1000  # bytes of payload from which an equal payload is not stored again
SEGMENT = 8 << 20  # bytes of archive that one task reads
MOST_TASKS = 20_000  # beyond, a task reads several parts
READ, UNPACKED = 1 << 16, 1 << 20  # bytes at once, of a file and of what a member unpacks to
BLOCK = 1 << 30  # bytes of the longest block that is held; longer ones are checked as they pass
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
MANDATORY = {"warc-record-id": "no record id", "warc-type": "no record type", "warc-date": "no date"}  # and the length
REPEATABLE = ("warc-concurrent-to",)  # the one name that a record may have more than once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


class Damaged(Exception):
    """A check that failed; its text is the reason that is logged."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None = None  # null where it is not asked for, or too long to be held
    payload_bytes: int | None = None
    checked: bool = False  # whether the block was compared with a digest
    http: dict[str, str] = field(default_factory=dict)


# -- one record ---------------------------------------------------------------------------------------


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1"]
    lines += [f"{k}: {v}".encode() for k, v in headers.items()]
    lines += [b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode()]
    lines += [f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit of the response of page ``first`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    if first is not None:
        headers |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": PROFILE}
    return encode_record(headers, http.encode() + (payload if first is None else b""))


def _headers(raw: bytes, strict: bool = True) -> dict[str, str]:
    """Names and values of header lines; a line that begins with a blank goes on with the one before.

    A line without a colon and a name that comes twice are damage (``strict``). Servers send both, and a sound record holds
    what they sent: there such a line is left out, and values of one name are joined.
    """
    found: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key, text = (x.decode("utf-8", "replace").strip() for x in (name.lower(), value))
        if not colon:
            if strict:
                raise Damaged("header line without a colon")
        elif key not in found:
            found[key] = text
        elif strict and key not in REPEATABLE:
            raise Damaged("header named twice")
        else:
            found[key] += ", " + text
    return found


def _hexadecimal(value: str) -> str:
    """A sha1 digest in hexadecimal, also if it was announced in base32; anything else as it is, in small letters."""
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value.lower()


def _check_digest(announced: str | None, found: str, what: str) -> bool:
    """Compare a sha1 digest of the length of hexadecimal or base32 digits; others cannot be checked: false."""
    kind, _, value = (announced or "").partition(":")
    if kind.strip().lower() != "sha1" or len(value.strip()) not in (32, 40):
        return False
    if _hexadecimal(value.strip()) != found:
        raise Damaged(f"{what} digest differs")
    return True


class Flow:
    """Bytes that come in chunks and are taken from the front; ``total`` is how many there are, where that is known."""

    def __init__(self, chunks: Iterator[bytes], total: int | None = None) -> None:
        self.chunks, self.total, self.held, self.taken = chunks, total, bytearray(), 0

    def fill(self, size: int) -> bool:
        """Hold at least ``size`` bytes, if so many come."""
        while len(self.held) < size:
            if not (chunk := next(self.chunks, b"")):
                return False
            self.held += chunk
        return True

    def take(self, size: int) -> bytes:
        self.fill(size)
        part = bytes(self.held[:size])
        del self.held[:size]
        self.taken += len(part)
        return part


def _head(flow: Flow) -> bytes:
    """Header lines of a record up to the blank line, however far it is; lines are checked as they come."""
    flow.fill(10)
    if not re.match(rb"WARC/1\.\d\r\n", flow.held):
        raise Damaged("no version line")
    searched, checked = 0, 10
    while (end := flow.held.find(b"\r\n\r\n", searched)) < 0:
        searched, last = max(len(flow.held) - 3, 0), flow.held.rfind(b"\r\n")
        if last > checked:
            if any(b":" not in line and line[:1] not in b" \t" for line in flow.held[checked:last].split(b"\r\n")):
                raise Damaged("header line without a colon")
            checked = last + 2
        if not flow.fill(len(flow.held) + 1):
            raise Damaged("headers without an end")
    return flow.take(end + 4)[10:end]


def decode_record(flow: Flow, keep: bool = True) -> Record:
    """The record at the front of ``flow``, which is taken from it, or ``Damaged``; ``keep`` holds its payload."""
    headers = _headers(_head(flow))
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("no usable length")
    for name, reason in MANDATORY.items():
        if not headers.get(name):
            raise Damaged(reason)
    left = size = int(length)
    if flow.total is not None and flow.taken + size + 4 > flow.total:
        raise Damaged("cut short")
    looking = headers.get("content-type", "").startswith("application/http")
    response = headers["warc-type"] == "response"
    parts, front, split, payload_bytes = [], bytearray(), False, 0
    keep = keep and response and size <= BLOCK
    whole, of_payload = hashlib.sha1(), hashlib.sha1()
    while left:
        part = flow.take(min(left, UNPACKED))
        if not part:
            raise Damaged("cut short")
        left -= len(part)
        whole.update(part)
        if looking:  # the captured headers, up to their blank line
            searched = max(len(front) - 3, 0)
            front += part
            at = front.find(b"\r\n\r\n", searched)
            if at < 0:
                if len(front) > BLOCK:  # no captured headers: nothing but the block's digest can be checked
                    looking, front = False, bytearray()
                continue
            looking, split, part = False, True, bytes(front[at + 4 :])
            del front[at:]
        if split:
            of_payload.update(part)
            payload_bytes += len(part)
            if keep:
                parts.append(part)
    end = flow.take(4)
    if len(end) < 4:
        raise Damaged("cut short")
    if end != b"\r\n\r\n":
        raise Damaged("block and length disagree")
    record = Record(headers, checked=_check_digest(headers.get("warc-block-digest"), whole.hexdigest(), "block"))
    if split:
        record.http = _headers(front.partition(b"\r\n")[2], strict=False)
        if response:
            record.payload = b"".join(parts) if keep else None
            record.payload_bytes = payload_bytes
            record.checked |= _check_digest(headers.get("warc-payload-digest"), of_payload.hexdigest(), "payload")
    return record


# -- an archive or a part of one ---------------------------------------------------------------------


class Span:
    """Bytes ``start`` to ``end`` of a file, read on demand; positions are those of the file."""

    def __init__(self, file: pa.NativeFile, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, min(end, file.size())
        self.at, self.held = start, b""

    def read(self, start: int, size: int) -> bytes:
        size = min(size, self.end - start)
        if size <= 0:
            return b""
        if start < self.at or start + size > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(min(max(size, 4 * READ), self.end - start))
        return self.held[start - self.at : start - self.at + size]

    def find(self, mark: bytes, start: int) -> int:
        """The next place of ``mark`` from ``start`` on, or the end."""
        while start < self.end:
            part = self.read(start, READ)
            found = part.find(mark)
            if found >= 0:
                return start + found
            if len(part) < len(mark) or start + len(part) >= self.end:
                break
            start += len(part) - len(mark) + 1
        return self.end


def _plain(span: Span, at: int) -> Iterator[bytes]:
    while part := span.read(at, READ):
        yield part
        at += len(part)


def _member(span: Span, at: int, ends: list[int]) -> Iterator[bytes]:
    """The contents of the gzip member at ``at``, in chunks of bounded size; its end is added to ``ends``."""
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        part = span.read(at, READ)
        if not part:
            raise Damaged("member cut short")
        at += len(part)
        while part and not inflate.eof:
            try:
                chunk = inflate.decompress(part, UNPACKED)
            except zlib.error as error:
                raise Damaged("member does not unpack") from error
            part = inflate.unconsumed_tail
            if chunk:
                yield chunk
    ends.append(at - len(inflate.unused_data))


def _record_at(span: Span, start: int, keep: bool) -> tuple[Record, int]:
    if span.read(start, 3) == MAGIC:
        ends: list[int] = []
        flow = Flow(_member(span, start, ends))
        record = decode_record(flow, keep)
        if flow.fill(1):
            raise Damaged("more than a record in a member")
        return record, ends[0]
    flow = Flow(_plain(span, start), span.end - start)
    record = decode_record(flow, keep)
    return record, start + flow.taken


def _candidates(span: Span, start: int) -> Iterator[int]:
    """Places from ``start`` on where a member or a version line may begin, in order."""
    member, line = span.find(MAGIC, start), span.find(VERSION, start)
    while min(member, line) < span.end:
        if member < line:
            yield member
            member = span.find(MAGIC, member + 1)
        else:
            yield line
            line = span.find(VERSION, line + 1)


def salvage(span: Span, keep: bool = True) -> Iterator[tuple[int, int, Record | None, str | None]]:
    """``(offset, length, record, None)`` for records, ``(offset, length, None, reason)`` for quarantined gaps.

    Payloads are held only if ``keep`` is set; they are checked all the same.
    """
    at = span.start
    while at < span.end:
        try:
            record, end = _record_at(span, at, keep)
        except Damaged as damage:
            resumed = span.end
            for place in _candidates(span, at + 1):
                try:
                    record, end = _record_at(span, place, keep)
                except Damaged:
                    continue
                resumed = place
                break
            yield at, resumed - at, None, str(damage)
            if resumed >= span.end:
                return
            at = resumed
        yield at, end - at, record, None
        at = end


# -- tables ----------------------------------------------------------------------------------------


def with_first(pages: DataFrame, id: str, payload: Column) -> DataFrame:
    """Add ``_payload``, ``_digest`` and ``_first``: the page a revisit refers to, null for responses.

    Of pages with equal payloads of at least ``REVISIT_FROM`` bytes, the one with the largest id is the response;
    rows that share that id are all responses. Pages without an id refer to it too.
    """
    known = pages.withColumn("_payload", F.coalesce(payload.cast("binary"), F.lit(b""))).withColumn(
        "_digest", F.sha1("_payload")
    )
    large = F.octet_length("_payload") >= REVISIT_FROM
    last = (
        known.filter(large)
        .groupBy(F.col("_digest").alias("_same"))
        .agg(F.max(id).alias("_last"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1 AND _last IS NOT NULL")
    )
    revisit = large & ~F.col(id).eqNullSafe(F.col("_last"))
    return known.join(last, F.col("_digest") == F.col("_same"), "left").withColumn(
        "_first", F.when(F.col("_last").isNotNull() & revisit, F.col("_last"))
    )


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one gzip member per row into archives in the shared folder; return ``(path, start, end)`` of their parts.

    The returned table is written once and lists only files of tasks that succeeded: a task that is run again writes
    under another name. A null page is an empty payload, a null url leaves its header out.
    """
    narrow = pages.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"),
    )
    rows = with_first(narrow, "id", F.col("html")).select("id", "url", "_payload", "_digest", "_first")
    folder = shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        path, stream, at, started = f"{place}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        parts = []
        for batch in portions(batches):
            for page, link, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    system.create_dir(place, recursive=True)
                    stream = system.open_output_stream(path, compression=None)  # members are packed already
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(page_record(page, link, payload, digest, first)) + pack.flush()
                stream.write(member)
                at += len(member)
                if at - started >= SEGMENT:
                    parts.append((started, at))
                    started = at
        if stream is not None:
            stream.close()
            parts += [(started, at)] if at > started else []
            full = folder.rstrip("/") + "/" + path.rpartition("/")[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([full] * len(parts)), *(pa.array(list(x)) for x in zip(*parts, strict=True))],
                names=["path", "start", "end"],
            )

    return stage(rows.mapInArrow(run, "path string, start long, end long"), "parts")


def read_archives(parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of archive parts ``(path, start, end)``; ``end`` may be null for a whole file.

    Columns: ``path``, ``offset``, ``length``, ``reason`` (of a gap; null for records), ``record_id``, ``url``,
    ``record_type``, ``refers_to``, ``payload_digest`` and ``payload_bytes`` (both of the full payload, also for revisits),
    ``checked`` (false for a record that announces no digest which can be compared, so that damage of its block can pass in
    a plain archive), ``payload``. A record without an id, type, date or length is damaged. A part must start where a record starts; archives may be compressed by member or plain. A block of any length
    is checked; of one above ``BLOCK`` the payload is not returned, as a row could not hold it: ``payload_bytes`` is greater then.
    """
    columns = (
        "path string, offset long, length long, reason string, record_id string, url string, record_type string, "
        "refers_to string, payload_digest string, payload_bytes long, checked boolean, payload binary"
    )
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(data, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    span = Span(file, start or 0, file.size() if end is None else end)
                    missing = [] if end is None or end <= span.end else [(span.end, end - span.end, None, "file cut short")]
                    for offset, length, record, reason in chain(salvage(span, with_payload), missing):
                        rows.append((path, offset, length, reason, *_shown(record)))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or held > SEGMENT:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    # a few bytes per row stand for megabytes of archive: a number of its own keeps Spark from merging these partitions
    tasks = max(1, min(parts.count(), MOST_TASKS))
    spread = parts.select("path", "start", "end").repartition(tasks, "path", "start")
    return spread.mapInArrow(run, columns)


def _shown(record: Record | None) -> tuple:
    if record is None:
        return (None,) * 8
    h = record.headers
    kind, _, digest = h.get("warc-payload-digest", "").partition(":")
    digest = (_hexadecimal(digest.strip()) if kind.strip().lower() == "sha1" else digest.lower()) or None
    size = record.http.get("content-length", "") if record.payload_bytes is None else record.payload_bytes
    size = int(size) if re.fullmatch("[0-9]{1,18}", str(size)) else None
    names = (h.get(n) for n in ("warc-record-id", "warc-target-uri", "warc-type", "warc-refers-to"))
    return *names, digest, size, record.checked, record.payload


def page_of(record_id: Column) -> Column:
    """The page id inside a record id; null where a page has none."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
