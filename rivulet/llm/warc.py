"""WARC archives: a writer with revisit records, and a reader that salvages.

Archives are files of gzip members, one record each, in a shared folder: a
local path, or any other that pyarrow can open. A task that runs again writes
new files; only files that a finished task reports are read.

The reader checks each member (gzip's own checks), the version line, headers,
block length and payload digest, and goes by declared lengths: what a sound
record's payload holds is never searched. Where a check fails it looks for the
next member that opens with a version line (or, inside a member or a plain
archive, for the next version line), goes on from there, and reports the bytes
between as a gap with a reason. That holds for members and headers of any size:
members of more than ``HELD_BYTES`` unpacked are unpacked a second time while
they are read, a piece at a time, and payloads above it come in pieces. A member
whose gzip checks fail is one gap, as nothing vouches for its headers then.

A null payload is empty, a null url gives no target header, a null id no record
id. Of equal payloads of min_bytes or more, rows of the largest id (nulls are
least) are responses and the others revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import mmap
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

ROLL_BYTES = 32 << 20
HELD_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
LOOK_BACK = 100  # bytes of the piece before that a search sees again
LEAST = -(2**63)
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
GZIP = b"\x1f\x8b\x08"
LINE = re.compile(rb"\nWARC/\d+\.\d+\r?\n")
LENGTH = re.compile(rb"(?i)\r\ncontent-length: *(\d{1,18})(?=\D)")


@contextmanager
def opened(path: str, mode: str):
    """A file to write, or the bytes of one to read."""
    local = path.removeprefix("file://") if path.startswith(("file://", "/")) else path.removeprefix("file:") if path.startswith("file:") else None
    if local is not None:
        if mode == "w":
            import os

            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local, "wb") as f:
                yield f
        else:
            with open(local, "rb") as f:
                if f.seek(0, io.SEEK_END) == 0:
                    yield b""
                else:
                    with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
                        yield view
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        if mode == "w":
            with store.open_output_stream(inner) as f:
                yield f
        else:
            with store.open_input_stream(inner) as f:
                yield f.read()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    digest = digest_of(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    lines.append(f"WARC-Date: {date}")
    if clean:
        lines.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Held:
    """Bytes at hand, read by offset."""

    def __init__(self, data):
        self.data, self.size = data, len(data)

    def piece(self, at: int) -> bytes:
        """Bytes from at on, at least one and at most 1 MB; none behind the end."""
        return bytes(self.data[at : at + PIECE_BYTES])

    def keep(self, at: int) -> None:
        """Bytes before at won't be read again."""


class Unpacked(Held):
    """What a sound member unpacks to, read by offset; one piece is held. To read again before it, unpacking goes back to a copy of its state at the last place to keep."""

    def __init__(self, data, at: int, size: int):
        self.data, self.size = data, size
        self.last = self.mark = (zlib.decompressobj(31), at, b"", 0)
        self._back(self.mark)

    def _back(self, state: tuple) -> None:
        inflate, self.pos, self.left, self.base = state
        self.inflate, self.held = inflate.copy(), b""

    def _more(self) -> None:
        self.base += len(self.held)
        self.last = (self.inflate.copy(), self.pos, self.left, self.base)
        self.held = b""
        while not self.held and not self.inflate.eof:
            if not self.left:
                self.left = bytes(self.data[self.pos : self.pos + (1 << 18)])
                self.pos += len(self.left)
            self.held = self.inflate.decompress(self.left, PIECE_BYTES)
            self.left = self.inflate.unconsumed_tail

    def piece(self, at: int) -> bytes:
        if at < self.base:
            self._back(self.mark)
        while at >= self.base + len(self.held) and at < self.size:
            self._more()
        return self.held[at - self.base :]

    def keep(self, at: int) -> None:
        if self.last[3] <= at:
            self.mark = self.last


def between(source: Held, at: int, stop: int) -> Iterator[bytes]:
    while at < stop and (piece := source.piece(at)[: stop - at]):
        yield piece
        at += len(piece)


class Salvage:
    """records() gives (offset, headers, payload or None, payload length, payload digest) of all sound records.

    gaps collects (first, end, reason) in bytes of the archive, and inside, for
    each gap, (first, end) in the unpacked bytes of its member, or None. Payloads
    of blocks above ``most`` aren't held: pieces() gives that of the record that
    came last. ``inner`` is that record's place in its member, None outside one.
    """

    def __init__(self, data, most: int = HELD_BYTES):
        self.data, self.most = data, most
        self.gaps: list[tuple[int, int, str]] = []
        self.inside: list[tuple[int, int] | None] = []
        self.inner: int | None = None
        self._payload: tuple = (Held(b""), 0, 0)

    def records(self) -> Iterator[tuple]:
        n, at, plain = len(self.data), 0, Held(self.data)
        while at < n:
            if self.data[at : at + 3] == GZIP:
                source, end, why = self._member(at)
                if why:
                    end = self._next(at + 1)
                    self._gap(at, end, why)
                else:
                    yield from self._inside(source, at, end)
                at = end
            elif VERSION.match(self.data[at : at + 20]):
                found, end, why = self._record(plain, at)
                if why:
                    end = self._next(at + 1)
                    self._gap(at, end, why)
                else:
                    self.inner = None
                    yield at, *found
                at = end
            else:
                line = self._next(at)
                self._gap(at, line, "no member or version line")
                at = line

    def pieces(self) -> Iterator[bytes]:
        """The payload of the record that records() gave last, in pieces of at most 1 MB; its digest has been checked."""
        return between(*self._payload)

    def _gap(self, first: int, end: int, why: str, inside: tuple[int, int] | None = None) -> None:
        self.gaps.append((first, end, why))
        self.inside.append(inside)

    def _member(self, at: int) -> tuple[Held | None, int, str]:
        """What the member at this place unpacks to, after gzip's own checks; above most it isn't held, but unpacked again while it is read."""
        inflate, pos, left = zlib.decompressobj(31), at, b""
        out, size = [], 0
        while not inflate.eof:
            if not left:
                left = bytes(self.data[pos : pos + (1 << 18)])
                pos += len(left)
                if not left:
                    return None, pos, "truncated member"
            try:
                piece = inflate.decompress(left, PIECE_BYTES)
            except zlib.error as e:
                return None, pos, f"damaged member: {e}"
            left = inflate.unconsumed_tail
            size += len(piece)
            if size <= self.most:
                out.append(piece)
            else:
                out.clear()
        end = pos - len(inflate.unused_data)
        return Held(b"".join(out)) if size <= self.most else Unpacked(self.data, at, size), end, ""

    def _opens(self, at: int) -> bool:
        try:
            return VERSION.match(zlib.decompressobj(31).decompress(self.data[at : at + 4096], 64)) is not None
        except zlib.error:
            return False

    def _next_member(self, at: int) -> int:
        while (at := self.data.find(GZIP, at)) >= 0:
            if self._opens(at):
                return at
            at += 1
        return len(self.data)

    def _next(self, at: int) -> int:
        """The next member, or version line at the start of a line."""
        end = self._next_member(at)
        found = at
        while 0 <= (found := self.data.find(b"WARC/", found)) < end:
            if VERSION.match(self.data[found : found + 20]) and (found == 0 or self.data[found - 1 : found] == b"\n"):
                return found
            found += 1
        return end

    def _record(self, source: Held, at: int) -> tuple[tuple, int, str]:
        """((headers, payload, its length, its digest), end, why) of the record at a version line; why is empty if all checks hold."""
        headers, start, why = self._headers(source, at)
        if why:
            return (), at, why
        stop = start + int(headers["content-length"])
        if stop > source.size:
            return (), at, "block is cut short"
        wraps, revisit = "msgtype=response" in headers.get("content-type", ""), headers.get("warc-type") == "revisit"
        block, payload, cut = hashlib.sha1(), None, start
        length, seen, pos = None, b"", start
        held: list[bytes] | None = [] if stop - start <= self.most else None
        for piece in between(source, start, stop):
            if held is not None:
                held.append(piece)
            if payload is not None:
                payload.update(piece)
            elif wraps:
                look = seen + piece
                end = look.find(b"\r\n\r\n", max(0, len(seen) - 3))
                if revisit and length is None and (m := LENGTH.search(look[: end + 2] if end >= 0 else look)):
                    length = int(m[1])
                if end >= 0:
                    cut = pos - len(seen) + end + 4
                    payload = hashlib.sha1(piece[cut - pos :])
                seen = look[-LOOK_BACK:]
            if payload is None:
                block.update(piece)
            pos += len(piece)
        if payload is None or length is None:
            length = stop - cut
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = stated if stated and revisit else base64.b32encode((payload or block).digest()).decode()
        if stated and stated != digest:
            return (), at, "payload digest differs"
        if b"".join(between(source, stop, stop + 4)) not in (b"\r\n\r\n", b""):
            return (), at, "no end of record"
        self._payload = (source, cut, stop)
        return (headers, None if held is None else b"".join(held)[cut - start :], length, digest), stop + 4, ""

    def _inside(self, source: Held, base: int, end: int) -> Iterator[tuple]:
        """Records of a member. After a failed check reading goes on at the next version line in it; that gap, too, is in bytes of the archive those of the member."""
        at = 0
        while at < source.size:
            source.keep(at)
            found, follow, why = self._record(source, at)
            if why:
                follow = self._line(source, at + 1)
                self._gap(base, end, why, (at, follow))
            else:
                self.inner = at
                yield base, *found
            at = follow

    @staticmethod
    def _line(source: Held, at: int) -> int:
        """The next version line at the start of a line, from at (1 or more) on."""
        pos, seen = at - 1, b""
        while piece := source.piece(pos):
            look = seen + piece
            if m := LINE.search(look):
                return pos - len(seen) + m.start() + 1
            pos += len(piece)
            seen = look[-LOOK_BACK:]
        return source.size

    @staticmethod
    def _headers(source: Held, at: int) -> tuple[dict[str, str], int, str]:
        """Headers of any length, as long as each line is a header line."""
        size = 1 << 12
        while True:
            head = b"".join(between(source, at, at + size))
            if not VERSION.match(head[:20]):
                return {}, at, "no version line"
            end = head.find(b"\r\n\r\n")
            if end >= 0 or at + len(head) >= source.size:
                break
            lines = head.split(b"\r\n")[1:]
            if any(b":" not in line for line in lines[:-1]) or (lines and len(lines[-1]) > 1 << 12 and b":" not in lines[-1]):
                return {}, at, "bad header line"
            size *= 4
        if end < 0:
            return {}, at, "no end of headers"
        headers = {}
        for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                return {}, at, "bad header line"
            headers[name.strip().lower()] = value.strip()
        if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
            return {}, at, "no block length"
        return headers, at + end + 4, ""


def archived(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages and returns (path, records) of the archives.

    Digests are grouped before any payload moves, and payloads are joined by id,
    so copies of one page don't meet in a task.
    """
    spark = pages.sparkSession
    small_batches(spark, 200)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    where = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    digests = rows.filter(F.length("payload") >= min_bytes).select("id", F.sha1("payload").alias("digest"))
    kept = digests.groupBy("digest").agg(F.max("id").alias("first"), F.min("id").alias("last")).filter("first <> last").select("digest", "first")
    revisits = stored(digests.join(kept, "digest").filter("id <> first").distinct(), "revisits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        buffer, count = io.BytesIO(), 0

        def roll() -> None:
            nonlocal buffer, count
            if count:
                path = f"{where}/{uuid.uuid4().hex}.warc.gz"
                with opened(path, "w") as f:
                    f.write(buffer.getvalue())
                done.append((path, count))
            buffer, count = io.BytesIO(), 0

        for batch in batches:
            for page, link, data, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                page, first = page.as_py(), first.as_py()
                buffer.write(member(record(None if page == LEAST else page, link.as_py(), data.as_py(), first)))
                count += 1
                if buffer.tell() >= ROLL_BYTES:
                    roll()
        roll()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    joined = rows.withColumn("digest", F.sha1("payload")).join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "first")
    return stored(joined.mapInArrow(work, "path string, records long"), "archives")


def salvaged(archives: DataFrame, payloads: bool = False, most: int = HELD_BYTES) -> DataFrame:
    """Everything in archives (path): a row for each sound record and for each gap (kind).

    page_id, uri, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for; a gap has first, end and reason instead.
    inner and inner_end are places in the unpacked bytes of a member. The payload of a block above most bytes comes as
    rows of the kind piece, numbered from 0, with the record's path, first and inner.
    """
    made = "kind string, path string, first long, end long, reason string, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, inner long, inner_end long, piece long"
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kind = pa.schema([(name, types[t]) for name, t in (c.split(" ") for c in made.split(", "))])

    def number(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    def rows(path: str, reader: Salvage) -> Iterator[dict]:
        for at, headers, payload, length, digest in reader.records():
            here = {"path": path, "first": at, "inner": reader.inner}
            yield here | {"kind": "record", "page_id": number(headers.get("warc-record-id")), "uri": headers.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": headers.get("warc-type"), "refers_to": number(headers.get("warc-refers-to")), "payload": payload if payloads else None}
            if payloads and payload is None:
                for k, piece in enumerate(reader.pieces()):
                    yield here | {"kind": "piece", "piece": k, "payload": piece}
        for (first, end, why), place in zip(reader.gaps, reader.inside, strict=True):
            yield {"kind": "gap", "path": path, "first": first, "end": end, "reason": why, "inner": place and place[0], "inner_end": place and place[1]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path, "r") as data:
                    out, size = [], 0
                    for row in rows(path, Salvage(data, most)):
                        out.append(row)
                        size += len(row.get("payload") or b"")
                        if len(out) >= 500 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, kind)
                            out, size = [], 0
                    yield pa.RecordBatch.from_pylist(out, kind)

    return archives.select("path").mapInArrow(work, made)
