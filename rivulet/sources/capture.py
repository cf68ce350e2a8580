"""Packet captures: classic pcap files as flow records, IPv4 and IPv6, in byte ranges.

A file has no index, so a task that begins in the middle has to find where a packet
begins: the first place from which several headers in a row are plausible (lengths
within bounds, fractions of a second, times near the first packet's) or lead exactly
to the file's end. A task reads the packets that begin in its range, so files of any
size are many tasks' work, and every packet is read once. The same search goes on
behind a damaged header; what is skipped is a gap, with its place and reason.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import Range, Reader, ranges

SCHEMA = "ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, pkt_len int, tcp_flags int"
GAPS = "path string, begin long, length long, reason string"
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMP"}
#: Byte order and units a second of each magic number. Fixed values.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
#: Header bytes before the network layer by link type, Ethernet apart. Fixed values.
RAW_LINKS = {0: 4, 12: 0, 101: 0, 113: 16, 228: 0, 229: 0}
#: IPv6 headers that another follows: hop-by-hop, routing, fragment, authentication, destination. Fixed values.
EXTENSIONS = {0, 43, 44, 51, 60}
LONGEST = 1 << 18
IN_A_ROW = 6
NEAR_S = 400 * 86_400


class Capture:
    """Packets of one file by position."""

    def __init__(self, path: str, size: int):
        self.reader = Reader(path, size)
        self.size, head = size, self.reader.get(0, 40)
        self.known = len(head) >= 24 and head[:4] in MAGIC
        if self.known:
            self.order, self.unit = MAGIC[head[:4]]
            self.link = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF
            self.longest = max(struct.unpack(self.order + "I", head[16:20])[0], 1) if struct.unpack(self.order + "I", head[16:20])[0] <= LONGEST else LONGEST
            self.first = struct.unpack(self.order + "I", head[24:28])[0] if len(head) >= 40 else None

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """(seconds, fraction, bytes held, bytes on the wire) of a plausible header."""
        raw = self.reader.get(at, 16)
        if len(raw) < 16:
            return None
        sec, part, held, full = struct.unpack(self.order + "4I", raw)
        if part >= self.unit or held > self.longest or held > full or full > LONGEST or at + 16 + held > self.size:
            return None
        return sec, part, held, full

    def plausible(self, at: int) -> bool:
        """Whether packets begin at a place: several headers in a row near each other in time, or as many as lead to the end."""
        time = None
        for _ in range(IN_A_ROW):
            if at == self.size and time is not None:
                return True
            found = self.header(at)
            if found is None or time is not None and abs(found[0] - time) > NEAR_S:
                return False
            if time is None and self.first is not None and abs(found[0] - self.first) > NEAR_S:
                return False
            time, at = found[0], at + 16 + found[2]
        return True

    def next(self, at: int, stop: int) -> int | None:
        """The first place from at, before stop, at which packets begin."""
        while at < stop:
            if self.plausible(at):
                return at
            at += 1
        return None

    def packets(self, begin: int, end: int) -> Iterator[tuple[int, tuple, bytes] | tuple[int, int, str]]:
        """(place, header, frame) of packets that begin in the range, and (place, length, reason) of gaps in between."""
        at = 24 if begin <= 24 else self.next(begin, end)
        if begin <= 24 < end and self.size > 24 and self.header(24) is None:
            at = self._behind(24, end)
            yield 24, (end if at is None else at) - 24, "damaged header"
        while at is not None and at < end and at < self.size:
            found = self.header(at)
            if found is None:
                following = self._behind(at, end)
                yield at, (end if following is None else following) - at, "cut off" if self.size - at < LONGEST and following is None and end == self.size else "damaged header"
                at = following
                continue
            yield at, found, self.reader.get(at + 16, found[2])
            at += 16 + found[2]

    def _behind(self, at: int, end: int) -> int | None:
        return self.next(at + 1, end)


def layers(frame: bytes, link: int) -> tuple[str, str, int, bytes] | None:
    """(source, destination, protocol, payload) of an IP packet; None for others."""
    if link == 1:
        skip, kind = 14, frame[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):  # tags of virtual networks
            skip, kind = skip + 4, frame[skip + 2 : skip + 4]
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return None
    elif link in RAW_LINKS:
        skip = RAW_LINKS[link]
    else:
        return None
    ip = frame[skip:]
    if len(ip) >= 20 and ip[0] >> 4 == 4:
        payload = b"" if struct.unpack(">H", ip[6:8])[0] & 0x1FFF else ip[(ip[0] & 15) * 4 :]  # later fragments have no ports
        return socket.inet_ntoa(ip[12:16]), socket.inet_ntoa(ip[16:20]), ip[9], payload
    if len(ip) >= 40 and ip[0] >> 4 == 6:
        follows, body = ip[6], ip[40:]
        while follows in EXTENSIONS and len(body) >= 8:
            later = follows == 44 and struct.unpack(">H", body[2:4])[0] >> 3
            size = 8 if follows == 44 else (body[1] + 2) * 4 if follows == 51 else (body[1] + 1) * 8
            follows, body = body[0], b"" if later else body[size:]
        return socket.inet_ntop(socket.AF_INET6, ip[8:24]), socket.inet_ntop(socket.AF_INET6, ip[24:40]), follows, body
    return None


def record(header: tuple[int, int, int, int], frame: bytes, link: int, unit: int) -> tuple | None:
    found = layers(frame, link)
    if found is None:
        return None
    source, target, proto, body = found
    ports = struct.unpack(">HH", body[:4]) if proto in (6, 17) and len(body) >= 4 else (0, 0)
    flags = body[13] if proto == 6 and len(body) >= 14 else 0
    return header[0] + header[1] / unit, source, target, ports[0], ports[1], PROTOCOLS.get(proto, "OTHER"), header[3], flags


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length, self.parts = options["path"], int(options.get("range_bytes", 1 << 27)), int(options.get("parts", 0))
        self.gaps = options.get("what", "packets") == "gaps"

    def partitions(self) -> list[InputPartition]:
        return ranges(self.path, self.length, self.parts)

    def read(self, partition: Range) -> Iterator[tuple]:
        capture = Capture(partition.path, partition.size)
        try:
            if not capture.known:
                if self.gaps and partition.begin == 0 and partition.size:
                    yield partition.path, 0, partition.size, "no capture"
                return
            for found in capture.packets(partition.begin, partition.end):
                if isinstance(found[2], str):
                    if self.gaps:
                        yield partition.path, *found
                elif not self.gaps:
                    row = record(found[1], found[2], capture.link, capture.unit)
                    if row is not None:
                        yield row
        finally:
            capture.reader.close()


class CaptureSource(DataSource):
    """Options: path, range_bytes (128 MB) or parts, what (packets or gaps)."""

    @classmethod
    def name(cls) -> str:
        return "rivulet_capture"

    def schema(self) -> str:
        return GAPS if self.options.get("what") == "gaps" else SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Flow records of all captures at path, a file or a folder."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("rivulet_capture").options(**options).load(path)


def gaps(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, begin, length, reason): bytes that hold no readable packets."""
    return read(spark, path, what="gaps", **options)
