"""Captures in byte ranges: the same packets for any number of ranges, damage, IPv6."""

import random
import socket
import struct

import pytest

from rivulet.sources import capture


def tcp(port, flags=0x12):
    return struct.pack(">HHIIBBHHH", port, 443, 0, 0, 0x50, flags, 0, 0, 0)


def v4(body, proto=6, fragment=0):
    return bytes([0x45, 0]) + struct.pack(">HHHBBH", 20 + len(body), 0, fragment, 64, proto, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + body


def v6(body, follows=6):
    return bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", len(body), follows, 64) + socket.inet_pton(socket.AF_INET6, "2001:db8::1") + socket.inet_pton(socket.AF_INET6, "fe80::2") + body


def ether(ip, kind=b"\x08\x00", tag=b""):
    return bytes(12) + tag + kind + ip


def written(path, frames, order="<", magic=0xA1B2C3D4, seed=0, cut=0):
    draw = random.Random(seed)
    out, places = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1), []
    for i, f in enumerate(frames):
        places.append(len(out))
        out += struct.pack(order + "4I", 1_700_000_000 + i, draw.randrange(10**6), len(f), len(f)) + f
    path.write_bytes(out[: len(out) - cut] if cut else out)
    return places


def frames(n, seed=1):
    draw = random.Random(seed)
    return [ether(v4(tcp(i) + draw.randbytes(draw.randrange(0, 900)))) if i % 3 else ether(v6(tcp(i) + bytes(draw.randrange(0, 400))), b"\x86\xdd") for i in range(n)]


@pytest.mark.parametrize(("order", "magic"), [("<", 0xA1B2C3D4), (">", 0xA1B23C4D)])
def test_same_packets_for_any_number_of_ranges(spark, tmp_path, order, magic):
    written(tmp_path / "x.pcap", frames(400), order, magic)
    one, *others = (sorted(map(tuple, capture.read(spark, str(tmp_path), parts=n).collect())) for n in (1, 2, 16, 97))
    assert len(one) == 400 and all(o == one for o in others) and {r[3] for r in one} == set(range(400))
    assert capture.gaps(spark, str(tmp_path), parts=16).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_damage_is_skipped_and_told(spark, tmp_path, parts):
    places = written(tmp_path / "x.pcap", frames(120))
    data = bytearray((tmp_path / "x.pcap").read_bytes())
    data[places[50] + 8 : places[50] + 12] = b"\xff" * 4  # a length that can't be
    (tmp_path / "x.pcap").write_bytes(bytes(data[:-3]))  # and the last one is cut off
    (tmp_path / "y.pcap").write_bytes(b"no capture at all")
    got = {r.src_port for r in capture.read(spark, str(tmp_path), parts=parts).collect()}
    assert got == set(range(119)) - {50}
    gaps = sorted((r.path.rsplit("/", 1)[1], r.begin, r.length) for r in capture.gaps(spark, str(tmp_path), parts=parts).collect() if r.length)
    assert ("y.pcap", 0, 17) in gaps
    assert any(n == "x.pcap" and b == places[50] for n, b, _ in gaps) and any(n == "x.pcap" and b == places[119] for n, b, _ in gaps)


def test_layers():
    udp = struct.pack(">HHHH", 53, 5353, 8, 0)
    read = lambda frame, link=1: capture.record((1, 500_000, len(frame), 77), frame, link, 10**6)
    assert read(ether(v4(udp, 17))) == (1.5, "10.0.0.1", "10.0.0.2", 53, 5353, "UDP", 77, 0)
    assert read(ether(v6(tcp(9)), b"\x86\xdd"))[1:6] == ("2001:db8::1", "fe80::2", 9, 443, "TCP")
    assert read(ether(v6(bytes([44, 0, *[0] * 6]) + bytes([6, 0, 0, 1, 0, 0, 0, 0]) + tcp(8), 0), b"\x86\xdd"))[3:6] == (8, 443, "TCP")  # hop-by-hop, then a first fragment
    assert read(ether(v6(bytes([6, 0, 1, 1, 0, 0, 0, 0]) + tcp(8), 44), b"\x86\xdd"))[3:6] == (0, 0, "TCP")  # a later fragment
    assert read(ether(v4(tcp(7), fragment=5)))[3:5] == (0, 0)
    assert read(ether(v4(tcp(7)), tag=b"\x81\x00\x00\x05"))[3] == 7 and read(v4(tcp(6)), 101)[3] == 6
    assert read(ether(b"", b"\x08\x06")) is None and read(v4(tcp(6)), 250) is None and read(b"") is None
