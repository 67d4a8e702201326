"""Frames and captures built byte by byte for the tests."""

import struct

from tidelane.sources.captures import write_capture


def ip4(src, dst, proto, body, number=1, flags=0, offset=0, ttl=64, tos=0):
    head = struct.pack("!BBHHHBBH", 0x45, tos, 20 + len(body), number, flags << 13 | offset, ttl, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def ip6(src, dst, kind, body):
    import ipaddress

    return struct.pack("!IHBB", 6 << 28, len(body), kind, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + body


def tcp(sport, dport, seq=1, ack=0, flags=0x18, data=b"", win=8192):
    return struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, win, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data


def eth(body, kind=0x0800):
    return b"\x02\0\0\0\0\x02" + b"\x02\0\0\0\0\x01" + struct.pack("!H", kind) + body


def tcp4(src, sport, dst, dport, **more):
    return eth(ip4(src, dst, 6, tcp(sport, dport, **more)))


def udp4(src, sport, dst, dport, data=b""):
    return eth(ip4(src, dst, 17, udp(sport, dport, data)))


def vector(body, size):
    return len(body).to_bytes(size, "big") + body


def client_hello(host="www.example.com", ciphers=(0x0A0A, 0x1301, 0xC02F), alpn=("h2",)):
    def ext(kind, body):
        return struct.pack("!H", kind) + vector(body, 2)

    names = b"".join(vector(a.encode(), 1) for a in alpn)
    exts = ext(0, vector(b"\0" + vector(host.encode(), 2), 2)) + ext(10, vector(struct.pack("!HH", 29, 23), 2)) + ext(11, vector(b"\0", 1)) + ext(16, vector(names, 2)) + ext(43, vector(struct.pack("!HH", 0x0304, 0x0303), 1))
    body = b"\x03\x03" + bytes(32) + vector(b"", 1) + vector(b"".join(struct.pack("!H", c) for c in ciphers), 2) + vector(b"\0", 1) + vector(exts, 2)
    return b"\x01" + vector(body, 3)


def record(kind, body):
    return bytes([kind]) + b"\x03\x03" + vector(body, 2)


def dns_query(number, name, response=False, answer=None):
    question = b"".join(vector(p.encode(), 1) for p in name.split(".")) + b"\0" + struct.pack("!HH", 1, 1)
    head = struct.pack("!HHHHHH", number, 0x8180 if response else 0x0100, 1, 1 if answer else 0, 0, 0)
    tail = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes(map(int, answer.split("."))) if answer else b""
    return head + question + tail


def capture(frames, link=1, start=1_700_000_000_000_000, step=1000):
    return write_capture([(start + k * step, len(f), f) for k, f in enumerate(frames)], link)
