"""Frames from packet rows: Ethernet, IPv4, TCP or UDP. The inverse of the parser, for captures that hold what a table says."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import joined, pieces
from .captures import RAW_ARROW, RAW_SCHEMA

_MAC = bytes.fromhex("020000000002020000000001")


def frame(src: str, sport: int, dst: str, dport: int, proto: int, payload: bytes, flags: int = 0x18, seq: int = 0, win: int = 0) -> bytes:
    if proto == 6:
        body = struct.pack("!HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 5 << 4, flags, win, 0, 0) + payload
    else:
        body = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0)
    return _MAC + b"\x08\0" + head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


#: What a packet row has for a frame; the last three are optional.
COLUMNS = ["pkt_no", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "payload", "tcp_flags", "tcp_seq", "tcp_win"]


def framing(file: str = "table") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of packet rows to batches of raw packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> Iterator[dict]:
            for r in rows:
                data = frame(r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"], r["protocol"], r["payload"] or b"", r["tcp_flags"] or 0, r["tcp_seq"] or 0, r["tcp_win"] or 0)
                yield {"file": file, "pkt_no": r["pkt_no"], "ts_us": r["ts_us"], "link_type": 1, "caplen": len(data), "wirelen": len(data), "data": data}

        for rows in pieces(batches):
            yield from joined(made(rows), RAW_ARROW)

    return run


def packet_rows(packets: DataFrame) -> DataFrame:
    """``COLUMNS`` of packets, with defaults for those that are optional."""
    defaults = {"tcp_flags": F.lit(24), "tcp_seq": F.lit(1), "tcp_win": F.lit(8192)}
    return packets.withColumns({k: v for k, v in defaults.items() if k not in packets.columns}).select(*COLUMNS)


def frames_of(packets: DataFrame, file: str = "table") -> DataFrame:
    """Raw packets from rows with pkt_no, ts_us, src_ip, src_port, dst_ip, dst_port, protocol, payload, tcp_flags, tcp_seq, tcp_win."""
    return packet_rows(packets).mapInArrow(framing(file), RAW_SCHEMA)


def _vector(body: bytes, size: int) -> bytes:
    return len(body).to_bytes(size, "big") + body


def client_hello(host: str, ciphers: tuple[int, ...] = (0x0A0A, 0x1301, 0xC02F)) -> bytes:
    """A TLS record with a ClientHello for a host."""

    def ext(kind: int, body: bytes) -> bytes:
        return struct.pack("!H", kind) + _vector(body, 2)

    exts = ext(0, _vector(b"\0" + _vector(host.encode(), 2), 2)) + ext(10, _vector(struct.pack("!HH", 29, 23), 2)) + ext(11, _vector(b"\0", 1)) + ext(16, _vector(_vector(b"h2", 1), 2))
    body = b"\x03\x03" + bytes(32) + _vector(b"", 1) + _vector(b"".join(struct.pack("!H", c) for c in ciphers), 2) + _vector(b"\0", 1) + _vector(exts, 2)
    return b"\x16\x03\x01" + _vector(b"\x01" + _vector(body, 3), 2)


def dns_message(number: int, name: str, response: bool = False) -> bytes:
    question = b"".join(_vector(p.encode(), 1) for p in name.split(".")) + b"\0" + struct.pack("!HH", 1, 1)
    tail = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + b"\xc0\0\2\x01" if response else b""
    return struct.pack("!HHHHHH", number & 0xFFFF, 0x8180 if response else 0x0100, 1, int(response), 0, 0) + question + tail
