"""Capture files (pcap in micro- and nanoseconds, both byte orders; pcapng) as rows of raw packets.

Files come through Spark's ``binaryFile`` source, so any file system that Spark reads will do. Packets are numbered in file order (``pkt_no``), the only
order that later operators use; timestamps need not follow it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import LINK_TYPES

RAW_SCHEMA = "file string, pkt_no bigint, ts_us bigint, link_type int, caplen bigint, wirelen bigint, data binary"
RAW_ARROW = pa.schema([("file", pa.string()), ("pkt_no", pa.int64()), ("ts_us", pa.int64()), ("link_type", pa.int32()), ("caplen", pa.int64()), ("wirelen", pa.int64()), ("data", pa.binary())])
#: Magic bytes by (byte order, units of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
_SECTION, _INTERFACE, _PACKET = 0x0A0D0D0A, 1, 6


def packets_in(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(time in microseconds, link type, length on the wire, captured bytes) of a capture's packets; ends silently at a truncated record.

    ValueError if it is no capture. In pcapng, timestamps count as microseconds whatever the interface says, and unknown blocks are passed over.
    """
    if content[:4] in MAGIC:
        order, unit = MAGIC[content[:4]]
        if len(content) < 24:
            raise ValueError("a capture without its header")
        link, at, head = struct.unpack_from(order + "I", content, 20)[0], 24, struct.Struct(order + "IIII")
        while at + 16 <= len(content):
            sec, part, caplen, wirelen = head.unpack_from(content, at)
            if at + 16 + caplen > len(content):
                return
            yield sec * 1_000_000 + part * 1_000_000 // unit, link, wirelen, content[at + 16 : at + 16 + caplen]
            at += 16 + caplen
    elif content[:4] == PCAPNG:
        order, at, links = "<", 0, []
        while at + 12 <= len(content):
            if content[at : at + 4] == PCAPNG:
                order = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                links = []
            kind, length = struct.unpack_from(order + "II", content, at)
            if length < 12 or at + length > len(content):
                return
            if kind == _INTERFACE:
                links.append(struct.unpack_from(order + "H", content, at + 8)[0])
            elif kind == _PACKET and length >= 32:
                interface, high, low, caplen, wirelen = struct.unpack_from(order + "IIIII", content, at + 8)
                if caplen > length - 32:
                    return
                yield (high << 32) + low, links[interface] if interface < len(links) else 1, wirelen, content[at + 28 : at + 28 + caplen]
            at += length
    else:
        raise ValueError("not a capture")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, size = [], 0
            try:
                for no, (ts, link, wirelen, data) in enumerate(packets_in(content.as_py())):
                    rows.append((path, no, ts, link, len(data), wirelen, data))
                    size += len(data) + 100
                    if size > 1 << 24:
                        yield out(rows)
                        rows, size = [], 0
            except ValueError:
                pass  # `bad_captures` lists it
            yield out(rows)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def raw_packets(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All packets of one capture or of those in a folder."""
    return files(spark, path, pattern).select("path", "content").mapInArrow(_split, RAW_SCHEMA)


def is_capture(content: Column) -> Column:
    """Whether bytes begin like a capture with microseconds or like pcapng (captures with nanoseconds are read, but not told here)."""
    return F.hex(F.substring(content, 1, 4)).isin("D4C3B2A1", "A1B2C3D4", "0A0D0D0A")


def bad_captures(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files that aren't captures: path, error."""
    known = F.hex(F.substring("content", 1, 4)).isin(*[m.hex().upper() for m in (*MAGIC, PCAPNG)])
    return files(spark, path, pattern).filter(~known).select("path", F.lit("not a capture").alias("error"))


def link_layer(link_type: int) -> str:
    return LINK_TYPES.get(link_type, "unknown")


def write_capture(packets: list[tuple[int, int, bytes]], link_type: int = 1) -> bytes:
    """A capture (microseconds, little-endian) of (time in microseconds, length on the wire, bytes)."""
    parts = [b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, link_type)]
    for ts, wirelen, data in packets:
        parts.append(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(data), wirelen) + data)
    return b"".join(parts)
