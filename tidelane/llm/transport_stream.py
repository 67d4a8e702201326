"""Media columns: MPEG transport streams.

A payload is stored as one program with one elementary stream of private data: association and map tables before each group of elementary packets
that begins with a random-access point, elementary packets with presentation times, 188-byte packets with continuity counters. Reading parses
the tables, checks their checksums and all continuity counters, puts the elementary packets together again and lists times and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, text_of

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, CLOCK, PTS_BITS = 188, 0x47, 0x1FFF, 90_000, 33
#: Ours: identifiers, stream type (private data), samples in a frame, frames in an elementary packet, elementary packets in a group, samples a second.
PMT_PID, DATA_PID, STREAM_TYPE, FRAME, FRAMES, GROUP, RATE = 0x1000, 0x100, 0x06, 576, 16, 8, 48_000


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def _elementary(data: bytes, pts: int, random_access: bool) -> np.ndarray:
    """The transport packets of one elementary packet; counters are set later."""
    length = len(data) + 8
    body = b"\0\0\x01\xbd" + length.to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
    clock = (pts << 15 | 0x7E00).to_bytes(6, "big")  # base, reserved bits, no extension
    room = PACKET - 4 - 8
    rest = len(body) - room
    n = 1 + -(-rest // (PACKET - 4))
    out = np.empty((n, PACKET), np.uint8)
    out[:, :4] = (SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10)
    flat = np.frombuffer(body, np.uint8)
    out[0, 1] |= 0x40
    out[0, 3] = 0x30
    out[0, 4:12] = np.frombuffer(bytes([7, 0x10 | 0x40 * random_access]) + clock, np.uint8)
    out[0, 12:] = flat[:room]
    whole = rest // (PACKET - 4)
    out[1 : 1 + whole, 4:] = flat[room : room + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    if left := rest - whole * (PACKET - 4):
        stuffing = PACKET - 4 - left
        out[-1, 3] = 0x30
        out[-1, 4 : 4 + stuffing] = 255
        out[-1, 4] = stuffing - 1
        if stuffing > 1:
            out[-1, 5] = 0
        out[-1, 4 + stuffing :] = flat[-left:]
    return out


def padded(raw: bytes) -> bytes:
    """Bytes 255 are added up to a positive multiple of a frame; UTF-8 has no such byte."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\xff")


def write_stream(payload: bytes) -> bytes:
    """A transport stream of a payload of whole frames."""
    parts, data_at, at = [], [], 0
    tables = 0
    for k, lo in enumerate(range(0, len(payload), FRAME * FRAMES)):
        if k % GROUP == 0:
            for packet in (_PAT, _PMT):
                packet = packet.copy()
                packet[3] |= tables & 15
                parts.append(packet[None])
            tables += 1
            at += 2
        pts = lo * CLOCK // RATE & (1 << PTS_BITS) - 1
        part = _elementary(payload[lo : lo + FRAME * FRAMES], pts, k % GROUP == 0)
        data_at.append(np.arange(at, at + len(part)))
        at += len(part)
        parts.append(part)
    out = np.concatenate(parts)
    where = np.concatenate(data_at)
    out[where, 3] |= (np.arange(len(where)) & 15).astype(np.uint8)
    return out.tobytes()


class Stream:
    """What a transport stream holds: programs {number: map's pid}, streams {pid: type}, discontinuities, packets, and of the first elementary stream
    payload, times (ticks of 90 kHz) and random_access (places in ``times``). Raises ValueError where bytes can't be a transport stream."""

    def __init__(self, raw: bytes):
        if len(raw) % PACKET or not raw:
            raise ValueError("not whole transport packets")
        p = np.frombuffer(raw, np.uint8).reshape(-1, PACKET)
        if (p[:, 0] != SYNC).any():
            raise ValueError("synchronisation is lost")
        self.packets = len(p)
        pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        begins, has_field, has_data, counter = p[:, 1] & 0x40 != 0, p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0, p[:, 3] & 15
        offset = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
        if (offset > PACKET).any():
            raise ValueError("an adaptation field is longer than its packet")
        access = has_field & (p[:, 4] > 0) & (p[:, 5] & 0x40 != 0)
        self.discontinuities = 0
        for one in np.unique(pid[has_data & (pid != NULL_PID)]):
            run = counter[has_data & (pid == one)].astype(np.int32)
            self.discontinuities += int(((run[1:] - run[:-1]) % 16 != 1).sum())

        def data_of(one: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Its bytes; where packets that begin something start in them; whether those are random-access points."""
            at = np.flatnonzero((pid == one) & has_data)
            inside = np.arange(PACKET) >= offset[at][:, None]
            starts = np.cumsum(PACKET - offset[at]) - (PACKET - offset[at])
            first = begins[at]
            return p[at][inside], starts[first], access[at][first]

        def section_of(one: int, table_id: int) -> bytes:
            data, starts, _ = data_of(one)
            if not len(starts):
                raise ValueError(f"no table in packets {one}")
            raw = data[starts[0] :].tobytes()
            raw = raw[1 + raw[0] :]
            length = 3 + ((raw[1] & 0x0F) << 8 | raw[2])
            if raw[0] != table_id or len(raw) < length or crc32_cached(raw[:length]):
                raise ValueError(f"a broken table in packets {one}")
            return raw[8 : length - 4]

        body = section_of(0, 0)
        self.programs = {body[k] << 8 | body[k + 1]: (body[k + 2] & 0x1F) << 8 | body[k + 3] for k in range(0, len(body), 4)}
        self.streams: dict[int, int] = {}
        for number, where in self.programs.items():
            if number:
                body = section_of(where, 2)
                at = 4 + ((body[2] & 0x0F) << 8 | body[3])
                while at < len(body):
                    self.streams[(body[at + 1] & 0x1F) << 8 | body[at + 2]] = body[at]
                    at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
        data, starts, points = data_of(next(iter(self.streams)))
        ends = [*starts[1:].tolist(), len(data)]
        self.random_access = np.flatnonzero(points).tolist()
        self.times: list[int | None] = []
        parts = []
        for lo, hi in zip(starts.tolist(), ends, strict=True):
            raw = data[lo:hi].tobytes()
            length = raw[4] << 8 | raw[5]
            if raw[:3] != b"\0\0\x01" or length and len(raw) < 6 + length:
                raise ValueError("a broken elementary packet")
            parts.append(raw[9 + raw[8] : 6 + length if length else len(raw)])
            t = raw[9:14]
            self.times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if raw[7] & 0x80 else None)
        self.payload = b"".join(parts)


_good: set[bytes] = set()


def crc32_cached(section: bytes) -> int:
    """0 for a section whose checksum is right; a few tables recur in all streams."""
    if section in _good:
        return 0
    crc = crc32_mpeg(section)
    if not crc and len(_good) < 1000:
        _good.add(section)
    return crc


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, media, size = [], [], 0
        for number, text in zip(batch.column(0), batch.column(1), strict=True):
            numbers.append(number.as_py())
            media.append(write_stream(padded(text.as_py().encode("utf-8", "surrogatepass"))))
            size += len(media[-1])
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, batch.schema.types[0]), pa.array(media, pa.binary())], ["doc_id", "media"])
                numbers, media, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(numbers, batch.schema.types[0]), pa.array(media, pa.binary())], ["doc_id", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts (null: empty) as transport streams in the shared folder: doc_id, media. An empty text is one frame of bytes 255; ids may be null or
    repeated, an empty table gives no rows, and other columns are not read."""
    return saved(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_write, "doc_id bigint, media binary"), "media", "zstd")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(1):
            raw = media.as_py()
            s = Stream(raw)
            pid, kind = next(iter(s.streams.items()))
            samples = np.frombuffer(s.payload, np.uint8)
            feature = f"pid={pid} type={kind} packets={s.packets} elementary={len(s.times)} random_access={len(s.random_access)} first_pts={s.times[0]} last_pts={s.times[-1]} discontinuities={s.discontinuities} mean={int(samples.sum(dtype=np.int64)) / len(samples):.4f}"
            rows.append((len(s.payload.rstrip(b"\xff")), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in FEATURES.split(", ")])


def describe_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored streams, from the bytes as read back."""
    return media.select("doc_id", "media").mapInArrow(_describe, FEATURES)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Stream(m.as_py()) for m in batch.column(1)]
        columns = [pa.array([s.payload for s in found], pa.binary()), pa.array([s.times for s in found], pa.list_(pa.int64())), pa.array([s.random_access for s in found], pa.list_(pa.int32())), pa.array([s.discontinuities for s in found], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "payload", "times", "random_access", "discontinuities"])


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, payload, times (90 kHz), random_access (places in times), discontinuities."""
    return media.select("doc_id", "media").mapInArrow(_open, "doc_id bigint, payload binary, times array<bigint>, random_access array<int>, discontinuities int")


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(store_media(table(spark, sf_dir, "documents")))
