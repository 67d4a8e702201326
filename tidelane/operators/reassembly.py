"""Putting together what the network took apart: IP fragments, TCP streams, TLS records. Standalone; no other operator calls these by itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tls
from .folds import folded


def ip_fragments(fragments: DataFrame) -> DataFrame:
    """Datagrams from fragments (src_ip, dst_ip, protocol, ip_id, offset in bytes, more, payload): one row for each that is whole, with its payload.

    Of fragments with the same offset the first (by pkt_no) counts. A datagram is whole if its last fragment is there and no byte is missing.
    """
    key = ["src_ip", "dst_ip", "protocol", "ip_id"]
    first = fragments.groupBy(*key, "offset").agg(F.min_by("payload", "pkt_no").alias("payload"), F.min_by("more", "pkt_no").alias("more"), F.min("pkt_no").alias("pkt_no"))
    whole = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("offset", "payload", "more"))).alias("parts"), F.min("pkt_no").alias("pkt_no"), F.max(~F.col("more")).alias("has_last"))
    reach = F.aggregate("parts", F.lit(0).cast("bigint"), lambda at, p: F.when(at == p["offset"], at + F.length(p["payload"])).otherwise(F.lit(-1)))
    joined = F.aggregate("parts", F.lit(b""), lambda b, p: F.concat(b, p["payload"]))
    return whole.withColumn("reach", reach).filter("has_last and reach >= 0").select(*key, "pkt_no", F.size("parts").alias("n_fragments"), joined.alias("payload"))


class _Stream:
    """One direction's bytes in sequence: late segments wait, what was there already is cut off, gaps are counted at the end."""

    fields = [("data", pa.binary()), ("segments", pa.int64()), ("out_of_order", pa.int64()), ("missing", pa.int64()), ("finished", pa.bool_())]

    def __init__(self):
        self.base, self.data, self.waiting, self.n, self.late, self.fin = None, bytearray(), {}, 0, 0, False

    def feed(self, row: dict) -> None:
        payload, flags, seq = row["payload"] or b"", row["tcp_flags"] or 0, row["tcp_seq"]
        if seq is None:
            return
        if flags & 2:
            self.base = seq + 1 & 0xFFFFFFFF
            seq = self.base
        if self.base is None:
            self.base = seq
        self.fin |= bool(flags & 1)
        if not payload:
            return
        self.n += 1
        at = (seq - self.base + (1 << 31) & 0xFFFFFFFF) - (1 << 31)
        self.late += at > len(self.data)
        self.waiting[at] = max(self.waiting.get(at, b""), payload, key=len)
        self.drain()

    def drain(self) -> None:
        moved = True
        while moved:
            moved = False
            for at in sorted(self.waiting):
                if at > len(self.data):
                    break
                part = self.waiting.pop(at)[max(0, len(self.data) - at) :]
                self.data += part
                moved = True

    def result(self) -> dict | None:
        return {"data": bytes(self.data), "segments": self.n, "out_of_order": self.late, "missing": sum(map(len, self.waiting.values())), "finished": self.fin} if self.n else None


def tcp_streams(packets: DataFrame) -> DataFrame:
    """Each direction's stream from oriented packets: flow (with the direction), data, segments, out_of_order, missing, finished."""
    sided = packets.filter("protocol = 6").withColumn("flow", F.concat("flow", F.when(F.col("dir") == 1, ">").otherwise("<")))
    return folded(sided, _Stream, _Stream.fields, ["payload", "tcp_flags", "tcp_seq"])


class _Records(_Stream):
    fields = [("record_types", pa.list_(pa.int64())), ("handshake_types", pa.list_(pa.int64())), ("sni", pa.string()), ("left_over", pa.int64())]

    def result(self) -> dict | None:
        found, used = tls.records(bytes(self.data))
        if found is None:
            return None
        return {"record_types": found["record_types"], "handshake_types": found["handshake_types"], "sni": found["sni"], "left_over": len(self.data) - used}


def tls_records(packets: DataFrame) -> DataFrame:
    """TLS records of each direction, from its reassembled stream."""
    sided = packets.filter("protocol = 6").withColumn("flow", F.concat("flow", F.when(F.col("dir") == 1, ">").otherwise("<")))
    return folded(sided, _Records, _Records.fields, ["payload", "tcp_flags", "tcp_seq"])
