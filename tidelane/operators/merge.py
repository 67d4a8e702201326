"""A flow's protocol layers from its packets': the first value that isn't empty, unions in first-seen order, and the protocol stack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType
from pyspark.sql.window import Window

from ..functions.dictionaries import PORTS
from ..sources import quic as quic_bytes
from ..sources import tls as tls_bytes
from .folds import folded

#: Lists that are joined instead of taken from the first packet that has them.
APPENDED = ("handshake_types", "certificates", "record_types", "crypto_fragments")


def _there(c: Column, kind) -> Column:
    if isinstance(kind, ArrayType):
        return F.size(c) > 0
    if isinstance(kind, (StringType, BinaryType)):
        return c.isNotNull() & (F.length(c) > 0)
    return c.isNotNull()


def joined(c: Column) -> Column:
    """All elements of an array column, in the order of packets."""
    rows = F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("pkt_no", c.alias("v")))))
    return F.flatten(F.transform(rows, lambda x: x["v"]))


def first_wins(layer: str, schema: StructType) -> Column:
    """A layer's struct merged over a group of packets; null if no packet has it."""
    fields = []
    for f in schema.fields:
        c = F.col(f"{layer}.{f.name}")
        if f.name in APPENDED:
            fields.append(joined(c).alias(f.name))
        else:
            there = _there(c, f.dataType)
            fields.append(F.min_by(F.when(there, c), F.when(there, F.col("pkt_no"))).alias(f.name))
    return F.when(F.count(F.col(layer)) > 0, F.struct(*fields))


def first_entries(column: str) -> Column:
    """Of a map column the first value of each key, in the order of packets, as one map."""
    rows = F.array_sort(F.collect_list(F.when(F.size(F.col(column)) > 0, F.struct("pkt_no", F.map_entries(F.col(column)).alias("e")))))
    entries = F.flatten(F.transform(rows, lambda x: x["e"]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(entries, lambda e: e["key"] == k)[0]["value"]))


def dns_union() -> Column:
    """Query names in first-seen order; of codes and counts the first that isn't 0, of flags the first."""
    names = F.array_distinct(joined(F.col("dns.queries")))

    def first(field: str, zero: bool) -> Column:
        c = F.col(f"dns.{field}")
        there = c.isNotNull() & ((c != 0) if zero else F.lit(True))
        return F.coalesce(F.min_by(F.when(there, c), F.when(there, F.col("pkt_no"))), F.lit(0)).alias(field)

    counts = [first(f, True) for f in ("response_code", "question_count", "answer_count", "authority_count", "additional_count")]
    return F.when(F.count(F.col("dns")) > 0, F.struct(names.alias("queries"), *counts, first("flags", False)))


def ext_protocol(columns: list[str]) -> Column:
    """IPv4 or IPv6, the transport, then what else the flow has: TLS (and HTTPS by its ALPN), DNS, QUIC, users' protocols in capitals."""
    protocol = F.col("protocol")
    parts = [
        F.when(F.col("src_ip").contains(":"), "IPv6").otherwise("IPv4"),
        F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").when(protocol == 1, "ICMP").when(protocol == 58, "ICMPv6").when(protocol == 132, "SCTP"),
    ]
    if "tls" in columns:
        web = F.exists(F.coalesce(F.col("tls.alpn"), F.array().cast("array<string>")), lambda a: (a == "h2") | a.startswith("http"))
        parts += [F.when(F.col("tls").isNotNull(), "TLS"), F.when(F.col("tls").isNotNull() & web, "HTTPS")]
    parts += [F.when(F.col(n).isNotNull(), n.upper()) for n in ("dns", "quic") if n in columns]
    stack = F.array_compact(F.array(*parts))
    return F.concat(stack, F.transform("extra_protocols", F.upper)) if "extra_protocols" in columns else stack


class _TlsStream:
    """The records of a flow's two directions, put together from their segments in order of arrival, as one layer. A worker holds an unfinished record of
    each direction and what hellos and certificates said."""

    fields = [("tls", tls_bytes.SCHEMA)]

    def __init__(self):
        self.sender, self.held, self.hidden, self.said = None, [b"", b""], [False, False], None

    def feed(self, row: dict) -> None:
        sender = (row["src_ip"], row["src_port"])
        self.sender = self.sender or sender
        side = sender != self.sender
        data = self.held[side] + row["payload"]
        found, used, self.hidden[side] = tls_bytes.records_after(data, self.hidden[side])
        if found is not None:
            self.said = tls_bytes.merge_into(self.said, found)
        self.held[side] = data[used : used + tls_bytes.LONGEST + 5]

    def result(self) -> dict | None:
        return {"tls": self.said} if self.said else None


def tls_streams(packets: DataFrame) -> DataFrame:
    """flow, eligible, tls: the layer of each TCP flow that has a TLS port or a packet with a record, from whole records across its packets; null if
    no record is whole."""
    port = F.col("src_port").isin(*PORTS["tls"]) | F.col("dst_port").isin(*PORTS["tls"])
    marked = packets.filter("protocol = 6").withColumn("eligible", port | F.max(F.col("tls").isNotNull()).over(Window.partitionBy("flow"))).filter("eligible")
    found = folded(marked.filter(F.length("payload") > 0), _TlsStream, _TlsStream.fields, ["payload", "src_ip", "src_port"])
    return marked.select("flow", "eligible").distinct().join(found.withColumnRenamed("tls", "whole_tls"), "flow", "left")


def _crypto_hello(fragments: pd.Series) -> pd.DataFrame:
    rows = []
    for parts in fragments:
        said = quic_bytes.client_hello([(x["offset"], x["data"]) for x in parts]) if parts is not None and len(parts) else None
        rows.append((said["sni"], said["alpn"], said["cipher_suites"]) if said else (None, [], []))
    return pd.DataFrame(rows, columns=["sni", "alpn", "cipher_suites"])


_crypto_hello.__annotations__ = {"fragments": pd.Series, "return": pd.DataFrame}


def quic_reassembled(layer: Column) -> Column:
    """A flow's merged QUIC layer with what the ClientHello says that the CRYPTO fragments of all its Initials make up (64 KiB at most)."""
    hello = F.pandas_udf(_crypto_hello, "sni string, alpn array<string>, cipher_suites array<bigint>")(layer["crypto_fragments"])
    out = layer
    for name in ("sni", "alpn", "cipher_suites"):
        there = F.length(hello[name]) > 0 if name == "sni" else F.size(hello[name]) > 0
        out = out.withField(name, F.when(F.coalesce(there, F.lit(False)), hello[name]).otherwise(layer[name]))
    return F.when(layer.isNotNull(), out)
