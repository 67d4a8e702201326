"""Captures to flows in one plan: read, filter by headers, parse, filter, group, aggregate, filter flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.stats import array_stats
from ..operators import flows, merge
from ..sources import captures, declared, headers, layers

#: Layers that flows carry.
FLOW_LAYERS = ("tls", "dns", "quic")
SEQUENCES = {
    "packet_lengths": "wirelen * dir", "ip_lengths": "ip_len * dir", "trans_lengths": "trans_len * dir", "app_lengths": "app_len * dir", "iats": "gap",
    "payload_bytes": "CASE WHEN protocol = 6 THEN app_len * dir ELSE 0 END", "tcp_flags": "CASE WHEN protocol = 6 THEN tcp_flags END", "tcp_window": "CASE WHEN protocol = 6 THEN tcp_win END",
}


def flow_packets(packets: DataFrame, filter_rst: bool = False, filter_ack: bool = False, filter_retrans: bool = True, udp_timeout: float = 0.0) -> DataFrame:
    """Packets with flow, idx, dir and is_retrans, after the packet filters; retransmissions are kept, marked, until they have been counted."""
    df = packets.filter("src_ip is not null")
    df = flows.without_resets(df) if filter_rst else df
    df = flows.without_bare_acks(df) if filter_ack else df
    df = flows.canonical(df)
    if udp_timeout > 0:
        df = flows.udp_sessions(df, udp_timeout).withColumn("flow", F.when(F.col("session") > 0, F.concat("flow", F.lit("+"), F.col("session").cast("string"))).otherwise(F.col("flow")))
    df = flows.oriented(df)
    return flows.retransmissions(df) if filter_retrans else df.withColumn("is_retrans", F.lit(False))


def flow_table(df: DataFrame, statistics: bool = True, sequences: bool = False, reassemble: bool = True) -> DataFrame:
    """One row for each flow from ``flow_packets``: key, counters, summary, statistics of eight sequences, merged layers and protocol stack.

    ``reassemble``: TLS records and QUIC hellos are read across packets too.
    """
    kept = df.filter(~F.col("is_retrans")).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(flows.in_order()))
    up, down, tcp = F.col("dir") == 1, F.col("dir") == -1, F.col("protocol") == 6
    sizes = {n: F.coalesce(F.sum(F.when(c, F.col("wirelen"))), F.lit(0)) for n, c in (("up", up), ("down", down))}
    columns = [
        *[F.min_by(c, "idx").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "vlan_id", "file") if c in df.columns],
        F.count(F.lit(1)).alias("packet_count"), F.sum("wirelen").alias("byte_count"), F.count_if(up).alias("up_packet_count"), F.count_if(down).alias("down_packet_count"), sizes["up"].alias("up_byte_count"), sizes["down"].alias("down_byte_count"),
        *[F.count_if(tcp & flows.has(flag)).alias(f"{n}_count") for n, flag in (("syn", 2), ("fin", 1), ("rst", 4), ("ack", 16), ("psh", 8), ("urg", 32))],
        F.coalesce(F.min(F.nullif("tcp_win", F.lit(0))), F.lit(0)).alias("min_window"), F.coalesce(F.max("tcp_win"), F.lit(0)).alias("max_window"), F.coalesce(F.sum("tcp_win"), F.lit(0)).alias("sum_window"), F.lit(0).alias("out_of_order_count"),
        F.min_by("ts_us", "pkt_no").alias("start_us"), F.max("ts_us").alias("end_us"), F.coalesce(F.sum(F.abs("gap")), F.lit(0)).alias("iat_sum_us"),
        F.when(F.count_if(down) > 0, F.count_if(up) / F.count_if(down)).otherwise(0.0).alias("up_down_pkt_ratio"), F.when(sizes["down"] > 0, sizes["up"] / sizes["down"]).otherwise(0.0).alias("up_down_byte_ratio"),
    ]
    if statistics:
        columns += [F.struct(*array_stats(F.expr(x).cast("bigint"))).alias(name) for name, x in SEQUENCES.items()]
    for name in FLOW_LAYERS:
        if name in df.columns:
            columns.append((merge.dns_union() if name == "dns" else merge.first_wins(name, df.schema[name].dataType)).alias(name))
    if "extra" in df.columns:
        columns.append(F.array_distinct(F.flatten(F.collect_list(F.map_keys("extra")))).alias("extra_protocols"))
        columns.append(merge.first_entries("extra").alias("extra_layers"))
    out = kept.groupBy("flow").agg(*columns).join(df.groupBy("flow").agg(F.count_if("is_retrans").alias("retrans_count")), "flow")
    if reassemble and "tls" in df.columns and "payload" in df.columns:
        out = out.join(merge.tls_streams(kept), "flow", "left")
        out = out.withColumn("tls", F.when(F.col("eligible"), F.col("whole_tls")).otherwise(F.col("tls"))).drop("eligible", "whole_tls")
    if reassemble and "quic" in df.columns:
        out = out.withColumn("quic", merge.quic_reassembled(F.col("quic")))
    out = out.withColumn("ext_protocol", merge.ext_protocol(out.columns))
    if not sequences:
        return out
    lists = flows.sequences(kept)
    return out.join(lists.toDF(*[c if c == "flow" else f"{c}_seq" for c in lists.columns]), "flow")


def analyze(
    spark: SparkSession, path: str, bpf_filter: str | None = None, default_filter: str | None = filters.DEFAULT_FILTER, filter_rst: bool = False, filter_ack: bool = False, filter_retrans: bool = True, min_packets: int = 1, udp_timeout: float = 0.0,
    app_layer_parsing: str = "full", statistics: bool = True, sequences: bool = False, pattern: str | None = None, protocols: list[dict | str] | None = None, loose_filter: bool = False,
) -> DataFrame:
    """Flows of one capture, or of those in a folder (flows never cross files).

    The filter's conjuncts that headers decide drop packets; those that ask for layers choose flows by what they carry. ``loose_filter`` is the older rule:
    if any term asks for a parsed layer, no packet is dropped by the filter, and flows pass whose layers fit, whatever their addresses and ports.
    ``protocols`` are declarations (see ``sources.declared``).
    """
    tree = filters.parse(bpf_filter) if bpf_filter else None
    head, rest = filters.split(tree)
    more: dict[str, Callable] = {}
    routes: dict[tuple[str, int], str] = {}
    for declaration in protocols or []:
        name, parse, own = declared.compiled(declaration)
        more[name] = parse
        routes |= own
    raw = captures.raw_packets(spark, path, pattern)
    dropping = rest is None or not loose_filter
    default = filters.parse(default_filter) if default_filter else None
    if dropping:
        raw = headers.plainly_kept(raw, default, head)
    packets = layers.packets(raw, list(FLOW_LAYERS), app_layer_parsing, more, routes)
    if dropping:
        packets = packets.filter(filters.compiled(default, packets.columns) & filters.compiled(head, packets.columns))
    out = flow_table(flow_packets(packets, filter_rst, filter_ack, filter_retrans, udp_timeout), statistics, sequences, app_layer_parsing == "full")
    out = out.filter(filters.flow_filter(tree, out.columns)) if rest is not None else out
    return out.filter(F.col("packet_count") >= min_packets) if min_packets > 1 else out


def run_statistics(spark: SparkSession, path: str, pattern: str | None = None, **options) -> dict[str, int | list[str]]:
    """What ``analyze`` with these options goes through: files_processed, packets_processed, packets_filtered, flows_created, errors (files that aren't captures)."""
    raw = captures.raw_packets(spark, path, pattern)
    counted = raw.agg(F.count(F.lit(1)).alias("packets")).first()
    flows_of = analyze(spark, path, pattern=pattern, statistics=False, **options)
    made = flows_of.agg(F.count(F.lit(1)).alias("flows"), F.coalesce(F.sum(F.col("packet_count") + F.col("retrans_count")), F.lit(0)).alias("packets")).first()
    bad = [r["path"] for r in captures.bad_captures(spark, path, pattern).select("path").toLocalIterator()]
    return {"files_processed": captures.files(spark, path, pattern).select("path").count() - len(bad), "packets_processed": counted["packets"], "packets_filtered": counted["packets"] - made["packets"], "flows_created": made["flows"], "errors": bad}
