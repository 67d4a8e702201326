"""Per-flow feature vectors over oriented packets (see ``flows.oriented``): CIC and its extension, NetFlow v5, IPFIX, Argus.

Besides the columns of a packet table these take ip_hdr and l4_hdr (header lengths; 20 and 20 or 8 if there are none), ttl, tos and ip_id (0 if none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import distribution, or0, sample_std, sample_var
from .flows import ACK, CWR, ECE, FIN, PSH, RST, SYN, URG, before, has, in_order, so_far

#: Seconds: a longer gap ends an active period; the longest gap within a bulk; and the packets that make a bulk.
ACTIVE_GAP, BULK_GAP, BULK_PACKETS = 5.0, 1.0, 4


def with_defaults(packets: DataFrame) -> DataFrame:
    defaults = {"ip_hdr": F.lit(20), "l4_hdr": F.when(F.col("protocol") == 17, 8).otherwise(20), "ttl": F.lit(0), "tos": F.lit(0), "ip_id": F.lit(0)}
    return packets.withColumns({k: v for k, v in defaults.items() if k not in packets.columns})


def active_idle(packets: DataFrame, gap_s: float = ACTIVE_GAP) -> DataFrame:
    """Active and idle periods by flow, in microseconds: subflows, and mean, std, max, min of each. Periods without duration don't count."""
    gap = F.col("ts_us") - F.lag("ts_us").over(in_order())
    marked = packets.withColumn("gap", gap).withColumn("cut", F.coalesce(F.col("gap") > int(gap_s * 1e6), F.lit(False)))
    islands = marked.withColumn("period", F.sum(F.col("cut").cast("int")).over(so_far()))
    periods = islands.groupBy("flow", "period").agg((F.max_by("ts_us", "pkt_no") - F.min_by("ts_us", "pkt_no")).alias("active"), F.max(F.when(F.col("cut"), F.col("gap"))).alias("idle"))
    periods = periods.withColumn("active", F.when(F.col("active") > 0, F.col("active")))
    out = [F.count(F.lit(1)).alias("subflows")]
    for name in ("active", "idle"):
        x = F.col(name)
        out += [or0(F.avg(x)).alias(f"{name}_mean"), sample_std(x).alias(f"{name}_std"), or0(F.max(x)).alias(f"{name}_max"), or0(F.min(x)).alias(f"{name}_min")]
    return periods.groupBy("flow").agg(*out)


def bulks(packets: DataFrame, gap_s: float = BULK_GAP, least: int = BULK_PACKETS) -> DataFrame:
    """Bulk runs by flow and direction: states, bulk_pkts, bulk_bytes, bulk_us.

    A run is ``least`` or more packets with data of one direction, no gap above ``gap_s``, and no packet of the other direction that is later than the
    run's last one when the next comes.
    """
    other = F.last(F.when(F.col("dir") == 1, F.col("ts_us")), ignorenulls=True).over(before()), F.last(F.when(F.col("dir") == -1, F.col("ts_us")), ignorenulls=True).over(before())
    data = packets.withColumn("other_ts", F.when(F.col("dir") == 1, other[1]).otherwise(other[0])).filter("app_len > 0")
    last = F.lag("ts_us").over(in_order("dir"))
    fresh = last.isNull() | (F.col("ts_us") - last > int(gap_s * 1e6)) | F.coalesce(F.col("other_ts") > last, F.lit(False))
    runs = data.withColumn("new", fresh.cast("int")).withColumn("run", F.sum("new").over(so_far("dir")))
    per = runs.groupBy("flow", "dir", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("app_len").alias("bytes"), (F.max_by("ts_us", "pkt_no") - F.min_by("ts_us", "pkt_no")).alias("us")).filter(F.col("n") >= least)
    return per.groupBy("flow", "dir").agg(F.count(F.lit(1)).alias("states"), F.sum("n").alias("bulk_pkts"), F.sum("bytes").alias("bulk_bytes"), F.sum(F.greatest("us", F.lit(0))).alias("bulk_us"))


def _sided(packets: DataFrame) -> DataFrame:
    """Adds the gaps of the flow and of each direction, in microseconds."""
    return packets.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(in_order())).withColumn("side_gap", F.col("ts_us") - F.lag("ts_us").over(in_order("dir")))


def cic(packets: DataFrame, active_gap_s: float = ACTIVE_GAP, bulk_gap_s: float = BULK_GAP) -> DataFrame:
    """The 80 CIC columns and ``flow``; times in microseconds, statistics with n - 1, rates per second."""
    df = _sided(with_defaults(packets))
    fwd, bwd = F.col("dir") == 1, F.col("dir") == -1
    n, length, header = F.count(F.lit(1)), F.col("ip_len"), F.col("ip_hdr") + F.col("l4_hdr")
    sec = (F.max_by("ts_us", "pkt_no") - F.min_by("ts_us", "pkt_no")) / 1e6
    first = {c: F.min_by(c, "pkt_no") for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}

    def per_second(x: Column) -> Column:
        return F.when(sec > 0, x / sec).otherwise(0.0)

    def side(cond: Column, x: Column) -> Column:
        return F.when(cond, x)

    def four(x: Column, prefix: str, order: tuple[str, ...]) -> list[Column]:
        made = {"mean": or0(F.avg(x)), "std": sample_std(x), "max": or0(F.max(x)), "min": or0(F.min(x)), "tot": or0(F.sum(x)), "var": sample_var(x)}
        return [made[k].alias(f"{prefix}_{k}") for k in order]

    def flagged(flag: int, cond: Column | None = None) -> Column:
        return F.count_if(has(flag) if cond is None else has(flag) & cond)

    n_fwd, n_bwd = F.count_if(fwd), F.count_if(bwd)
    both = F.col("gap")
    agg = df.groupBy("flow").agg(
        F.concat_ws("_", *[first[c].cast("string") for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")]).alias("flow_id"), first["dst_port"].alias("dst_port"), first["protocol"].alias("protocol"),
        (sec * 1e6).alias("flow_duration"), n_fwd.alias("tot_fwd_pkts"), n_bwd.alias("tot_bwd_pkts"), or0(F.sum(side(fwd, length))).alias("totlen_fwd_pkts"), or0(F.sum(side(bwd, length))).alias("totlen_bwd_pkts"),
        *four(side(fwd, length), "fwd_pkt_len", ("max", "min", "mean", "std")), *four(side(bwd, length), "bwd_pkt_len", ("max", "min", "mean", "std")),
        per_second(F.sum(length)).alias("flow_byts_s"), per_second(n).alias("flow_pkts_s"),
        *four(F.when(both >= 0, both), "flow_iat", ("mean", "std", "max", "min")), *four(side(fwd, F.col("side_gap")), "fwd_iat", ("tot", "mean", "std", "max", "min")), *four(side(bwd, F.col("side_gap")), "bwd_iat", ("tot", "mean", "std", "max", "min")),
        flagged(PSH, fwd).alias("fwd_psh_flags"), flagged(PSH, bwd).alias("bwd_psh_flags"), flagged(URG, fwd).alias("fwd_urg_flags"), flagged(URG, bwd).alias("bwd_urg_flags"),
        or0(F.sum(side(fwd, header))).alias("fwd_header_len"), or0(F.sum(side(bwd, header))).alias("bwd_header_len"), per_second(n_fwd).alias("fwd_pkts_s"), per_second(n_bwd).alias("bwd_pkts_s"),
        *four(length, "pkt_len", ("min", "max", "mean", "std", "var")),
        *[flagged(flag).alias(f"{name}_flag_cnt") for name, flag in (("fin", FIN), ("syn", SYN), ("rst", RST), ("psh", PSH), ("ack", ACK), ("urg", URG), ("cwe", CWR), ("ece", ECE))],
        F.when(n_fwd > 0, n_bwd / n_fwd).otherwise(0.0).alias("down_up_ratio"), F.avg(length).alias("pkt_size_avg"), or0(F.avg(side(fwd, length))).alias("fwd_seg_size_avg"), or0(F.avg(side(bwd, length))).alias("bwd_seg_size_avg"), or0(F.sum(side(fwd, header))).alias("fwd_header_len2"),
        F.coalesce(F.min_by(side(fwd, F.col("tcp_win")), F.when(fwd & F.col("tcp_win").isNotNull(), F.col("pkt_no"))), F.lit(-1)).alias("init_fwd_win_byts"),
        F.coalesce(F.min_by(side(bwd, F.col("tcp_win")), F.when(bwd & F.col("tcp_win").isNotNull(), F.col("pkt_no"))), F.lit(-1)).alias("init_bwd_win_byts"),
        F.count_if(fwd & (F.col("app_len") > 0)).alias("fwd_act_data_pkts"), F.coalesce(F.min(F.when(fwd & (header > 0), header)), F.lit(0)).alias("fwd_seg_size_min"),
    )
    rates = bulks(df, bulk_gap_s).groupBy("flow").agg(
        *[
            c
            for name, d in (("fwd", 1), ("bwd", -1))
            for c in (
                F.max(F.when(F.col("dir") == d, F.col("bulk_bytes") / F.col("states"))).alias(f"{name}_byts_b_avg"),
                F.max(F.when(F.col("dir") == d, F.col("bulk_pkts") / F.col("states"))).alias(f"{name}_pkts_b_avg"),
                F.max(F.when((F.col("dir") == d) & (F.col("bulk_us") > 0), F.col("bulk_bytes") / (F.col("bulk_us") / 1e6))).alias(f"{name}_blk_rate_avg"),
            )
        ]
    )
    joined = agg.join(rates, "flow", "left").join(active_idle(df, active_gap_s), "flow")
    parts = F.greatest("subflows", F.lit(1))
    subflow = {f"subflow_{a}_{b}": F.col(c) / parts for a in ("fwd", "bwd") for b, c in (("pkts", f"tot_{a}_pkts"), ("byts", f"totlen_{a}_pkts"))}
    joined = joined.withColumns(subflow).withColumns({f"{a}_{b}": or0(F.col(f"{a}_{b}")) for a in ("fwd", "bwd") for b in ("byts_b_avg", "pkts_b_avg", "blk_rate_avg")})
    return joined.select("flow", *CIC_COLUMNS)


#: The columns in the order in which they are written.
CIC_COLUMNS = (
    "flow_id dst_port protocol flow_duration tot_fwd_pkts tot_bwd_pkts totlen_fwd_pkts totlen_bwd_pkts fwd_pkt_len_max fwd_pkt_len_min fwd_pkt_len_mean fwd_pkt_len_std "
    "bwd_pkt_len_max bwd_pkt_len_min bwd_pkt_len_mean bwd_pkt_len_std flow_byts_s flow_pkts_s flow_iat_mean flow_iat_std flow_iat_max flow_iat_min fwd_iat_tot fwd_iat_mean fwd_iat_std fwd_iat_max fwd_iat_min "
    "bwd_iat_tot bwd_iat_mean bwd_iat_std bwd_iat_max bwd_iat_min fwd_psh_flags bwd_psh_flags fwd_urg_flags bwd_urg_flags fwd_header_len bwd_header_len fwd_pkts_s bwd_pkts_s "
    "pkt_len_min pkt_len_max pkt_len_mean pkt_len_std pkt_len_var fin_flag_cnt syn_flag_cnt rst_flag_cnt psh_flag_cnt ack_flag_cnt urg_flag_cnt cwe_flag_cnt ece_flag_cnt "
    "down_up_ratio pkt_size_avg fwd_seg_size_avg bwd_seg_size_avg fwd_header_len2 fwd_byts_b_avg fwd_pkts_b_avg fwd_blk_rate_avg bwd_byts_b_avg bwd_pkts_b_avg bwd_blk_rate_avg "
    "subflow_fwd_pkts subflow_fwd_byts subflow_bwd_pkts subflow_bwd_byts init_fwd_win_byts init_bwd_win_byts fwd_act_data_pkts fwd_seg_size_min "
    "active_mean active_std active_max active_min idle_mean idle_std idle_max idle_min"
).split()
SEQUENCES = ("pkt_len", "pay_len", "iat_us", "hdr_len")


def cic_distributions(packets: DataFrame) -> DataFrame:
    """The 192 columns that the extension adds: four sequences, all, forward and backward, sixteen numbers each. Gaps begin with 0 and are at least 0."""
    df = _sided(with_defaults(packets))
    gap = {"all": F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)), "one": F.greatest(F.coalesce("side_gap", F.lit(0)), F.lit(0))}
    made = {"pkt_len": F.col("ip_len"), "pay_len": F.col("app_len"), "hdr_len": F.col("ip_hdr") + F.col("l4_hdr")}
    columns = []
    for seq in SEQUENCES:
        for name, cond in (("all", None), ("fwd", F.col("dir") == 1), ("bwd", F.col("dir") == -1)):
            x = made.get(seq, gap["all" if cond is None else "one"])
            columns += distribution((x if cond is None else F.when(cond, x)).cast("double"), f"{name}_{seq}")
    return df.groupBy("flow").agg(*columns)


def cic_extended(packets: DataFrame, **gaps: float) -> DataFrame:
    """All 272 columns and ``flow``. A distribution's column whose name CIC has already ends in ``_dist``."""
    more = cic_distributions(packets)
    return cic(packets, **gaps).join(more.toDF(*[f"{c}_dist" if c in CIC_COLUMNS else c for c in more.columns]), "flow")


def netflow_v5(packets: DataFrame) -> DataFrame:
    """NetFlow v5 records; what a capture can't tell is 0."""
    df = with_defaults(packets)
    us = F.max_by("ts_us", "pkt_no") - F.min_by("ts_us", "pkt_no")
    first = {a: F.min_by(c, "pkt_no").alias(a) for a, c in (("srcaddr", "src_ip"), ("dstaddr", "dst_ip"), ("srcport", "src_port"), ("dstport", "dst_port"), ("prot", "protocol"), ("tos", "tos"))}
    zero = [F.lit(0).alias(c) for c in ("input_snmp", "output_snmp", "first_ms", "src_as", "dst_as", "src_mask", "dst_mask")]
    rows = df.groupBy("flow").agg(*first.values(), F.count(F.lit(1)).alias("d_pkts"), F.sum("ip_len").alias("d_octets"), F.floor(us / 1000).cast("bigint").alias("last_ms"), F.bit_or(F.when(F.col("protocol") == 6, F.col("tcp_flags")).otherwise(0)).alias("tcp_flags"))
    return rows.select("*", F.lit("0.0.0.0").alias("nexthop"), *zero)


def ipfix(packets: DataFrame) -> DataFrame:
    """IPFIX records; dscp and ecn are the last packet's, class of service the first's, gaps in microseconds."""
    df = _sided(with_defaults(packets))
    fwd, bwd, length, tcp = F.col("dir") == 1, F.col("dir") == -1, F.col("ip_len"), F.col("protocol") == 6
    start, end = F.min_by("ts_us", "pkt_no"), F.max_by("ts_us", "pkt_no")
    sec = (end - start) / 1e6
    flags = F.when(tcp, F.col("tcp_flags")).otherwise(0)

    def rate(x: Column) -> Column:
        return F.when(sec > 0, or0(x) / sec).otherwise(0.0)

    columns = [
        F.floor(start / 1000).cast("bigint").alias("flow_start_ms"), F.floor(end / 1000).cast("bigint").alias("flow_end_ms"), start.alias("flow_start_us"), F.floor((end - start) / 1000).cast("bigint").alias("flow_dur_ms"),
        F.min_by("protocol", "pkt_no").alias("protocol"), F.min_by("tos", "pkt_no").alias("ip_class_of_service"), F.shiftright(F.max_by("tos", "pkt_no"), 2).alias("dscp"), F.max_by("tos", "pkt_no").bitwiseAND(3).alias("ecn"),
        F.min("ttl").alias("min_ttl"), F.max("ttl").alias("max_ttl"), F.min(length).alias("min_ip_total_len"), F.max(length).alias("max_ip_total_len"),
        F.count_if(fwd).alias("fwd_pkts"), F.count_if(bwd).alias("bwd_pkts"), F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)).alias("fwd_octets"), F.coalesce(F.sum(F.when(bwd, length)), F.lit(0)).alias("bwd_octets"),
        F.bit_or(flags).alias("tcp_control_bits"), F.coalesce(F.bit_or(F.when(fwd, flags)), F.lit(0)).alias("tcp_flags_fwd"), F.coalesce(F.bit_or(F.when(bwd, flags)), F.lit(0)).alias("tcp_flags_bwd"),
        *[F.count_if(tcp & has(flag)).alias(f"tcp_{name}_cnt") for name, flag in (("syn", SYN), ("fin", FIN), ("rst", RST), ("psh", PSH), ("ack", ACK), ("urg", URG), ("cwr", CWR), ("ece", ECE))],
    ]
    for name, x in (("pkt_len", length), ("fwd_pkt_len", F.when(fwd, length)), ("bwd_pkt_len", F.when(bwd, length))):
        columns += [or0(F.avg(x)).alias(f"{name}_mean"), sample_std(x).alias(f"{name}_std")]
    columns += [F.min(length).alias("pkt_len_min"), F.max(length).alias("pkt_len_max")]
    for name, x in (("iat", F.col("gap")), ("fwd_iat", F.when(fwd, F.col("side_gap"))), ("bwd_iat", F.when(bwd, F.col("side_gap")))):
        columns += [or0(F.avg(x)).alias(f"{name}_mean_us"), sample_std(x).alias(f"{name}_std_us")]
    header = F.col("ip_hdr")
    columns += [or0(F.min("gap")).alias("iat_min_us"), or0(F.max("gap")).alias("iat_max_us"), rate(F.sum(length)).alias("flow_bytes_ps"), rate(F.count(F.lit(1))).alias("flow_pkts_ps"), rate(F.sum(F.when(fwd, length))).alias("fwd_bytes_ps"), rate(F.sum(F.when(bwd, length))).alias("bwd_bytes_ps")]
    columns += [F.avg(header).alias("avg_ip_hdr_len"), or0(F.avg(F.when(fwd, header))).alias("avg_fwd_ip_hdr_len"), or0(F.avg(F.when(bwd, header))).alias("avg_bwd_ip_hdr_len")]
    return df.groupBy("flow").agg(*columns)


#: Services by port.
UDP_SERVICES = {"dns": (53, 5353, 5355), "dhcp": (67, 68), "ntp": (123,), "snmp": (161, 162), "syslog": (514,), "openvpn": (1194,), "wireguard": (51820,)}
TCP_SERVICES = {
    "ftp": (21,), "ssh": (22,), "telnet": (23,), "smtp": (25, 587), "dns": (53,), "http": (80,), "pop3": (110,), "imap": (143,), "ldap": (389,), "https": (443,), "smb": (445,), "smtps": (465,), "ldaps": (636,), "imaps": (993,), "pop3s": (995,),
    "openvpn": (1194,), "mssql": (1433,), "mysql": (3306,), "rdp": (3389,), "pgsql": (5432,), "vnc": (5900,), "redis": (6379,), "http-alt": (8080,), "https-alt": (8443,), "elasticsearch": (9200,), "mongodb": (27017,),
}


def service(protocol: Column, source: Column, target: Column) -> Column:
    """The service of a flow by its server's port: a well-known target, else a registered one unless the source is well known, else the source or the lower."""
    port = F.when((target <= 1023) | ((source > 1023) & (target <= 49151)), target).when(source <= 1023, source).otherwise(F.least(source, target))

    def named(services: dict[str, tuple[int, ...]]) -> Column:
        return F.coalesce(*[F.when(port.isin(*ports), name) for name, ports in services.items()])

    return F.when(protocol == 17, named(UDP_SERVICES)).otherwise(named(TCP_SERVICES))


def _argus_state(rows: Column) -> Column:
    """The state after all packets, folded in order, and the packet with which the handshake was first seen."""

    def step(s: Column, x: Column) -> Column:
        def on(flag: int) -> Column:
            return x["tcp_flags"].bitwiseAND(flag) != 0

        fwd, data, tcp = x["dir"] == 1, x["app_len"] > 0, x["protocol"] == 6
        syn, ack, fin, rst = on(SYN), on(ACK), on(FIN), on(RST)
        state = s["state"]
        src, dst = s["fin_src"] | (tcp & fin & fwd), s["fin_dst"] | (tcp & fin & ~fwd)
        then = (
            F.when(rst, "RST")
            .when(state == "INIT", F.when(syn & ~ack, "REQ").otherwise("INIT"))
            .when(state == "REQ", F.when(syn & ack, "ACC").when(~syn & ack & ~fin, "CON").otherwise("REQ"))
            .when(state == "ACC", F.when(~syn & ack, "CON").otherwise("ACC"))
            .when(state == "CON", F.when(fin, "FIN").when(data, "EST").otherwise("CON"))
            .when(state == "EST", F.when(fin, "FIN").otherwise("EST"))
            .when(state == "FIN", F.when(src & dst, "CLO").otherwise("FIN"))
            .otherwise(state)
        )
        seen = tcp & ~rst & (((state == "ACC") & ~syn & ack) | ((state == "CON") & data))
        udp = F.when(state == "INIT", "REQ").when(~fwd, "EST").otherwise(state)
        return F.struct(F.when(tcp, then).otherwise(udp).alias("state"), src.alias("fin_src"), dst.alias("fin_dst"), F.coalesce(s["seen_at"], F.when(seen, x["pkt_no"])).alias("seen_at"))

    empty = F.struct(F.lit("INIT").alias("state"), F.lit(False).alias("fin_src"), F.lit(False).alias("fin_dst"), F.lit(None).cast("bigint").alias("seen_at"))
    return F.aggregate(rows, empty, step)


def _argus_flags(rows: Column, seen_at: Column, direction: int) -> Column:
    """One end's flags in the order in which they first came: e from the handshake on, s SYN, S SYN-ACK, d data, f FIN, r RST, u URG (the far end's D, F, R)."""

    def mark(number: int, name: str, cond) -> Column:
        first = F.array_min(F.transform(F.filter(rows, lambda x: (x["protocol"] == 6) & (x["dir"] == direction) & cond(x)), lambda x: x["pkt_no"]))
        return F.when(first.isNotNull(), F.struct(first.alias("at"), F.lit(number).alias("n"), F.lit(name).alias("name")))

    def on(flag: int):
        return lambda x: x["tcp_flags"].bitwiseAND(flag) != 0

    d, f, r = "dfr" if direction == 1 else "DFR"
    marks = [
        mark(0, "e", lambda x: x["pkt_no"] >= seen_at), mark(1, "s", lambda x: x["tcp_flags"].bitwiseAND(SYN | ACK) == SYN), mark(2, "S", lambda x: x["tcp_flags"].bitwiseAND(SYN | ACK) == SYN | ACK),
        mark(3, d, lambda x: x["app_len"] > 0), mark(4, f, on(FIN)), mark(5, r, on(RST)), mark(6, "u", on(URG)),
    ]
    return F.array_join(F.transform(F.array_sort(F.array_compact(F.array(*marks))), lambda x: x["name"]), "")


def argus(packets: DataFrame) -> DataFrame:
    """Argus records: times, state, direction, flags, service, loads and rates, windows, sequence bases and gaps, handshake times and gap statistics in ms."""
    df = _sided(with_defaults(packets))
    fwd, bwd, tcp, length = F.col("dir") == 1, F.col("dir") == -1, F.col("protocol") == 6, F.col("ip_len")
    syn, ack = has(SYN), has(ACK)
    # Handshake: the last SYN before the first answer to one, that answer, and the first plain ACK after it.
    df = df.withColumn("syn_ts", F.last(F.when(tcp & syn & ~ack & fwd, F.col("ts_us")), ignorenulls=True).over(before()))
    df = df.withColumn("answer", tcp & syn & ack & bwd & F.col("syn_ts").isNotNull())
    df = df.withColumn("answer_ts", F.first(F.when(F.col("answer"), F.col("ts_us")), ignorenulls=True).over(before()))
    # A gap: a number below the furthest end so far, less one, in the same direction (compared as plain numbers).
    df = df.withColumn("furthest", F.max(F.pmod(F.col("tcp_seq") + F.col("app_len"), F.lit(1 << 32))).over(before("dir")))
    df = df.withColumn("behind", tcp & (F.col("tcp_seq") != 0) & (F.coalesce("furthest", F.lit(0)) != 0) & (F.col("tcp_seq") < F.col("furthest") - 1))
    start, end = F.min_by("ts_us", "pkt_no"), F.max_by("ts_us", "pkt_no")
    sec = (end - start) / 1e6
    src_pkts, dst_pkts = F.count_if(fwd), F.count_if(bwd)
    src_bytes, dst_bytes = F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)), F.coalesce(F.sum(F.when(bwd, length)), F.lit(0))
    order = F.col("pkt_no")

    def first(x: str, cond: Column, default: int | None = 0) -> Column:
        found = F.min_by(F.when(cond, F.col(x)), F.when(cond, order))
        return found if default is None else F.coalesce(found, F.lit(default))

    def rate(x: Column) -> Column:
        return F.when(sec > 0, x / sec).otherwise(0.0)

    columns = [
        start.alias("start_us"), end.alias("last_us"), sec.alias("dur"), F.min_by("src_ip", "pkt_no").alias("src_ip"), F.min_by("dst_ip", "pkt_no").alias("dst_ip"), F.min_by("src_port", "pkt_no").alias("src_port"), F.min_by("dst_port", "pkt_no").alias("dst_port"), F.min_by("protocol", "pkt_no").alias("protocol"),
        F.when((src_pkts > 0) & (dst_pkts > 0), F.when((src_bytes > src_pkts * 40) | (dst_bytes > dst_pkts * 40), "<>").otherwise("??")).when(src_pkts > 0, "->").otherwise("<-").alias("dir"),
        src_pkts.alias("src_pkts"), dst_pkts.alias("dst_pkts"), (src_pkts + dst_pkts).alias("tot_pkts"), src_bytes.alias("src_bytes"), dst_bytes.alias("dst_bytes"), (src_bytes + dst_bytes).alias("tot_bytes"),
        rate(src_pkts).alias("src_load"), rate(dst_pkts).alias("dst_load"), rate(src_bytes).alias("src_rate"), rate(dst_bytes).alias("dst_rate"),
        F.coalesce(F.max_by(F.when(fwd, F.col("tcp_win")), F.when(fwd & tcp, order)), F.lit(0)).alias("src_win"), F.coalesce(F.max_by(F.when(bwd, F.col("tcp_win")), F.when(bwd & tcp, order)), F.lit(0)).alias("dst_win"),
        first("tcp_seq", tcp & syn & fwd & (F.col("tcp_seq") != 0)).alias("src_tcp_base"), first("tcp_seq", tcp & syn & bwd & (F.col("tcp_seq") != 0)).alias("dst_tcp_base"),
        F.coalesce((first("ts_us", F.col("answer"), None) - first("syn_ts", F.col("answer"), None)) / 1000.0, F.lit(-1.0)).alias("syn_ack_rtt_ms"),
        F.coalesce((first("ts_us", tcp & ~syn & ack & fwd & F.col("answer_ts").isNotNull(), None) - F.min("answer_ts")) / 1000.0, F.lit(-1.0)).alias("ack_dat_rtt_ms"),
        F.count_if(F.col("behind") & fwd).alias("src_gap"), F.count_if(F.col("behind") & bwd).alias("dst_gap"),
        *[F.count_if(tcp & has(flag)).alias(f"{name}_cnt") for name, flag in (("syn", SYN), ("fin", FIN), ("rst", RST), ("psh", PSH), ("ack", ACK), ("urg", URG))],
        first("tos", fwd).alias("src_tos"), first("tos", bwd).alias("dst_tos"), first("ip_id", fwd).alias("src_ip_id"), first("ip_id", bwd).alias("dst_ip_id"),
        or0(F.avg(F.when(fwd, length))).alias("src_mean_pkt_sz"), or0(F.avg(F.when(bwd, length))).alias("dst_mean_pkt_sz"),
    ]
    for name, x in (("iat", F.col("gap")), ("src_iat", F.when(fwd, F.col("side_gap"))), ("dst_iat", F.when(bwd, F.col("side_gap")))):
        columns += [or0(F.avg(x / 1000.0)).alias(f"{name}_mean_ms"), sample_std(x / 1000.0).alias(f"{name}_std_ms")]
    rows = df.groupBy("flow").agg(*columns, F.array_sort(F.collect_list(F.struct("pkt_no", "tcp_flags", "dir", "app_len", "protocol"))).alias("rows"))
    rows = rows.withColumn("end", _argus_state(F.col("rows")))
    short = F.col("end.state").isin("INIT", "REQ") & (F.col("dur") < 1.0) & (F.col("tot_pkts") < 3)
    return rows.withColumns({"state": F.when(short, "INT").otherwise(F.col("end.state")), "sflgs": _argus_flags(F.col("rows"), F.col("end.seen_at"), 1), "dflgs": _argus_flags(F.col("rows"), F.col("end.seen_at"), -1), "service": service(F.col("protocol"), F.col("src_port"), F.col("dst_port"))}).drop("end", "rows")
