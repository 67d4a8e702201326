"""Flow construction: canonical keys, orientation, retransmissions, sessions, sequences.

A packet table has pkt_no (the order), ts_us, src_ip, dst_ip, src_port, dst_port, protocol, wirelen, ip_len, app_len, tcp_flags, and for TCP tcp_seq and
tcp_win. Everything is partitioned by the canonical key ``flow``, so that what follows on one flow needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128
#: Numbers of handshake messages in the sequence of TLS types.
TLS_HANDSHAKES = {1: 1, 2: 2, 11: 3, 12: 4, 13: 5, 14: 6, 15: 7, 16: 8, 20: 9, 4: 10}


def has(flag: int, column: str = "tcp_flags") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


def canonical(packets: DataFrame) -> DataFrame:
    """Adds ``flow``: both ends, the smaller (address as text, then port as number) first, and the protocol (with the VLAN and file if there are such)."""
    here, there = F.struct("src_ip", F.coalesce("src_port", F.lit(0)).alias("p")), F.struct(F.col("dst_ip").alias("src_ip"), F.coalesce("dst_port", F.lit(0)).alias("p"))
    swap = here > there
    lo, hi = F.when(swap, there).otherwise(here), F.when(swap, here).otherwise(there)
    parts = [F.concat_ws(":", lo["src_ip"], lo["p"].cast("string")), F.lit("-"), F.concat_ws(":", hi["src_ip"], hi["p"].cast("string")), F.lit("/"), F.col("protocol").cast("string")]
    if "vlan_id" in packets.columns:
        parts.append(F.when(F.col("vlan_id") > 0, F.concat(F.lit("@"), F.col("vlan_id").cast("string"))).otherwise(""))
    if "file" in packets.columns:
        parts += [F.lit("#"), F.col("file")]
    return packets.withColumn("flow", F.concat(*parts))


def in_order(*more: str) -> WindowSpec:
    return Window.partitionBy("flow", *more).orderBy("pkt_no")


def so_far(*more: str) -> WindowSpec:
    return in_order(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(*more: str) -> WindowSpec:
    return in_order(*more).rowsBetween(Window.unboundedPreceding, -1)


def oriented(packets: DataFrame, rule: str = "ends") -> DataFrame:
    """Adds flow, idx (from 1) and dir (1: like the first packet, else -1).

    Rules: ``ends`` compares address and port of the sender, ``address`` the sender's address alone, ``exact`` both ends.
    """
    keyed = packets if "flow" in packets.columns else canonical(packets)
    columns = {"ends": ["src_ip", "src_port"], "address": ["src_ip"], "exact": ["src_ip", "src_port", "dst_ip", "dst_port"]}[rule]
    ends = F.struct(*columns)
    return keyed.withColumn("idx", F.row_number().over(in_order())).withColumn("dir", F.when(F.first(ends).over(so_far()) == ends, 1).otherwise(-1))


def without_resets(packets: DataFrame) -> DataFrame:
    return packets.filter((F.col("protocol") != 6) | ~has(RST))


def without_bare_acks(packets: DataFrame) -> DataFrame:
    """Drops packets whose only flag is ACK, without data (and without options, where the table has them)."""
    bare = (F.col("protocol") == 6) & (F.col("tcp_flags") == ACK) & (F.col("app_len") == 0)
    if "tcp_options" in packets.columns:
        bare = bare & (F.coalesce(F.length("tcp_options"), F.lit(0)) == 0)
    return packets.filter(~F.coalesce(bare, F.lit(False)))


def retransmissions(packets: DataFrame) -> DataFrame:
    """Adds is_retrans to oriented packets.

    A segment's length is its data plus one for SYN and one for FIN; segments of length 0 never count. Sequence numbers are unwrapped by their signed
    32-bit distance from the first end in their direction (exact while a stream spans less than 2 GiB). A segment is sent again if its end is not
    beyond the furthest end before it; keep-alives (at most one byte, no SYN or FIN, ending where the stream stands) don't count.
    """
    mark = F.when(has(SYN), 1).otherwise(0) + F.when(has(FIN), 1).otherwise(0)
    length = F.when(F.col("protocol") == 6, F.col("app_len") + mark).otherwise(0)
    df = packets.withColumn("seg_len", length).withColumn("counts", F.col("seg_len") > 0)
    end = F.when(F.col("counts"), F.col("tcp_seq") + F.col("seg_len"))
    wrap = 1 << 32
    df = df.withColumn("seq_end", end).withColumn("first_end", F.first("seq_end", ignorenulls=True).over(so_far("dir")))
    away = F.pmod(F.col("seq_end") - F.col("first_end") + (wrap >> 1), F.lit(wrap)) - (wrap >> 1)
    df = df.withColumn("away", away).withColumn("furthest", F.max("away").over(before("dir")))
    keep_alive = (F.col("app_len") <= 1) & ~has(SYN) & ~has(FIN) & (F.col("away") - F.col("seg_len") == F.col("furthest") - 1)
    again = F.col("counts") & F.col("furthest").isNotNull() & ~keep_alive & (F.col("away") <= F.col("furthest"))
    return df.withColumn("is_retrans", F.coalesce(again, F.lit(False))).drop("seg_len", "counts", "seq_end", "first_end", "away", "furthest")


def udp_sessions(packets: DataFrame, timeout_s: float) -> DataFrame:
    """Adds session (from 0) within ``flow``: a UDP packet later than the latest time so far by more than the timeout begins a new one."""
    gap = (F.col("protocol") == 17) & (F.col("ts_us") - F.max("ts_us").over(before()) > F.lit(int(timeout_s * 1e6)))
    return packets.withColumn("session", F.sum(F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(so_far()))


def limited(packets: DataFrame, n: int, rechunk: bool = True) -> DataFrame:
    """The per-flow packet limit (0: none). ``rechunk``: packets beyond it begin a new row of the flow (column chunk, part of the flow's name);
    else they are dropped."""
    if n <= 0:
        return packets
    keyed = packets if "flow" in packets.columns else canonical(packets)
    number = F.row_number().over(in_order())
    if not rechunk:
        return keyed.withColumn("n_in_flow", number).filter(F.col("n_in_flow") <= n).drop("n_in_flow")
    return keyed.withColumn("chunk", F.floor((number - 1) / n)).withColumn("flow", F.concat("flow", F.lit("%"), F.col("chunk").cast("string")))


def sequences(packets: DataFrame) -> DataFrame:
    """Signed sequences by flow, in order: packet, ip and app lengths times direction, times, inter-arrival times, and for TCP flags and windows."""
    tcp = F.col("protocol") == 6
    row = F.struct("pkt_no", (F.col("wirelen") * F.col("dir")).alias("p"), (F.col("ip_len") * F.col("dir")).alias("i"), (F.col("app_len") * F.col("dir")).alias("a"), "ts_us", F.when(tcp, F.col("tcp_flags")).alias("f"), F.when(tcp, F.col("tcp_win")).alias("w"))
    rows = packets.groupBy("flow").agg(F.array_sort(F.collect_list(row)).alias("r"))
    times = F.transform("r", lambda x: x["ts_us"])
    gaps = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b - a)
    return rows.select(
        "flow", F.transform("r", lambda x: x["p"]).alias("packet_lengths"), F.transform("r", lambda x: x["i"]).alias("ip_lengths"), F.transform("r", lambda x: x["a"]).alias("app_lengths"), times.alias("timestamps_us"), gaps.alias("iats_us"),
        F.filter(F.transform("r", lambda x: x["f"]), lambda v: v.isNotNull()).alias("tcp_flags"), F.filter(F.transform("r", lambda x: x["w"]), lambda v: v.isNotNull()).alias("tcp_window_sizes"),
    )


def bursts(packets: DataFrame) -> DataFrame:
    """Runs of one direction, signed, in order: flow, burst."""
    change = F.when(F.lag("dir").over(in_order()) == F.col("dir"), 0).otherwise(1)
    runs = packets.withColumn("change", change).withColumn("run", F.sum("change").over(so_far()))
    return runs.groupBy("flow", "run").agg(F.sum("dir").alias("n")).groupBy("flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "n"))), lambda x: x["n"]).alias("burst"))


def tls_type(payload: Column) -> Column:
    """What a payload's first bytes say of TLS, as a number: 0 nothing, 1 to 10 a handshake's kind, 11 to 14 other records, 15 another handshake."""
    record, version, kind = (F.conv(F.hex(F.substring(payload, at, n)), 16, 10).cast("int") for at, n in ((1, 1), (2, 2), (6, 1)))
    handshake = F.coalesce(*[F.when(kind == number, value) for number, value in TLS_HANDSHAKES.items()], F.lit(15))
    known = F.when(record == 22, handshake).when(record == 20, 11).when(record == 21, 12).when(record == 23, 13).when(record == 24, 14)
    return F.when((F.length(payload) >= 6) & version.between(0x0200, 0x0305), F.coalesce(known, F.lit(0))).otherwise(0)


def plain_sequences(packets: DataFrame) -> DataFrame:
    """Sequences by flow, in order, with direction by the sender's address: direction, pkt_len, pay_len, iat_us, ts_rel_us (both at least 0), tcp_flags and,
    where there are payloads, tls_type; the first and last time and the number of packets."""
    df = oriented(packets, "address")
    gap, rel = F.greatest(F.coalesce(F.col("ts_us") - F.lag("ts_us").over(in_order()), F.lit(0)), F.lit(0)), F.greatest(F.col("ts_us") - F.first("ts_us").over(so_far()), F.lit(0))
    lists = {"direction": F.col("dir"), "pkt_len": F.col("ip_len"), "pay_len": F.col("app_len"), "iat_us": F.col("iat_us"), "ts_rel_us": F.col("ts_rel_us"), "tcp_flags": F.col("tcp_flags")}
    if "payload" in packets.columns:
        lists["tls_type"] = F.when(F.col("protocol") == 6, tls_type(F.col("payload"))).otherwise(0)
    row = F.struct("pkt_no", *[c.alias(n) for n, c in lists.items()])
    agg = df.withColumn("iat_us", gap).withColumn("ts_rel_us", rel).groupBy("flow").agg(F.array_sort(F.collect_list(row)).alias("r"), F.min_by("ts_us", "pkt_no").alias("first_us"), F.max_by("ts_us", "pkt_no").alias("last_us"), F.count(F.lit(1)).alias("n_pkts"))

    def each(name: str) -> Column:
        return F.transform("r", lambda x: x[name])

    return agg.select("flow", "first_us", "last_us", "n_pkts", *[each(n).alias(n) for n in lists])


def unified_sequences(packets: DataFrame) -> DataFrame:
    """Sequences of both families in one row of a flow: signed ones without retransmissions, and those of all IPv4 TCP and UDP packets with direction by
    address. A flow may be in one of them alone; times and counts are the second's."""
    signed = sequences(retransmissions(oriented(packets)).filter(~F.col("is_retrans")))
    plain = plain_sequences(packets.filter(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":")))
    return signed.drop("tcp_flags").join(plain, "flow", "full_outer")


def tcp_states(packets: DataFrame) -> DataFrame:
    """Each direction's TCP state after all packets of a flow, and whether the connection is closed."""

    def fold(state: Column, flags: Column) -> Column:
        def on(flag: int) -> Column:
            return flags.bitwiseAND(flag) != 0

        return (
            F.when(on(RST), "RESET")
            .when(on(SYN) & on(ACK), "ESTABLISHED")
            .when(on(SYN), "SYN_SENT")
            .when(on(FIN) & (state == "ESTABLISHED"), "FIN_WAIT_1")
            .when(on(FIN) & (state == "FIN_WAIT_1"), "FIN_WAIT_2")
            .when(~on(FIN) & on(ACK) & (state == "FIN_WAIT_1"), "FIN_WAIT_2")
            .otherwise(state)
        )

    rows = packets.filter(F.col("protocol") == 6).groupBy("flow", "dir").agg(F.array_sort(F.collect_list(F.struct("pkt_no", "tcp_flags"))).alias("r"))
    states = rows.select("flow", "dir", F.aggregate("r", F.lit("CLOSED"), lambda s, x: fold(s, x["tcp_flags"])).alias("state"))
    both = states.groupBy("flow").agg(F.coalesce(F.max(F.when(F.col("dir") == 1, F.col("state"))), F.lit("CLOSED")).alias("up_state"), F.coalesce(F.max(F.when(F.col("dir") == -1, F.col("state"))), F.lit("CLOSED")).alias("down_state"))
    ended = ["FIN_WAIT_2", "CLOSED", "TIME_WAIT"]
    return both.withColumn("closed", F.col("up_state").isin(ended) & F.col("down_state").isin(ended))
