"""Queries over the packet view of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters
from ..functions.stats import array_stats
from ..operators import features, flows
from ..sources import views

#: Seconds; the view's packets are minutes apart.
HOUR = 3600.0

FLOW_SQL = (
    "WITH "
    + views.EVENTS_SQL
    + """, fk AS (
  SELECT *, CASE WHEN src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port)
                 THEN concat(dst_ip, ':', CAST(dst_port AS VARCHAR), '-', src_ip, ':', CAST(src_port AS VARCHAR))
                 ELSE concat(src_ip, ':', CAST(src_port AS VARCHAR), '-', dst_ip, ':', CAST(dst_port AS VARCHAR)) END || '/' || CAST(protocol AS VARCHAR) AS flow
  FROM pk
), o AS (
  SELECT *, row_number() OVER w AS idx, CASE WHEN first_value(src_ip) OVER w = src_ip AND first_value(src_port) OVER w = src_port THEN 1 ELSE -1 END AS dir
  FROM fk WINDOW w AS (PARTITION BY flow ORDER BY pkt_no)
)
"""
)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets_from_events(views.table(spark, sf_dir, "events"))


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.oriented(packets(spark, sf_dir))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- metrics ----


def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = F.col("dir") == 1, F.col("dir") == -1
    return oriented(spark, sf_dir).groupBy("flow").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("wirelen").alias("byte_count"), F.count_if(up).alias("up_packets"), F.count_if(down).alias("down_packets"),
        F.coalesce(F.sum(F.when(up, F.col("wirelen"))), F.lit(0)).alias("up_bytes"), F.coalesce(F.sum(F.when(down, F.col("wirelen"))), F.lit(0)).alias("down_bytes"),
        F.min_by("ts_us", "pkt_no").alias("start_us"), F.max("ts_us").alias("end_us"), (F.max("ts_us") - F.min_by("ts_us", "pkt_no")).alias("duration_us"), F.lit(0).alias("out_of_order_count"),
    )


FLOW_METRICS = (
    FLOW_SQL
    + """SELECT flow, count(*) AS packet_count, CAST(sum(wirelen) AS BIGINT) AS byte_count, count(*) FILTER (dir = 1) AS up_packets, count(*) FILTER (dir = -1) AS down_packets,
  CAST(coalesce(sum(wirelen) FILTER (dir = 1), 0) AS BIGINT) AS up_bytes, CAST(coalesce(sum(wirelen) FILTER (dir = -1), 0) AS BIGINT) AS down_bytes,
  arg_min(ts_us, pkt_no) AS start_us, max(ts_us) AS end_us, max(ts_us) - arg_min(ts_us, pkt_no) AS duration_us, 0 AS out_of_order_count FROM o GROUP BY flow"""
)


def flow_direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oriented(spark, sf_dir).select("pkt_no", "flow", "idx", "dir")


FLOW_DIRECTION_SPLIT = FLOW_SQL + "SELECT pkt_no, flow, idx, dir FROM o"


def flow_tcp_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tcp = oriented(spark, sf_dir).filter("protocol = 6")
    return tcp.groupBy("flow").agg(*[F.count_if(flows.has(flag)).alias(f"{n}_count") for n, flag in (("syn", 2), ("fin", 1), ("rst", 4), ("ack", 16), ("psh", 8), ("urg", 32))], F.min(F.nullif("tcp_win", F.lit(0))).alias("min_window"), F.max("tcp_win").alias("max_window"), F.sum("tcp_win").alias("sum_window"))


FLOW_TCP_FLAG_COUNTS = (
    FLOW_SQL
    + """SELECT flow, count(*) FILTER (tcp_flags & 2 <> 0) AS syn_count, count(*) FILTER (tcp_flags & 1 <> 0) AS fin_count, count(*) FILTER (tcp_flags & 4 <> 0) AS rst_count,
  count(*) FILTER (tcp_flags & 16 <> 0) AS ack_count, count(*) FILTER (tcp_flags & 8 <> 0) AS psh_count, count(*) FILTER (tcp_flags & 32 <> 0) AS urg_count,
  min(nullif(tcp_win, 0)) AS min_window, max(tcp_win) AS max_window, CAST(sum(tcp_win) AS BIGINT) AS sum_window FROM o WHERE protocol = 6 GROUP BY flow"""
)

#: The eight sequences that statistics are taken of; payload counts TCP alone.
STAT_SEQUENCES = {
    "packet_lengths": "wirelen * dir", "ip_lengths": "ip_len * dir", "trans_lengths": "(app_len + CASE WHEN protocol = 17 THEN 8 ELSE 20 END) * dir", "app_lengths": "app_len * dir",
    "iats": "gap", "payload_bytes": "CASE WHEN protocol = 6 THEN app_len * dir ELSE 0 END", "tcp_flags": "CASE WHEN protocol = 6 THEN tcp_flags END", "tcp_window": "CASE WHEN protocol = 6 THEN tcp_win END",
}


def _stats_sql(x: str) -> str:
    def four(p: str, f: str) -> str:
        s, q, n = f"CAST(sum(CAST({p} AS HUGEINT)) {f} AS DOUBLE)", f"CAST(sum(CAST({p} AS HUGEINT) * {p}) {f} AS DOUBLE)", f"count({p}) {f}"
        return f"{s} / {n}", f"greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0.0)", s, n

    p = f"abs({x})"
    mean, var, total, n = four(p, "")
    out = [f"round({mean}, 6) AS mean", f"round(sqrt({var}), 6) AS std", f"round({var}, 4) AS var", f"CAST(min({p}) AS DOUBLE) AS min", f"CAST(max({p}) AS DOUBLE) AS max", f"CAST(max({p}) - min({p}) AS DOUBLE) AS range", f"CAST(median({p}) AS DOUBLE) AS median", f"{total} AS sum", f"{n} AS count"]
    for side, sign in (("up", ">"), ("down", "<")):
        f = f"FILTER ({x} {sign} 0)"
        m, v, s, k = four(p, f)
        out += [f"coalesce(round({m}, 6), 0.0) AS {side}_mean", f"coalesce(CASE WHEN {k} > 1 THEN round(sqrt({v}), 6) END, 0.0) AS {side}_std", f"CAST(coalesce(min({p}) {f}, 0) AS DOUBLE) AS {side}_min", f"CAST(coalesce(max({p}) {f}, 0) AS DOUBLE) AS {side}_max", f"coalesce({s}, 0.0) AS {side}_sum", f"{k} AS {side}_count"]
    return ", ".join(out)


def _gapped(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(flows.in_order()))


GAPPED = FLOW_SQL.rstrip() + ", g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY pkt_no) AS gap FROM o)\n"


def _stats_of(df: DataFrame, x: Column) -> DataFrame:
    out = df.withColumn("x", x).filter("x is not null").groupBy("flow").agg(*array_stats(F.col("x")))
    return rounded(rounded(out, 6, "mean", "std", "up_mean", "up_std", "down_mean", "down_std"), 4, "var")


def _iat_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, 0, "mean", "std", "up_mean", "up_std", "down_mean", "down_std").drop("var")


def flow_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_of(oriented(spark, sf_dir), F.expr(STAT_SEQUENCES["packet_lengths"]))


FLOW_LEN_STATS = FLOW_SQL + f"SELECT flow, {_stats_sql(STAT_SEQUENCES['packet_lengths'])} FROM o GROUP BY flow"


def flow_iat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iat_rounded(_gapped(oriented(spark, sf_dir)).filter("gap is not null").groupBy("flow").agg(*array_stats(F.col("gap"))))


FLOW_IAT_STATS = GAPPED + "SELECT flow, " + _stats_sql("gap").replace(", 6) AS", ", 0) AS").replace(", 6), 0.0)", ", 0), 0.0)").replace(", 6) END", ", 0) END") + " FROM g WHERE gap IS NOT NULL GROUP BY flow"
FLOW_IAT_STATS = "SELECT * EXCLUDE (var) FROM (" + FLOW_IAT_STATS + ")"


def flow_all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight sequences in one pass: packets are turned into (sequence, value) rows, then aggregated once."""
    df = _gapped(oriented(spark, sf_dir))
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("sequence"), F.expr(x).cast("bigint").alias("x")) for name, x in STAT_SEQUENCES.items() if name != "iats"]))
    out = df.select("flow", values.alias("v")).select("flow", "v.*").filter("x is not null").groupBy("flow", "sequence").agg(*array_stats(F.col("x")))
    return rounded(rounded(out, 6, "mean", "std", "up_mean", "up_std", "down_mean", "down_std"), 4, "var")


FLOW_ALL_STATS = FLOW_SQL.rstrip() + ", v AS (" + " UNION ALL ".join(f"SELECT flow, '{n}' AS sequence, CAST({x} AS BIGINT) AS x FROM o" for n, x in STAT_SEQUENCES.items() if n != "iats") + f") SELECT flow, sequence, {_stats_sql('x')} FROM v WHERE x IS NOT NULL GROUP BY flow, sequence"


def flow_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = F.col("dir") == 1, F.col("dir") == -1
    ub, db = F.coalesce(F.sum(F.when(up, F.col("wirelen"))), F.lit(0)), F.coalesce(F.sum(F.when(down, F.col("wirelen"))), F.lit(0))
    out = _gapped(oriented(spark, sf_dir)).groupBy("flow").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("wirelen").alias("total_bytes"), F.coalesce(F.sum(F.abs("gap")), F.lit(0)).alias("duration_us"),
        F.when(F.count_if(down) > 0, F.count_if(up) / F.count_if(down)).otherwise(0.0).alias("up_down_pkt_ratio"), F.when(db > 0, ub / db).otherwise(0.0).alias("up_down_byte_ratio"),
        F.lit(0.0).alias("pkt_skew"), F.lit(0.0).alias("pkt_kurt"), F.lit(0.0).alias("pkt_cv"),
    )
    return rounded(out, 6, "up_down_pkt_ratio", "up_down_byte_ratio")


FLOW_RATIOS = (
    GAPPED
    + """SELECT flow, count(*) AS packet_count, CAST(sum(wirelen) AS BIGINT) AS total_bytes, CAST(coalesce(sum(abs(gap)), 0) AS BIGINT) AS duration_us,
  round(CASE WHEN count(*) FILTER (dir = -1) > 0 THEN CAST(count(*) FILTER (dir = 1) AS DOUBLE) / count(*) FILTER (dir = -1) ELSE 0.0 END, 6) AS up_down_pkt_ratio,
  round(CASE WHEN coalesce(sum(wirelen) FILTER (dir = -1), 0) > 0 THEN CAST(coalesce(sum(wirelen) FILTER (dir = 1), 0) AS DOUBLE) / sum(wirelen) FILTER (dir = -1) ELSE 0.0 END, 6) AS up_down_byte_ratio,
  CAST(0 AS DOUBLE) AS pkt_skew, CAST(0 AS DOUBLE) AS pkt_kurt, CAST(0 AS DOUBLE) AS pkt_cv FROM g GROUP BY flow"""
)


# ---- filters ----

FILTERS = {
    "filter_tcp": ("tcp", "protocol = 6"),
    "filter_udp": ("udp", "protocol = 17"),
    "filter_port": ("port 443", "protocol IN (6, 17) AND (src_port = 443 OR dst_port = 443)"),
    "filter_src_port": ("src port 53", "protocol IN (6, 17) AND src_port = 53"),
    "filter_dst_port": ("dst port 8080", "protocol IN (6, 17) AND dst_port = 8080"),
    "filter_host": ("host 10.0.0.7", "src_ip = '10.0.0.7' OR dst_ip = '10.0.0.7'"),
    "filter_not": ("not tcp", "NOT (protocol = 6)"),
    "filter_group": ("(tcp or udp) and not port 443", "(protocol = 6 OR protocol = 17) AND NOT (src_port = 443 OR dst_port = 443)"),
    "filter_layer": ("dns or dst 10.0.0.9", "(protocol = 17 AND (src_port = 53 OR dst_port = 53)) OR dst_ip = '10.0.0.9'"),
}


def _filter_query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = packets(spark, sf_dir)
        return df.filter(filters.packet_filter(text, df.columns, None)).select("pkt_no", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")

    return run


def filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default filter with resets and bare acknowledgements dropped, and flows of at least five packets kept."""
    df = packets(spark, sf_dir)
    kept = flows.without_bare_acks(flows.without_resets(df.filter(filters.packet_filter(None, df.columns))))
    return flows.canonical(kept).groupBy("flow").agg(F.count(F.lit(1)).alias("packet_count")).filter("packet_count >= 5")


FILTER_DEFAULT = FLOW_SQL + "SELECT flow, count(*) AS packet_count FROM fk WHERE NOT (protocol = 6 AND (tcp_flags & 4 <> 0 OR (tcp_flags = 16 AND app_len = 0))) AND protocol NOT IN (1, 58) GROUP BY flow HAVING count(*) >= 5"


# ---- order within flows ----


def _tcp_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.retransmissions(oriented(spark, sf_dir))


def retrans_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tcp_in_order(spark, sf_dir).select("pkt_no", "flow", "is_retrans")


_RETRANS = (
    FLOW_SQL.rstrip()
    + """, r0 AS (
  SELECT *, CASE WHEN protocol = 6 THEN app_len + CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END ELSE 0 END AS seg_len FROM o
), r1 AS (
  SELECT *, max(CASE WHEN seg_len > 0 THEN tcp_seq + seg_len END) OVER (PARTITION BY flow, dir ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM r0
), r2 AS (
  SELECT *, coalesce(seg_len > 0 AND furthest IS NOT NULL AND tcp_seq + seg_len <= furthest
            AND NOT (app_len <= 1 AND tcp_flags & 3 = 0 AND tcp_seq = furthest - 1), FALSE) AS is_retrans FROM r1
)
"""
)
RETRANS_FLAG = _RETRANS + "SELECT pkt_no, flow, is_retrans FROM r2"


def retrans_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tcp_in_order(spark, sf_dir).groupBy("flow").agg(F.count_if("is_retrans").alias("retrans_count"), F.count_if(~F.col("is_retrans")).alias("packet_count"))


RETRANS_FILTERED_COUNTS = _RETRANS + "SELECT flow, count(*) FILTER (is_retrans) AS retrans_count, count(*) FILTER (NOT is_retrans) AS packet_count FROM r2 GROUP BY flow"


def udp_timeout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of three hours; each has its own orientation."""
    split = flows.udp_sessions(flows.canonical(packets(spark, sf_dir)), 3 * HOUR)
    split = split.withColumn("flow", F.concat("flow", F.lit("+"), F.col("session").cast("string")))
    return flows.oriented(split).groupBy("flow").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("dir") == 1).alias("up_packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


UDP_TIMEOUT_SESSIONS = (
    FLOW_SQL.rstrip()
    + """, s0 AS (
  SELECT *, CASE WHEN protocol = 17 AND ts_us - max(ts_us) OVER (PARTITION BY flow ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10800000000 THEN 1 ELSE 0 END AS cut FROM fk
), s1 AS (SELECT *, concat(flow, '+', CAST(sum(cut) OVER (PARTITION BY flow ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS sflow FROM s0
), s2 AS (SELECT *, first_value(src_ip) OVER w = src_ip AND first_value(src_port) OVER w = src_port AS up FROM s1 WINDOW w AS (PARTITION BY sflow ORDER BY pkt_no))
SELECT sflow AS flow, count(*) AS packets, count(*) FILTER (up) AS up_packets, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s2 GROUP BY sflow"""
)


def cic_active_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.active_idle(oriented(spark, sf_dir), 3 * HOUR), 0, "active_mean", "active_std", "idle_mean", "idle_std")


def _four_sql(x: str, name: str, digits: int = 0) -> str:
    return f"coalesce(round(avg({x}), {digits}), 0.0) AS {name}_mean, coalesce(CASE WHEN count({x}) > 1 THEN round(stddev_samp({x}), {digits}) END, 0.0) AS {name}_std, CAST(coalesce(max({x}), 0) AS DOUBLE) AS {name}_max, CAST(coalesce(min({x}), 0) AS DOUBLE) AS {name}_min"


def _active_sql(gap_us: int) -> str:
    return f""", a0 AS (SELECT *, coalesce(gap > {gap_us}, FALSE) AS cut FROM g
), a1 AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS period FROM a0
), a2 AS (SELECT flow, period, nullif(greatest(arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no), 0), 0) AS active, max(gap) FILTER (cut) AS idle FROM a1 GROUP BY flow, period
), a3 AS (SELECT flow, count(*) AS subflows, {_four_sql("active", "active")}, {_four_sql("idle", "idle")} FROM a2 GROUP BY flow)
"""


CIC_ACTIVE_IDLE = GAPPED.rstrip() + _active_sql(10_800_000_000) + "SELECT * FROM a3"


def bulk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.bulks(oriented(spark, sf_dir), 24 * HOUR, 2)


def _bulk_sql(gap_us: int, least: int) -> str:
    return f""", b0 AS (
  SELECT *, CASE WHEN dir = 1 THEN last_value(CASE WHEN dir = -1 THEN ts_us END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN dir = 1 THEN ts_us END IGNORE NULLS) OVER w END AS other_ts
  FROM o WINDOW w AS (PARTITION BY flow ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b1 AS (SELECT *, lag(ts_us) OVER (PARTITION BY flow, dir ORDER BY pkt_no) AS last_ts FROM b0 WHERE app_len > 0
), b2 AS (SELECT *, sum(CASE WHEN last_ts IS NULL OR ts_us - last_ts > {gap_us} OR coalesce(other_ts > last_ts, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY flow, dir ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS run FROM b1
), b3 AS (SELECT flow, dir, run, count(*) AS n, sum(app_len) AS bytes, arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no) AS us FROM b2 GROUP BY flow, dir, run HAVING count(*) >= {least}
), b4 AS (SELECT flow, dir, count(*) AS states, CAST(sum(n) AS BIGINT) AS bulk_pkts, CAST(sum(bytes) AS BIGINT) AS bulk_bytes, CAST(sum(greatest(us, 0)) AS BIGINT) AS bulk_us FROM b3 GROUP BY flow, dir)
"""


BULK_RUNS = FLOW_SQL.rstrip() + _bulk_sql(86_400_000_000, 2) + "SELECT * FROM b4"


def burst_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.bursts(oriented(spark, sf_dir)).select("flow", F.array_join(F.transform("burst", lambda x: x.cast("string")), ",").alias("burst"), F.size("burst").cast("bigint").alias("n_bursts"))


BURST_RLE = (
    FLOW_SQL.rstrip()
    + """, u0 AS (SELECT *, CASE WHEN lag(dir) OVER (PARTITION BY flow ORDER BY pkt_no) = dir THEN 0 ELSE 1 END AS change FROM o
), u1 AS (SELECT *, sum(change) OVER (PARTITION BY flow ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS run FROM u0
), u2 AS (SELECT flow, run, CAST(sum(dir) AS BIGINT) AS n FROM u1 GROUP BY flow, run)
SELECT flow, string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS burst, count(*) AS n_bursts FROM u2 GROUP BY flow"""
)


def seq_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction by the sender's address; gaps and times at least 0, in microseconds."""
    rows = flows.plain_sequences(packets(spark, sf_dir))
    return rows.select("flow", "n_pkts", *[F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in ("direction", "pkt_len", "pay_len", "iat_us", "ts_rel_us", "tcp_flags")])


def _agg(x: str) -> str:
    return f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY pkt_no)"


SEQ_ARRAYS = (
    FLOW_SQL.rstrip()
    + f""", q AS (
  SELECT *, CASE WHEN first_value(src_ip) OVER w = src_ip THEN 1 ELSE -1 END AS adir, greatest(coalesce(ts_us - lag(ts_us) OVER w, 0), 0) AS iat, greatest(ts_us - first_value(ts_us) OVER w, 0) AS rel
  FROM fk WINDOW w AS (PARTITION BY flow ORDER BY pkt_no))
SELECT flow, count(*) AS n_pkts, {_agg("adir")} AS direction, {_agg("ip_len")} AS pkt_len, {_agg("app_len")} AS pay_len, {_agg("iat")} AS iat_us, {_agg("rel")} AS ts_rel_us, {_agg("tcp_flags")} AS tcp_flags FROM q GROUP BY flow"""
)


def flow_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of ten packets a row: later ones begin new rows with their own direction."""
    df = flows.oriented(flows.limited(packets(spark, sf_dir), 10))
    return df.groupBy("flow").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("dir") == 1).alias("up_packets"), F.sum("ip_len").alias("bytes"))


FLOW_CHUNKS = (
    FLOW_SQL.rstrip()
    + """, c0 AS (SELECT *, concat(flow, '%', CAST((row_number() OVER (PARTITION BY flow ORDER BY pkt_no) - 1) // 10 AS VARCHAR)) AS cflow FROM fk
), c1 AS (SELECT *, first_value(src_ip) OVER w = src_ip AND first_value(src_port) OVER w = src_port AS up FROM c0 WINDOW w AS (PARTITION BY cflow ORDER BY pkt_no))
SELECT cflow AS flow, count(*) AS packets, count(*) FILTER (up) AS up_packets, CAST(sum(ip_len) AS BIGINT) AS bytes FROM c1 GROUP BY cflow"""
)


def tcp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.tcp_states(oriented(spark, sf_dir))


# The state machine without recursion: with one direction's packets in order, RST, SYN and SYN-ACK set the state whatever it was; from the last of
# them on, FIN steps and plain ACKs are counted.
TCP_STATES = (
    FLOW_SQL.rstrip()
    + """, t0 AS (
  SELECT *, CASE WHEN tcp_flags & 4 <> 0 THEN 'RESET' WHEN tcp_flags & 18 = 18 THEN 'ESTABLISHED' WHEN tcp_flags & 2 <> 0 THEN 'SYN_SENT' END AS sets FROM o WHERE protocol = 6
), t1 AS (SELECT flow, dir, max(pkt_no) FILTER (sets IS NOT NULL) AS at, arg_max(sets, pkt_no) FILTER (sets IS NOT NULL) AS base FROM t0 GROUP BY flow, dir
), t2 AS (SELECT t0.flow, t0.dir, min(t0.pkt_no) FILTER (t0.tcp_flags & 1 <> 0) AS fin_at FROM t0 JOIN t1 USING (flow, dir) WHERE t0.pkt_no > coalesce(t1.at, -1) GROUP BY t0.flow, t0.dir
), t3 AS (
  SELECT t1.flow, t1.dir, CASE WHEN t1.base = 'ESTABLISHED' AND t2.fin_at IS NOT NULL
      THEN CASE WHEN EXISTS (SELECT 1 FROM t0 x WHERE x.flow = t1.flow AND x.dir = t1.dir AND x.pkt_no > t2.fin_at AND x.tcp_flags & 17 <> 0) THEN 'FIN_WAIT_2' ELSE 'FIN_WAIT_1' END
      ELSE coalesce(t1.base, 'CLOSED') END AS state
  FROM t1 LEFT JOIN t2 USING (flow, dir)
), t4 AS (SELECT flow, coalesce(max(state) FILTER (dir = 1), 'CLOSED') AS up_state, coalesce(max(state) FILTER (dir = -1), 'CLOSED') AS down_state FROM t3 GROUP BY flow)
SELECT *, up_state IN ('FIN_WAIT_2', 'CLOSED', 'TIME_WAIT') AND down_state IN ('FIN_WAIT_2', 'CLOSED', 'TIME_WAIT') AS closed FROM t4"""
)


# ---- feature vectors ----

#: Digits that a column is rounded to; others in microseconds to whole ones.
CIC_DIGITS = {c: 6 for c in features.CIC_COLUMNS if c.endswith(("_s", "_ratio", "_avg")) or "len_" in c and c.endswith(("mean", "std", "var")) or c.startswith("subflow")} | {c: 0 for c in features.CIC_COLUMNS if "iat" in c or c.startswith(("active", "idle")) or c == "flow_duration"}
CIC_DIGITS["pkt_len_var"] = 4


def cic_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.cic(flows.oriented(packets(spark, sf_dir), "exact"), 3 * HOUR, 24 * HOUR)
    for digits in set(CIC_DIGITS.values()):
        out = rounded(out, digits, *[c for c, d in CIC_DIGITS.items() if d == digits])
    return out


def _cic_sql() -> str:
    def f(cond: str, x: str = "ip_len") -> str:
        return f"CASE WHEN {cond} THEN {x} END"

    fwd, bwd, hdr = "dir = 1", "dir = -1", "(20 + CASE WHEN protocol = 17 THEN 8 ELSE 20 END)"
    sec = "((arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no)) / 1e6)"

    def stats(x: str, name: str, digits: int, more: str = "") -> str:
        out = _four_sql(x, name, digits)
        if "tot" in more:
            out += f", CAST(coalesce(sum({x}), 0) AS DOUBLE) AS {name}_tot"
        if "var" in more:
            out += f", coalesce(CASE WHEN count({x}) > 1 THEN round(var_samp({x}), 4) END, 0.0) AS {name}_var"
        return out

    def rate(x: str) -> str:
        return f"coalesce(round(CASE WHEN {sec} > 0 THEN {x} / {sec} ELSE 0.0 END, 6), 0.0)"

    cols = [
        "concat_ws('_', arg_min(src_ip, pkt_no), CAST(arg_min(src_port, pkt_no) AS VARCHAR), arg_min(dst_ip, pkt_no), CAST(arg_min(dst_port, pkt_no) AS VARCHAR), CAST(min(protocol) AS VARCHAR)) AS flow_id",
        "arg_min(dst_port, pkt_no) AS dst_port", "min(protocol) AS protocol", f"round({sec} * 1e6, 0) AS flow_duration", f"count(*) FILTER ({fwd}) AS tot_fwd_pkts", f"count(*) FILTER ({bwd}) AS tot_bwd_pkts",
        f"CAST(coalesce(sum(ip_len) FILTER ({fwd}), 0) AS DOUBLE) AS totlen_fwd_pkts", f"CAST(coalesce(sum(ip_len) FILTER ({bwd}), 0) AS DOUBLE) AS totlen_bwd_pkts",
        stats(f(fwd), "fwd_pkt_len", 6), stats(f(bwd), "bwd_pkt_len", 6), f"{rate('sum(ip_len)')} AS flow_byts_s", f"{rate('count(*)')} AS flow_pkts_s",
        stats("CASE WHEN gap >= 0 THEN gap END", "flow_iat", 0), stats(f(fwd, "side_gap"), "fwd_iat", 0, "tot"), stats(f(bwd, "side_gap"), "bwd_iat", 0, "tot"),
        *[f"count(*) FILTER (tcp_flags & {bit} <> 0 AND {cond}) AS {side}_{name}_flags" for name, bit in (("psh", 8), ("urg", 32)) for side, cond in (("fwd", fwd), ("bwd", bwd))],
        f"CAST(coalesce(sum({hdr}) FILTER ({fwd}), 0) AS DOUBLE) AS fwd_header_len", f"CAST(coalesce(sum({hdr}) FILTER ({bwd}), 0) AS DOUBLE) AS bwd_header_len", f"CAST(coalesce(sum({hdr}) FILTER ({fwd}), 0) AS DOUBLE) AS fwd_header_len2",
        f"{rate(f'count(*) FILTER ({fwd})')} AS fwd_pkts_s", f"{rate(f'count(*) FILTER ({bwd})')} AS bwd_pkts_s", stats("ip_len", "pkt_len", 6, "var"),
        *[f"count(*) FILTER (tcp_flags & {bit} <> 0) AS {name}_flag_cnt" for name, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("cwe", 128), ("ece", 64))],
        f"coalesce(round(CAST(count(*) FILTER ({bwd}) AS DOUBLE) / nullif(count(*) FILTER ({fwd}), 0), 6), 0.0) AS down_up_ratio", "round(avg(ip_len), 6) AS pkt_size_avg", f"coalesce(round(avg({f(fwd)}), 6), 0.0) AS fwd_seg_size_avg", f"coalesce(round(avg({f(bwd)}), 6), 0.0) AS bwd_seg_size_avg",
        f"coalesce(arg_min(tcp_win, pkt_no) FILTER ({fwd} AND tcp_win IS NOT NULL), -1) AS init_fwd_win_byts", f"coalesce(arg_min(tcp_win, pkt_no) FILTER ({bwd} AND tcp_win IS NOT NULL), -1) AS init_bwd_win_byts",
        f"count(*) FILTER ({fwd} AND app_len > 0) AS fwd_act_data_pkts", f"coalesce(min({hdr}) FILTER ({fwd}), 0) AS fwd_seg_size_min",
    ]
    rates = [f"coalesce(round(max({x}) FILTER (dir = {d}{cond}), 6), 0.0) AS {side}_{name}" for side, d in (("fwd", 1), ("bwd", -1)) for name, x, cond in (("byts_b_avg", "bulk_bytes / CAST(states AS DOUBLE)", ""), ("pkts_b_avg", "bulk_pkts / CAST(states AS DOUBLE)", ""), ("blk_rate_avg", "bulk_bytes / (bulk_us / 1e6)", " AND bulk_us > 0"))]
    sub = [f"round(m.{c} / CAST(greatest(a3.subflows, 1) AS DOUBLE), 6) AS subflow_{n}" for n, c in (("fwd_pkts", "tot_fwd_pkts"), ("fwd_byts", "totlen_fwd_pkts"), ("bwd_pkts", "tot_bwd_pkts"), ("bwd_byts", "totlen_bwd_pkts"))]
    zero = [f"coalesce(br.{s}_{n}, 0.0) AS {s}_{n}" for s in ("fwd", "bwd") for n in ("byts_b_avg", "pkts_b_avg", "blk_rate_avg")]
    active = [f"a3.{n}_{k}" for n in ("active", "idle") for k in ("mean", "std", "max", "min")]
    sides = GAPPED.rstrip() + ", gs AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow, dir ORDER BY pkt_no) AS side_gap FROM g)"
    return sides + _active_sql(10_800_000_000).rstrip() + _bulk_sql(86_400_000_000, 4).rstrip() + f", br AS (SELECT flow, {', '.join(rates)} FROM b4 GROUP BY flow), m AS (SELECT flow, {', '.join(cols)} FROM gs GROUP BY flow)\nSELECT m.*, {', '.join(sub + zero + active)} FROM m JOIN a3 USING (flow) LEFT JOIN br USING (flow)"


CIC_80 = _cic_sql()


def cicext_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.cic_distributions(oriented(spark, sf_dir))
    iat = [c for c in out.columns if "iat_us" in c and not c.endswith(("skew", "kurt"))]
    rest = [c for c in out.columns if c != "flow" and c not in iat]
    exact = [c for c in iat if not c.endswith(("mean", "std"))]
    return rounded(rounded(rounded(rounded(out, 2, *exact), 0, *[c for c in iat if c.endswith("mean")]), -3, *[c for c in iat if c.endswith("std")]), 6, *rest)


def _dist_sql() -> str:
    cols = []
    made = {"pkt_len": "ip_len", "pay_len": "app_len", "hdr_len": "(20 + CASE WHEN protocol = 17 THEN 8 ELSE 20 END)"}
    for seq in features.SEQUENCES:
        for side, cond in (("all", None), ("fwd", "dir = 1"), ("bwd", "dir = -1")):
            x = made.get(seq) or f"greatest(coalesce({'gap' if cond is None else 'side_gap'}, 0), 0)"
            x = f"CAST({x} AS DOUBLE)" if cond is None else f"CASE WHEN {cond} THEN CAST({x} AS DOUBLE) END"
            p, d, dm, ds = f"{side}_{seq}", *((2, 0, -3) if seq == "iat_us" else (6, 6, 6))
            n = f"CAST(count({x}) AS DOUBLE)"
            std = f"sqrt(var_pop({x}) * {n} * {n} / ({n} - 1))"
            cols += [f"coalesce(round(quantile_cont({x}, {k / 10}), {d}), 0.0) AS {p}_p{k}0" for k in range(1, 10)]
            cols += [f"coalesce(round(avg({x}), {dm}), 0.0) AS {p}_mean", f"coalesce(CASE WHEN count({x}) > 1 THEN round({std}, {ds}) END, 0.0) AS {p}_std", f"coalesce(round(min({x}), {d}), 0.0) AS {p}_min", f"coalesce(round(max({x}), {d}), 0.0) AS {p}_max", f"coalesce(round(quantile_cont({x}, 0.5), {d}), 0.0) AS {p}_median"]
            cols += [f"max({p}_m) AS {p}_m0, count({x}) AS {p}_n0, coalesce({std}, 0.0) AS {p}_s0, sum(power({x} - {p}_m, 3)) AS {p}_c3, sum(power({x} - {p}_m, 4)) AS {p}_c4"]
    means = []
    outs = ["flow"]
    for seq in features.SEQUENCES:
        for side, cond in (("all", None), ("fwd", "dir = 1"), ("bwd", "dir = -1")):
            p = f"{side}_{seq}"
            x = made.get(seq) or f"greatest(coalesce({'gap' if cond is None else 'side_gap'}, 0), 0)"
            means.append(f"avg({'CAST(' + x + ' AS DOUBLE)' if cond is None else f'CASE WHEN {cond} THEN CAST({x} AS DOUBLE) END'}) OVER (PARTITION BY flow) AS {p}_m")
            outs += [f"{p}_{k}" for k in (*(f"p{i}0" for i in range(1, 10)), "mean", "std", "min", "max", "median")]
            n, s = f"CAST({p}_n0 AS DOUBLE)", f"{p}_s0"
            outs.append(f"coalesce(round(CASE WHEN {n} >= 3 AND {s} > 1e-12 THEN {n} / (({n} - 1) * ({n} - 2)) * {p}_c3 / power({s}, 3) END, 6), 0.0) AS {p}_skew")
            outs.append(f"coalesce(round(CASE WHEN {n} >= 4 AND {s} > 1e-12 THEN {n} * ({n} + 1) / (({n} - 1) * ({n} - 2) * ({n} - 3)) * {p}_c4 / power({s}, 4) - 3 * ({n} - 1) * ({n} - 1) / (({n} - 2) * ({n} - 3)) END, 6), 0.0) AS {p}_kurt")
    sides = GAPPED.rstrip() + ", gs AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow, dir ORDER BY pkt_no) AS side_gap FROM g)"
    return sides + f", dm AS (SELECT *, {', '.join(means)} FROM gs), dd AS (SELECT flow, {', '.join(cols)} FROM dm GROUP BY flow)\nSELECT {', '.join(outs)} FROM dd"


CICEXT_DIST = _dist_sql()


def netflow_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.netflow_v5(oriented(spark, sf_dir))


NETFLOW_V5 = (
    FLOW_SQL
    + """SELECT flow, arg_min(src_ip, pkt_no) AS srcaddr, arg_min(dst_ip, pkt_no) AS dstaddr, arg_min(src_port, pkt_no) AS srcport, arg_min(dst_port, pkt_no) AS dstport, arg_min(protocol, pkt_no) AS prot, 0 AS tos,
  count(*) AS d_pkts, CAST(sum(ip_len) AS BIGINT) AS d_octets, (arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no)) // 1000 AS last_ms, bit_or(tcp_flags) AS tcp_flags, '0.0.0.0' AS nexthop,
  0 AS input_snmp, 0 AS output_snmp, 0 AS first_ms, 0 AS src_as, 0 AS dst_as, 0 AS src_mask, 0 AS dst_mask FROM o GROUP BY flow"""
)


def ipfix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.ipfix(oriented(spark, sf_dir))
    us = [c for c in out.columns if "iat" in c]
    return rounded(rounded(out, 0, *us), 6, *[c for c in out.columns if c.endswith(("_ps", "_hdr_len")) or "pkt_len_mean" in c or "pkt_len_std" in c])


def _ipfix_sql() -> str:
    fwd, bwd, sec = "dir = 1", "dir = -1", "((arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no)) / 1e6)"

    def two(x: str, name: str, unit: str, digits: int) -> str:
        return f"coalesce(round(avg({x}), {digits}), 0.0) AS {name}_mean{unit}, coalesce(CASE WHEN count({x}) > 1 THEN round(stddev_samp({x}), {digits}) END, 0.0) AS {name}_std{unit}"

    def side(cond: str, x: str) -> str:
        return f"CASE WHEN {cond} THEN {x} END"

    def rate(x: str) -> str:
        return f"coalesce(round(CASE WHEN {sec} > 0 THEN {x} / {sec} ELSE 0.0 END, 6), 0.0)"

    cols = [
        "arg_min(ts_us, pkt_no) // 1000 AS flow_start_ms", "arg_max(ts_us, pkt_no) // 1000 AS flow_end_ms", "arg_min(ts_us, pkt_no) AS flow_start_us", "(arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no)) // 1000 AS flow_dur_ms", "arg_min(protocol, pkt_no) AS protocol",
        "0 AS ip_class_of_service", "0 AS dscp", "0 AS ecn", "0 AS min_ttl", "0 AS max_ttl", "min(ip_len) AS min_ip_total_len", "max(ip_len) AS max_ip_total_len", f"count(*) FILTER ({fwd}) AS fwd_pkts", f"count(*) FILTER ({bwd}) AS bwd_pkts",
        f"CAST(coalesce(sum(ip_len) FILTER ({fwd}), 0) AS BIGINT) AS fwd_octets", f"CAST(coalesce(sum(ip_len) FILTER ({bwd}), 0) AS BIGINT) AS bwd_octets", "bit_or(tcp_flags) AS tcp_control_bits", f"coalesce(bit_or(tcp_flags) FILTER ({fwd}), 0) AS tcp_flags_fwd", f"coalesce(bit_or(tcp_flags) FILTER ({bwd}), 0) AS tcp_flags_bwd",
        *[f"count(*) FILTER (protocol = 6 AND tcp_flags & {bit} <> 0) AS tcp_{name}_cnt" for name, bit in (("syn", 2), ("fin", 1), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("cwr", 128), ("ece", 64))],
        two("ip_len", "pkt_len", "", 6), two(side(fwd, "ip_len"), "fwd_pkt_len", "", 6), two(side(bwd, "ip_len"), "bwd_pkt_len", "", 6), "min(ip_len) AS pkt_len_min", "max(ip_len) AS pkt_len_max",
        two("gap", "iat", "_us", 0), two(side(fwd, "side_gap"), "fwd_iat", "_us", 0), two(side(bwd, "side_gap"), "bwd_iat", "_us", 0), "CAST(coalesce(min(gap), 0) AS DOUBLE) AS iat_min_us", "CAST(coalesce(max(gap), 0) AS DOUBLE) AS iat_max_us",
        f"{rate('sum(ip_len)')} AS flow_bytes_ps", f"{rate('count(*)')} AS flow_pkts_ps", f"{rate(f'sum(ip_len) FILTER ({fwd})')} AS fwd_bytes_ps", f"{rate(f'sum(ip_len) FILTER ({bwd})')} AS bwd_bytes_ps",
        "20.0::DOUBLE AS avg_ip_hdr_len", f"CASE WHEN count(*) FILTER ({fwd}) > 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_fwd_ip_hdr_len", f"CASE WHEN count(*) FILTER ({bwd}) > 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_bwd_ip_hdr_len",
    ]
    return GAPPED.rstrip() + f", gs AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow, dir ORDER BY pkt_no) AS side_gap FROM g) SELECT flow, {', '.join(cols)} FROM gs GROUP BY flow"


IPFIX = _ipfix_sql()


def argus_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.argus(oriented(spark, sf_dir))
    return rounded(rounded(out, 3, *[c for c in out.columns if c.endswith("_ms")]), 6, "dur", "src_load", "dst_load", "src_rate", "dst_rate", "src_mean_pkt_sz", "dst_mean_pkt_sz").drop("state", "sflgs", "dflgs")


def _argus_sql() -> str:
    fwd, bwd = "dir = 1", "dir = -1"
    sec = "((arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no)) / 1e6)"
    sb, db = f"coalesce(sum(ip_len) FILTER ({fwd}), 0)", f"coalesce(sum(ip_len) FILTER ({bwd}), 0)"
    sp, dp = f"count(*) FILTER ({fwd})", f"count(*) FILTER ({bwd})"

    def rate(x: str) -> str:
        return f"round(CASE WHEN {sec} > 0 THEN {x} / {sec} ELSE 0.0 END, 6)"

    def case(services: dict[str, tuple[int, ...]]) -> str:
        return "CASE " + " ".join(f"WHEN server IN ({', '.join(map(str, ports))}) THEN '{name}'" for name, ports in services.items()) + " END"

    def two(x: str, name: str) -> str:
        return f"coalesce(round(avg({x}), 3), 0.0) AS {name}_mean_ms, coalesce(CASE WHEN count({x}) > 1 THEN round(stddev_samp({x}), 3) END, 0.0) AS {name}_std_ms"

    cols = [
        "arg_min(ts_us, pkt_no) AS start_us", "arg_max(ts_us, pkt_no) AS last_us", f"round({sec}, 6) AS dur", *[f"arg_min({c}, pkt_no) AS {c}" for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")],
        f"CASE WHEN {sp} > 0 AND {dp} > 0 THEN CASE WHEN {sb} > {sp} * 40 OR {db} > {dp} * 40 THEN '<>' ELSE '??' END WHEN {sp} > 0 THEN '->' ELSE '<-' END AS dir",
        f"{sp} AS src_pkts", f"{dp} AS dst_pkts", "count(*) AS tot_pkts", f"CAST({sb} AS BIGINT) AS src_bytes", f"CAST({db} AS BIGINT) AS dst_bytes", "CAST(sum(ip_len) AS BIGINT) AS tot_bytes",
        f"{rate(sp)} AS src_load", f"{rate(dp)} AS dst_load", f"{rate(sb)} AS src_rate", f"{rate(db)} AS dst_rate",
        f"coalesce(arg_max(tcp_win, pkt_no) FILTER (protocol = 6 AND {fwd}), 0) AS src_win", f"coalesce(arg_max(tcp_win, pkt_no) FILTER (protocol = 6 AND {bwd}), 0) AS dst_win",
        f"coalesce(arg_min(tcp_seq, pkt_no) FILTER (protocol = 6 AND tcp_flags & 2 <> 0 AND {fwd}), 0) AS src_tcp_base", f"coalesce(arg_min(tcp_seq, pkt_no) FILTER (protocol = 6 AND tcp_flags & 2 <> 0 AND {bwd}), 0) AS dst_tcp_base",
        "coalesce(round((arg_min(ts_us, pkt_no) FILTER (answer) - arg_min(syn_ts, pkt_no) FILTER (answer)) / 1000.0::DOUBLE, 3), -1.0) AS syn_ack_rtt_ms",
        f"coalesce(round((arg_min(ts_us, pkt_no) FILTER (protocol = 6 AND tcp_flags & 18 = 16 AND {fwd} AND answer_ts IS NOT NULL) - min(answer_ts)) / 1000.0::DOUBLE, 3), -1.0) AS ack_dat_rtt_ms",
        f"count(*) FILTER (behind AND {fwd}) AS src_gap", f"count(*) FILTER (behind AND {bwd}) AS dst_gap",
        *[f"count(*) FILTER (protocol = 6 AND tcp_flags & {bit} <> 0) AS {name}_cnt" for name, bit in (("syn", 2), ("fin", 1), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))],
        "0 AS src_tos", "0 AS dst_tos", "0 AS src_ip_id", "0 AS dst_ip_id", f"coalesce(round(avg(ip_len) FILTER ({fwd}), 6), 0.0) AS src_mean_pkt_sz", f"coalesce(round(avg(ip_len) FILTER ({bwd}), 6), 0.0) AS dst_mean_pkt_sz",
        two("gap / 1000.0::DOUBLE", "iat"), two(f"CASE WHEN {fwd} THEN side_gap / 1000.0::DOUBLE END", "src_iat"), two(f"CASE WHEN {bwd} THEN side_gap / 1000.0::DOUBLE END", "dst_iat"),
    ]
    before = "PARTITION BY flow ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        GAPPED.rstrip()
        + f""", h0 AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow, dir ORDER BY pkt_no) AS side_gap, last_value(CASE WHEN protocol = 6 AND tcp_flags & 18 = 2 AND dir = 1 THEN ts_us END IGNORE NULLS) OVER ({before}) AS syn_ts,
         max(tcp_seq + app_len) OVER (PARTITION BY flow, dir ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM g
), h1 AS (SELECT *, protocol = 6 AND tcp_flags & 18 = 18 AND dir = -1 AND syn_ts IS NOT NULL AS answer, protocol = 6 AND tcp_seq <> 0 AND coalesce(furthest, 0) <> 0 AND tcp_seq < furthest - 1 AS behind FROM h0
), h2 AS (SELECT *, first_value(CASE WHEN answer THEN ts_us END IGNORE NULLS) OVER ({before}) AS answer_ts FROM h1
), h3 AS (SELECT flow, {", ".join(cols)} FROM h2 GROUP BY flow
), h4 AS (SELECT *, CASE WHEN dst_port <= 1023 OR (src_port > 1023 AND dst_port <= 49151) THEN dst_port WHEN src_port <= 1023 THEN src_port ELSE least(src_port, dst_port) END AS server FROM h3)
SELECT * EXCLUDE (server), CASE WHEN protocol = 17 THEN {case(features.UDP_SERVICES)} ELSE {case(features.TCP_SERVICES)} END AS service FROM h4"""
    )


ARGUS_FLOWS = _argus_sql()


def argus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine's end and both ends' flags; an ordered fold, tested against a plain loop."""
    return features.argus(oriented(spark, sf_dir)).select("flow", "state", "sflgs", "dflgs")


# ---- joins, merges, running statistics ----


def unified_seq_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of one family's sequences (filtered, without retransmissions) with the other's (all packets), the latter's names first."""
    left = _tcp_in_order(spark, sf_dir).filter(~F.col("is_retrans") & (F.col("protocol") == 6)).groupBy("flow").agg(F.count(F.lit(1)).alias("a_packets"), F.sum(F.col("wirelen") * F.col("dir")).alias("a_signed_bytes"))
    right = flows.oriented(packets(spark, sf_dir), "address").filter("dst_port <> 8080").groupBy("flow").agg(F.count(F.lit(1)).alias("b_packets"), F.min_by("ts_us", "pkt_no").alias("first_us"), F.max_by("ts_us", "pkt_no").alias("last_us"))
    return left.join(right, "flow", "full_outer")


UNIFIED_SEQ_JOIN = (
    _RETRANS.rstrip()
    + """, ua AS (SELECT flow, count(*) AS a_packets, CAST(sum(wirelen * dir) AS BIGINT) AS a_signed_bytes FROM r2 WHERE NOT is_retrans AND protocol = 6 GROUP BY flow
), ub AS (SELECT flow, count(*) AS b_packets, arg_min(ts_us, pkt_no) AS first_us, arg_max(ts_us, pkt_no) AS last_us FROM fk WHERE dst_port <> 8080 GROUP BY flow)
SELECT coalesce(ua.flow, ub.flow) AS flow, a_packets, a_signed_bytes, b_packets, first_us, last_us FROM ua FULL OUTER JOIN ub ON ua.flow = ub.flow"""
)


def dns_rtt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th query of a transaction with the k-th response of it that comes later; k (of the view) is the transaction id."""
    df = oriented(spark, sf_dir).filter("protocol = 17").select("flow", "pkt_no", "ts_us", "dir", F.col("k").alias("txid"))
    nth = F.row_number().over(Window.partitionBy("flow", "txid", "dir").orderBy("pkt_no"))
    df = df.withColumn("nth", nth)
    q, r = df.filter("dir = 1").alias("q"), df.filter("dir = -1").alias("r")
    on = (F.col("q.flow") == F.col("r.flow")) & (F.col("q.txid") == F.col("r.txid")) & (F.col("q.nth") == F.col("r.nth")) & (F.col("r.pkt_no") > F.col("q.pkt_no"))
    return q.join(r, on, "left").select(F.col("q.flow").alias("flow"), F.col("q.pkt_no").alias("query_no"), F.col("q.txid").alias("txid"), F.col("r.pkt_no").alias("response_no"), F.round((F.col("r.ts_us") - F.col("q.ts_us")) / 1000.0, 3).alias("rtt_ms"))


DNS_RTT_MATCH = (
    FLOW_SQL.rstrip()
    + """, d0 AS (SELECT flow, pkt_no, ts_us, dir, k AS txid, row_number() OVER (PARTITION BY flow, k, dir ORDER BY pkt_no) AS nth FROM o WHERE protocol = 17)
SELECT q.flow, q.pkt_no AS query_no, q.txid, r.pkt_no AS response_no, round((r.ts_us - q.ts_us) / 1000.0::DOUBLE, 3) AS rtt_ms
FROM d0 q LEFT JOIN d0 r ON q.flow = r.flow AND q.txid = r.txid AND q.nth = r.nth AND r.dir = -1 AND r.pkt_no > q.pkt_no WHERE q.dir = 1"""
)


def cumulative_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x = flows.so_far(), F.col("wirelen")
    n, s, q = F.count(x).over(w), F.sum(x).over(w), F.sum(x * x).over(w)
    mean = s.cast("double") / n
    out = oriented(spark, sf_dir).select("pkt_no", "flow", mean.alias("cum_mean"), F.sqrt(F.greatest(q.cast("double") / n - mean * mean, F.lit(0.0))).alias("cum_std"), F.min(x).over(w).alias("cum_min"), F.max(x).over(w).alias("cum_max"))
    return rounded(out, 6, "cum_mean", "cum_std")


CUMULATIVE_STATS = (
    FLOW_SQL
    + """SELECT pkt_no, flow, round(CAST(sum(wirelen) OVER w AS DOUBLE) / count(*) OVER w, 6) AS cum_mean,
  round(sqrt(greatest(CAST(sum(wirelen * wirelen) OVER w AS DOUBLE) / count(*) OVER w - (CAST(sum(wirelen) OVER w AS DOUBLE) / count(*) OVER w) * (CAST(sum(wirelen) OVER w AS DOUBLE) / count(*) OVER w), 0.0)), 6) AS cum_std,
  min(wirelen) OVER w AS cum_min, max(wirelen) OVER w AS cum_max FROM o WINDOW w AS (PARTITION BY flow ORDER BY pkt_no ROWS UNBOUNDED PRECEDING)"""
)


def sliding_window_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and std of the last ten packet lengths of each flow."""
    w, x = flows.in_order().rowsBetween(-9, 0), F.col("wirelen")
    n, s, q = F.count(x).over(w), F.sum(x).over(w), F.sum(x * x).over(w)
    mean = s.cast("double") / n
    df = oriented(spark, sf_dir).select("flow", "pkt_no", mean.alias("m"), F.sqrt(F.greatest(q.cast("double") / n - mean * mean, F.lit(0.0))).alias("s"))
    return rounded(df.groupBy("flow").agg(F.max_by("m", "pkt_no").alias("window_mean"), F.max_by("s", "pkt_no").alias("window_std")), 6, "window_mean", "window_std")


SLIDING_WINDOW_10 = (
    FLOW_SQL.rstrip()
    + """, k AS (SELECT flow, wirelen, row_number() OVER (PARTITION BY flow ORDER BY pkt_no DESC) AS back FROM o)
SELECT flow, round(CAST(sum(wirelen) AS DOUBLE) / count(*), 6) AS window_mean,
  round(sqrt(greatest(CAST(sum(wirelen * wirelen) AS DOUBLE) / count(*) - (CAST(sum(wirelen) AS DOUBLE) / count(*)) * (CAST(sum(wirelen) AS DOUBLE) / count(*)), 0.0)), 6) AS window_std FROM k WHERE back <= 10 GROUP BY flow"""
)


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-empty value, distinct values in first-seen order, first non-zero value, and the protocol stack, by flow."""
    df = oriented(spark, sf_dir)
    agg = df.groupBy("flow").agg(
        F.min_by(F.when(F.col("app_len") > 0, F.col("app_len")), F.when(F.col("app_len") > 0, F.col("pkt_no"))).alias("first_app_len"),
        F.min_by("k", F.when(F.col("k") % 7 != 0, F.col("pkt_no"))).alias("first_k"), F.array_sort(F.collect_list(F.struct("pkt_no", (F.col("k") % 5).alias("v")))).alias("r"), F.min("protocol").alias("protocol"), F.max(F.greatest("src_port", "dst_port") * 0 + F.least("src_port", "dst_port")).alias("server_port"),
    )
    stack = F.array_compact(F.array(F.lit("IPv4"), F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP"), F.when(F.col("server_port") == 443, "TLS"), F.when(F.col("server_port") == 53, "DNS")))
    return agg.select("flow", "first_app_len", "first_k", F.array_join(F.array_distinct(F.transform("r", lambda x: x["v"].cast("string"))), ",").alias("values_seen"), F.array_join(stack, "/").alias("ext_protocol"))


FIRST_WINS_MERGE = (
    FLOW_SQL.rstrip()
    + """, m0 AS (SELECT flow, k % 5 AS v, min(pkt_no) AS seen_at FROM o GROUP BY flow, k % 5), m1 AS (SELECT flow, string_agg(CAST(v AS VARCHAR), ',' ORDER BY seen_at) AS values_seen FROM m0 GROUP BY flow
), m2 AS (SELECT flow, arg_min(app_len, pkt_no) FILTER (app_len > 0) AS first_app_len, arg_min(k, pkt_no) FILTER (k % 7 <> 0) AS first_k, min(protocol) AS protocol, max(least(src_port, dst_port)) AS server_port FROM o GROUP BY flow)
SELECT m2.flow, first_app_len, first_k, values_seen, concat('IPv4', CASE WHEN protocol = 6 THEN '/TCP' WHEN protocol = 17 THEN '/UDP' ELSE '' END, CASE WHEN server_port = 443 THEN '/TLS' ELSE '' END, CASE WHEN server_port = 53 THEN '/DNS' ELSE '' END) AS ext_protocol
FROM m2 JOIN m1 USING (flow)"""
)


QUERIES = {
    "flow_metrics": flow_metrics, "flow_direction_split": flow_direction_split, "flow_tcp_flag_counts": flow_tcp_flag_counts, "flow_len_stats": flow_len_stats, "flow_iat_stats": flow_iat_stats, "flow_all_stats": flow_all_stats, "flow_ratios": flow_ratios,
    **{name: _filter_query(text) for name, (text, _) in FILTERS.items()}, "filter_default": filter_default,
    "retrans_flag": retrans_flag, "retrans_filtered_counts": retrans_filtered_counts, "udp_timeout_sessions": udp_timeout_sessions, "cic_active_idle": cic_active_idle, "bulk_runs": bulk_runs, "burst_rle": burst_rle, "seq_arrays": seq_arrays, "flow_chunks": flow_chunks, "tcp_states": tcp_states,
    "cic_80": cic_80, "cicext_dist": cicext_dist, "netflow_v5": netflow_v5, "ipfix": ipfix, "argus_rtt_dir_service": argus_flows, "argus_state": argus_state,
    "unified_seq_join": unified_seq_join, "dns_rtt_match": dns_rtt_match, "cumulative_stats": cumulative_stats, "sliding_window_10": sliding_window_10, "first_wins_merge": merges,
}
ORACLES = {
    "flow_metrics": FLOW_METRICS, "flow_direction_split": FLOW_DIRECTION_SPLIT, "flow_tcp_flag_counts": FLOW_TCP_FLAG_COUNTS, "flow_len_stats": FLOW_LEN_STATS, "flow_iat_stats": FLOW_IAT_STATS, "flow_all_stats": FLOW_ALL_STATS, "flow_ratios": FLOW_RATIOS,
    **{name: f"WITH {views.EVENTS_SQL} SELECT pkt_no, src_ip, src_port, dst_ip, dst_port, protocol FROM pk WHERE {where}" for name, (_, where) in FILTERS.items()}, "filter_default": FILTER_DEFAULT,
    "retrans_flag": RETRANS_FLAG, "retrans_filtered_counts": RETRANS_FILTERED_COUNTS, "udp_timeout_sessions": UDP_TIMEOUT_SESSIONS, "cic_active_idle": CIC_ACTIVE_IDLE, "bulk_runs": BULK_RUNS, "burst_rle": BURST_RLE, "seq_arrays": SEQ_ARRAYS, "flow_chunks": FLOW_CHUNKS, "tcp_states": TCP_STATES,
    "cic_80": CIC_80, "cicext_dist": CICEXT_DIST, "netflow_v5": NETFLOW_V5, "ipfix": IPFIX, "argus_rtt_dir_service": ARGUS_FLOWS,
    "unified_seq_join": UNIFIED_SEQ_JOIN, "dns_rtt_match": DNS_RTT_MATCH, "cumulative_stats": CUMULATIVE_STATS, "sliding_window_10": SLIDING_WINDOW_10, "first_wins_merge": FIRST_WINS_MERGE,
}
