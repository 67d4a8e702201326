"""Packet-shaped views over ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

SERVER = "192.0.2.10"
_SERVER_NUMBER = 192 << 24 | 2 << 8 | 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    """One user is one bidirectional flow; the order of packets is ``pkt_no``."""
    user, value = F.col("user_id"), F.floor("value").cast("bigint")
    base = events.select(
        F.col("event_id").cast("bigint").alias("pkt_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (user % 256).cast("string")).alias("cip"),
        (F.lit(40000) + (user % 1000)).cast("bigint").alias("cport"),
        F.when(user % 3 == 0, 53).when(user % 3 == 1, 443).otherwise(8080).cast("bigint").alias("sport0"),
        F.when(user % 3 == 0, 17).otherwise(6).alias("protocol"),
        F.col("event_type").isin("view", "click", "signup").alias("c2s"),
        value.alias("v"),
        "event_type",
    )
    c2s, tcp = F.col("c2s"), F.col("protocol") == 6
    kind = F.col("event_type")
    flags = F.when(~tcp, 0).when(kind == "signup", 2).when(kind == "error", 4).when(kind == "purchase", 17).when(kind == "click", 24).otherwise(16)
    return base.select(
        "pkt_no", "ts_us", (F.col("ts_us") / 1e6).alias("ts"), "k", F.when(c2s, 1).otherwise(-1).alias("true_dir"), "protocol",
        F.when(c2s, F.col("cip")).otherwise(SERVER).alias("src_ip"), F.when(c2s, F.lit(SERVER)).otherwise(F.col("cip")).alias("dst_ip"),
        F.when(c2s, F.col("cport")).otherwise(F.col("sport0")).alias("src_port"), F.when(c2s, F.col("sport0")).otherwise(F.col("cport")).alias("dst_port"),
        (F.col("v") + 40).alias("ip_len"), (F.col("v") + 54).alias("wirelen"), F.when(F.col("k") < 30, 0).otherwise(F.col("v")).cast("bigint").alias("app_len"), flags.alias("tcp_flags"),
        F.when(tcp, F.col("k") * 512 + 1000).alias("tcp_win"), F.when(tcp, F.col("pkt_no") % 50 * 100 + 1000).alias("tcp_seq"),
    )


def addressed(packets: DataFrame) -> DataFrame:
    """The events' packets with addresses that frames can hold: the third part of user n's address, n div 256, passes 255 from user 65,536 on, so that a
    frame has 10.0.0.0 + n, which is the same below. Users whose number reaches the server's address (3,053,453,834) fail. ``labelled`` undoes it."""

    def number(ip: str) -> Column:
        parts = F.split(ip, r"\.")
        n = F.lit(10 << 24).cast("bigint") + parts[2].cast("bigint") * 256 + parts[3].cast("bigint")
        return F.when(F.col(ip) == SERVER, SERVER).when(n < _SERVER_NUMBER, text.ip_text(n)).when(n.isNotNull(), F.raise_error(F.concat(F.lit("no frame can hold the address "), F.col(ip))))

    return packets.withColumns({c: number(c) for c in ("src_ip", "dst_ip")})


def labelled(packets: DataFrame) -> DataFrame:
    """Packets parsed from frames of ``addressed`` ones, with the addresses that the view has."""

    def label(ip: str) -> Column:
        n = text.ip_number(ip) - (10 << 24)
        return F.when(F.col(ip) == SERVER, SERVER).otherwise(F.concat(F.lit("10.0."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string")))

    return packets.withColumns({c: label(c) for c in ("src_ip", "dst_ip")})


#: Rows of a table that a task of ``dealt`` gets, about.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as the table's rows ask for, which Spark doesn't merge again: it would by their compressed size in the
    shuffle, and what sorts and aggregates hold of them is many times that. So a task's memory doesn't grow with the table."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // TASK_ROWS), min(cores, -(-rows // 10_000)), 1), *keys)


def packets_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One order is one short flow: flow_no, idx, ts_us, true_dir, app_len, ip_len, wirelen, server_no."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    n = F.col("l_quantity").cast("bigint")
    return dealt(lineitem, "l_orderkey").select(
        F.col("l_orderkey").alias("flow_no"), F.row_number().over(order).cast("bigint").alias("idx"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("true_dir"), n.alias("app_len"), (n + 40).alias("ip_len"), (n + 54).alias("wirelen"), F.col("l_suppkey").alias("server_no"),
    )


#: The same views for DuckDB, as common table expressions.
EVENTS_SQL = """
e0 AS (
  SELECT *, epoch_us(ts) AS ts_us, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         concat('10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS cip, '192.0.2.10' AS sip,
         40000 + CAST(user_id % 1000 AS BIGINT) AS cport, CAST(CASE WHEN user_id % 3 = 0 THEN 53 WHEN user_id % 3 = 1 THEN 443 ELSE 8080 END AS BIGINT) AS sport0,
         CASE WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS protocol, event_type IN ('view', 'click', 'signup') AS c2s, CAST(floor(value) AS BIGINT) AS v
  FROM events
), pk AS (
  SELECT CAST(event_id AS BIGINT) AS pkt_no, ts_us, ts_us / 1e6 AS ts, k, CASE WHEN c2s THEN 1 ELSE -1 END AS true_dir, protocol,
         CASE WHEN c2s THEN cip ELSE sip END AS src_ip, CASE WHEN c2s THEN sip ELSE cip END AS dst_ip,
         CASE WHEN c2s THEN cport ELSE sport0 END AS src_port, CASE WHEN c2s THEN sport0 ELSE cport END AS dst_port,
         40 + v AS ip_len, 54 + v AS wirelen, CASE WHEN k < 30 THEN 0 ELSE v END AS app_len,
         CASE WHEN protocol <> 6 THEN 0 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'click' THEN 24 ELSE 16 END AS tcp_flags,
         CASE WHEN protocol = 6 THEN 1000 + k * 512 END AS tcp_win, CASE WHEN protocol = 6 THEN 1000 + 100 * (CAST(event_id AS BIGINT) % 50) END AS tcp_seq
  FROM e0
)"""
LINEITEM_SQL = """
li AS (
  SELECT l_orderkey AS flow_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS idx,
         epoch_us(l_shipdate) AS ts_us, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS true_dir,
         CAST(l_quantity AS BIGINT) AS app_len, CAST(l_quantity AS BIGINT) + 40 AS ip_len, CAST(l_quantity AS BIGINT) + 54 AS wirelen, l_suppkey AS server_no
  FROM lineitem
)"""
