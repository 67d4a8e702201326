"""Queries that turn tables into frames, read the frames back with the parsers, and analyse them; the SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import BinaryType

from ..functions import text
from ..functions.batches import joined, pieces
from ..operators import classifiers, flows, l7
from ..sources import build, layers, views
from .flow_queries import FLOW_SQL


def _parsed(spark: SparkSession, sf_dir: str, wanted: list[str] | None = None) -> DataFrame:
    packets = views.addressed(views.packets_from_events(views.table(spark, sf_dir, "events")))
    frame, (parse, schema) = build.framing(), layers.parsing(wanted or [])
    rows = build.packet_rows(packets.withColumn("payload", F.repeat(F.lit("x"), F.col("app_len").cast("int")).cast("binary")))
    return views.labelled(rows.mapInArrow(lambda batches: parse(frame(batches)), from_arrow_schema(schema)))  # one worker does both


def frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets of the view as Ethernet frames, parsed again."""
    return _parsed(spark, sf_dir).select("pkt_no", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", F.col("protocol").cast("bigint").alias("protocol"), "ip_len", "trans_len", "app_len", F.col("tcp_flags").cast("bigint").alias("tcp_flags"), "tcp_win", "tcp_seq", "ttl", "l4_hdr")


FRAME_PARSE = f"""WITH {views.EVENTS_SQL} SELECT pkt_no, ts_us, src_ip, src_port, dst_ip, dst_port, CAST(protocol AS BIGINT) AS protocol, app_len + CASE WHEN protocol = 6 THEN 40 ELSE 28 END AS ip_len,
  app_len + CASE WHEN protocol = 6 THEN 20 ELSE 8 END AS trans_len, app_len, CAST(tcp_flags AS BIGINT) AS tcp_flags, tcp_win, tcp_seq, CAST(64 AS BIGINT) AS ttl, CAST(CASE WHEN protocol = 6 THEN 20 ELSE 8 END AS BIGINT) AS l4_hdr FROM pk"""


def frame_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layers the parsed frames have, by protocol."""
    df = layers.stack(_parsed(spark, sf_dir, ["eth", "ip", "tcp", "udp"]))
    return df.groupBy("protocol", F.array_join("protocol_stack", "/").alias("stack")).agg(F.count(F.lit(1)).alias("packets"))


FRAME_LAYERS = f"WITH {views.EVENTS_SQL} SELECT protocol, CASE WHEN protocol = 6 THEN 'eth/ip/tcp' ELSE 'eth/ip/udp' END AS stack, count(*) AS packets FROM pk GROUP BY protocol"


def frame_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the parsed frames: they must be those of the view."""
    df = flows.oriented(_parsed(spark, sf_dir).drop("file", "vlan_id"))
    return df.groupBy("flow").agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("dir") == 1).alias("up_packets"), F.sum("app_len").alias("app_bytes"))


FRAME_FLOWS = FLOW_SQL + "SELECT flow, count(*) AS packets, count(*) FILTER (dir = 1) AS up_packets, CAST(sum(app_len) AS BIGINT) AS app_bytes FROM o GROUP BY flow"

# ---- pages as conversations: page n talks from 10.1.x.y to a server ----


_ROW = pa.schema([(c, pa.string() if c in ("src_ip", "dst_ip") else pa.binary() if c == "payload" else pa.int64()) for c in build.COLUMNS])


def _page_packets(spark: SparkSession, sf_dir: str, port: int, protocol: int, payload: Callable[[int, str], list[tuple[bool, bytes]]]) -> DataFrame:
    """Parsed packets that ``payload(page_id, url)`` says, as (from the client?, bytes) in order."""
    host_ip = F.concat_ws(".", F.lit("10"), (F.col("page_id") / 65536).cast("int").cast("string"), (F.floor(F.col("page_id") / 256) % 256).cast("string"), (F.col("page_id") % 256).cast("string"))
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), host_ip.alias("client"))

    def talk(rows: list[dict]) -> Iterator[dict]:
        for r in rows:
            page, ends = r["page_id"], ((r["client"], 40000), (views.SERVER, port))
            for k, (up, data) in enumerate(payload(page, r["url"])):
                (src, sport), (dst, dport) = ends if up else ends[::-1]
                yield {"pkt_no": page * 16 + k, "ts_us": page * 1_000_000 + k * 2000, "src_ip": src, "src_port": sport, "dst_ip": dst, "dst_port": dport, "protocol": protocol, "payload": data, "tcp_flags": 24, "tcp_seq": 1, "tcp_win": 8192}

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            yield from joined(talk(rows), _ROW)

    frame, (parse, schema) = build.framing(), layers.parsing([], "none")
    # One worker makes the packets, frames them and parses them, so that a task has one Python process and not three.
    return pages.mapInArrow(lambda batches: parse(frame(expand(batches))), from_arrow_schema(schema)).drop("file", "vlan_id")


def _host(url: str) -> str:
    return url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]


def _client_page(df: DataFrame, column: str = "src_ip") -> Column:
    return (text.ip_number(F.col(column)) - (10 << 24)).alias("page_id")


def http_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        request = f"GET {url} HTTP/1.1\r\nHost: {_host(url)}\r\nUser-Agent: probe/{page % 7}\r\n\r\n".encode()
        return [(True, request[:30]), (True, request[30:]), (False, f"HTTP/1.1 {200 if page % 3 else 404} X\r\nContent-Length: 3\r\n\r\nabc".encode())]

    r = l7.metadata(_page_packets(spark, sf_dir, 80, 6, talk), "http")
    return r.select(_client_page(r), "method", "url", "host", "user_agent", "status_code", "requests", "responses", "status_2xx", "status_4xx", "rtt_us")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
HTTP_FRAMES = f"SELECT page_id, 'GET' AS method, url, {_HOST} AS host, concat('probe/', CAST(page_id % 7 AS VARCHAR)) AS user_agent, CASE WHEN page_id % 3 <> 0 THEN 200 ELSE 404 END AS status_code, 1 AS requests, 1 AS responses, CASE WHEN page_id % 3 <> 0 THEN 1 ELSE 0 END AS status_2xx, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS status_4xx, 2000 AS rtt_us FROM pages"


def dns_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth query has no answer."""
    r = l7.metadata(_page_packets(spark, sf_dir, 53, 17, lambda page, url: [(True, build.dns_message(page, _host(url)))] + ([(False, build.dns_message(page, _host(url), True))] if page % 4 else [])), "dns")
    return r.select(_client_page(r), "queries", "responses", "rtt_samples", "rtt_avg_ms", F.element_at("qnames", 1).alias("qname"))


DNS_FRAMES = f"SELECT page_id, 1 AS queries, CASE WHEN page_id % 4 <> 0 THEN 1 ELSE 0 END AS responses, CASE WHEN page_id % 4 <> 0 THEN 1 ELSE 0 END AS rtt_samples, CASE WHEN page_id % 4 <> 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS rtt_avg_ms, {_HOST} AS qname FROM pages"


def tls_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hellos cut into two segments, with their fingerprint."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        hello = build.client_hello(_host(url), (0x0A0A, 0x1301 + page % 3, 0xC02F))
        return [(True, hello[:40]), (True, hello[40:])]

    r = l7.metadata(_page_packets(spark, sf_dir, 443, 6, talk), "tls")
    return r.select(_client_page(r), "sni", F.array_join("alpn", ",").alias("alpn"), "records", text.ja3(F.col("hello_version"), F.col("cipher_suites"), F.col("extensions"), F.col("supported_groups"), F.col("point_formats"))[1].alias("ja3_md5"))


TLS_FRAMES = f"SELECT page_id, {_HOST} AS sni, 'h2' AS alpn, 1 AS records, md5(concat('771,', CAST(4865 + page_id % 3 AS VARCHAR), '-49199,0-10-11-16,29-23,0')) AS ja3_md5 FROM pages"


def vpn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WireGuard handshakes, OpenVPN resets and plain text, by page."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        if page % 3 == 0:
            return [(True, b"\1\0\0\0" + bytes(144)), (False, b"\2\0\0\0" + bytes(88))]
        return [(True, b"\x38" + bytes(13)) if page % 3 == 1 else (True, b"\0\0\0\0text")]

    r = classifiers.vpn_flows(flows.canonical(_page_packets(spark, sf_dir, 51820, 17, talk)))
    return r.select(_client_page(r), "vpn", "confidence", "transport", "packets", "fwd_packets")


VPN_FRAMES = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'wireguard' ELSE 'openvpn' END AS vpn, 3 AS confidence, 'udp' AS transport, CASE page_id % 3 WHEN 0 THEN 2 ELSE 1 END AS packets, 1 AS fwd_packets FROM pages WHERE page_id % 3 <> 2"


def wireguard_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WireGuard rule as a column, over made payloads of documents."""
    n = F.col("doc_id")
    payload = F.concat(F.unhex(F.concat(F.lpad(F.hex(n % 6), 2, "0"), F.lit("000000"))), F.repeat(F.lit("x"), F.when(n % 6 == 1, 144).when(n % 6 == 2, 88).when(n % 6 == 3, 61).otherwise((n % 50 + 28).cast("int"))).cast("binary"))
    df = views.table(spark, sf_dir, "documents").select("doc_id", payload.cast(BinaryType()).alias("p"))
    return df.select("doc_id", classifiers.wireguard_column(F.col("p"), F.lit(17)).alias("confidence"))


WIREGUARD_NATIVE = "SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 2) THEN 3 WHEN doc_id % 6 = 4 AND doc_id % 50 % 16 = 0 THEN 3 ELSE 0 END AS confidence FROM documents"


def im_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hellos for hosts of pages; every fifth for a messaging service."""
    r = classifiers.im_flows(flows.canonical(_page_packets(spark, sf_dir, 443, 6, lambda page, url: [(True, build.client_hello("web.telegram.org" if page % 5 == 0 else _host(url)))])))
    return r.select(_client_page(r), "app", "confidence", "sni", "packets")


IM_FRAMES = "SELECT page_id, 'telegram' AS app, 3 AS confidence, 'web.telegram.org' AS sni, 1 AS packets FROM pages WHERE page_id % 5 = 0"

QUERIES = {"frame_parse": frame_parse, "frame_layers": frame_layers, "frame_flows": frame_flows, "http_frames": http_frames, "dns_frames": dns_frames, "tls_frames": tls_frames, "vpn_frames": vpn_frames, "wireguard_native": wireguard_native, "im_frames": im_frames}
ORACLES = {"frame_parse": FRAME_PARSE, "frame_layers": FRAME_LAYERS, "frame_flows": FRAME_FLOWS, "http_frames": HTTP_FRAMES, "dns_frames": DNS_FRAMES, "tls_frames": TLS_FRAMES, "vpn_frames": VPN_FRAMES, "wireguard_native": WIREGUARD_NATIVE, "im_frames": IM_FRAMES}
