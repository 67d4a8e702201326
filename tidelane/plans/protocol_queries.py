"""Queries over made frames and conversations of every protocol: page n speaks the protocol's variant n % k, and the SQL says what must come out."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionaries, filters
from ..functions.batches import joined, pieces
from ..operators import classifiers, flows, l7, merge, reassembly, sinks
from ..sources import build, captures, headers, layers, views
from .analyze import flow_packets, flow_table
from ..sources.build import _vector
from .frame_queries import _HOST, _client_page, _host, _page_packets

#: A page's client address in SQL.
CLIENT = "concat('10.', CAST(page_id // 65536 AS VARCHAR), '.', CAST(page_id // 256 % 256 AS VARCHAR), '.', CAST(page_id % 256 AS VARCHAR))"


def _client(page: int) -> str:
    return f"10.{page >> 16}.{page >> 8 & 255}.{page & 255}"


def _ip4(src: str, dst: str, protocol: int, body: bytes, number: int = 1, fragment: int = 0) -> bytes:
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), number, fragment, 64, protocol, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def _ip6(page: int, kind: int, body: bytes) -> bytes:
    return struct.pack("!IHBB", 6 << 28, len(body), kind, 61) + bytes.fromhex("20010db8") + bytes(8) + struct.pack("!I", page + 1) + bytes.fromhex("20010db8") + bytes(11) + b"\xff" + body


def _udp(sport: int, dport: int, body: bytes = b"") -> bytes:
    return struct.pack("!HHHH", sport, dport, 8 + len(body), 0) + body


def _eth(body: bytes, kind: int = 0x0800) -> bytes:
    return b"\x02\0\0\0\0\x02\x02\0\0\0\0\x01" + struct.pack("!H", kind) + body


def _raw_pages(spark: SparkSession, sf_dir: str, make: Callable[[int, str], list[tuple[int, bytes]]]) -> DataFrame:
    """Raw packets that ``make(page, url)`` says, as (link type, frame); packet k of page n has the number 16 n + k."""
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))

    def expand(batches):
        def made(rows):
            for r in rows:
                for k, (link, b) in enumerate(make(r["page_id"], r["url"])):
                    yield {"file": "pages", "pkt_no": r["page_id"] * 16 + k, "ts_us": r["page_id"] * 1_000_000 + k * 2000, "link_type": link, "caplen": len(b), "wirelen": len(b), "data": b}

        for rows in pieces(batches):
            yield from joined(made(rows), captures.RAW_ARROW)

    return pages.mapInArrow(expand, captures.RAW_SCHEMA)


def _page(df: DataFrame) -> DataFrame:
    return df.withColumn("page_id", F.expr("pkt_no div 16"))


def _case(n: int, *values: str, of: str = "page_id") -> str:
    return f"CASE {of} % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _of_client(r: DataFrame) -> DataFrame:
    """Flows whose first packet may be the server's, with the client's address."""
    return r.withColumn("client", F.when(F.col("src_ip") == "192.0.2.10", F.col("dst_ip")).otherwise(F.col("src_ip")))


# ---- links, tunnels, filters ----


def _link_frame(page: int, url: str) -> list[tuple[int, bytes]]:
    inner = _ip4(_client(page), "192.0.2.10", 17, _udp(40000, 7))
    sll = struct.pack("!HHH", 4, 1, 6) + b"\x02\0\0\0\0\x01\0\0\x08\0"
    options = [
        (1, _eth(struct.pack("!HH", 3 << 13 | page % 4000 + 1, 0x0800) + inner, 0x8100)), (113, sll + inner), (276, struct.pack("!HHIHBB", 0x0800, 0, 1, 1, 4, 6) + b"\x02\0\0\0\0\x01\0\0" + inner), (101, inner), (101, _ip6(page, 17, _udp(40000, 7))),
        (0, b"\2\0\0\0" + inner), (239, b"\2\0\0\0" + struct.pack("<HH", 4 + len(inner), 9) + inner), (1, _eth(struct.pack("!HHBBH", 1, 0x0800, 6, 4, 1 + page % 2) + b"\x02\0\0\0\0\x01" + bytes(map(int, _client(page).split("."))) + bytes(6) + b"\xc0\0\2\n", 0x0806)),
        (1, _eth(_ip4(_client(page), "192.0.2.10", 1, struct.pack("!BBHI", 8, page % 3, 0, 0)))), (1, _eth(_ip6(page, 0, struct.pack("!BB", 58, 0) + bytes(6) + struct.pack("!BBHI", 128, 0, 0, 0)), 0x86DD)),
    ]
    return [options[page % 10]]


def link_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a page on ten kinds of links: VLAN, cooked (both versions), raw, loopback, NFLOG, ARP, ICMP, ICMPv6 behind an extension header."""
    df = layers.stack(layers.packets(_raw_pages(spark, sf_dir, _link_frame), ["eth", "vlan", "sll", "arp", "ip", "ip6", "udp", "icmp", "icmp6"]))
    return _page(df).select("page_id", F.array_join("protocol_stack", "/").alias("stack"), F.coalesce("src_ip", "arp.sender_ip").alias("source"), F.col("vlan_id").cast("bigint").alias("vlan_id"), F.col("vlan.priority").alias("priority"), "arp.opcode", F.coalesce("icmp.type", "icmp6.type").alias("icmp_type"), F.col("icmp.code").alias("icmp_code"), "ip6.hop_limit", F.col("ip_hdr").alias("ip_header"))


_IP6 = "concat('2001:db8::', CASE WHEN page_id + 1 > 65535 THEN concat(lower(printf('%x', (page_id + 1) // 65536)), ':') ELSE '' END, lower(printf('%x', (page_id + 1) % 65536)))"
_S6, _NULL = _IP6, "NULL"
LINK_FRAMES = f"""SELECT page_id, {_case(10, "'eth/vlan/ip/udp'", "'sll/ip/udp'", "'sll/ip/udp'", "'ip/udp'", "'ip6/udp'", "'ip/udp'", "'ip/udp'", "'eth/arp'", "'eth/ip/icmp'", "'eth/ip6/icmp6'")} AS stack,
  CASE WHEN page_id % 10 IN (4, 9) THEN {_S6} ELSE {CLIENT} END AS source, CASE WHEN page_id % 10 = 0 THEN page_id % 4000 + 1 ELSE 0 END AS vlan_id, CASE WHEN page_id % 10 = 0 THEN 3 END AS priority,
  CASE WHEN page_id % 10 = 7 THEN 1 + page_id % 2 END AS opcode, CASE page_id % 10 WHEN 8 THEN 8 WHEN 9 THEN 128 END AS icmp_type, CASE WHEN page_id % 10 = 8 THEN page_id % 3 END AS icmp_code,
  CASE WHEN page_id % 10 IN (4, 9) THEN 61 END AS hop_limit, CASE page_id % 10 WHEN 4 THEN 40 WHEN 7 THEN 0 WHEN 9 THEN 48 ELSE 20 END AS ip_header FROM pages"""


def link_filter(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Pages whose frame passes a filter, by raw headers first and the parsed layers then."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = filters.parse(text)
        df = layers.packets(headers.plainly_kept(_raw_pages(spark, sf_dir, _link_frame), tree), ["arp", "vlan", "dhcp"])
        return _page(df.filter(filters.compiled(tree, df.columns))).select("page_id")

    return query


LINK_FILTERS = {
    "link_filter_arp": ("arp", "page_id % 10 = 7"), "link_filter_ip": ("ip", "page_id % 10 IN (0, 1, 2, 3, 5, 6, 8)"), "link_filter_ipv6": ("ipv6 and not icmpv6", "page_id % 10 = 4"),
    "link_filter_vlan": ("vlan or icmp", "page_id % 10 IN (0, 8)"), "link_filter_empty": ("", "TRUE"), "link_filter_default": (filters.DEFAULT_FILTER, "page_id % 10 NOT IN (7, 8, 9)"),
}


def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(_raw_pages(spark, sf_dir, _link_frame)).groupBy("link_type").agg(F.count(F.lit(1)).alias("frames")).select(F.col("link_type").cast("bigint").alias("link_type"), dictionaries.named(F.col("link_type"), dictionaries.LINK_TYPES, F.lit("unknown")).alias("name"), "frames")


LINK_NAMES = f"SELECT link_type, CASE link_type WHEN 0 THEN 'loopback' WHEN 1 THEN 'ethernet' WHEN 101 THEN 'raw_ip' WHEN 113 THEN 'linux_sll' WHEN 239 THEN 'nflog' ELSE 'unknown' END AS name, count(*) AS frames FROM (SELECT CAST({_case(10, '1', '113', '276', '101', '101', '0', '239', '1', '1', '1')} AS BIGINT) AS link_type FROM pages) GROUP BY link_type"


def tunnel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRE with a key, VXLAN, MPLS with two labels and IP in IP: the inner packet replaces the outer one."""

    def make(page: int, url: str) -> list[tuple[int, bytes]]:
        inner = _ip4(_client(page), "203.0.113.9", 17, _udp(1111, 2222, b"abc"))
        options = [_ip4("192.0.2.1", "192.0.2.2", 47, struct.pack("!HHI", 0x2000, 0x0800, page) + inner), _ip4("192.0.2.1", "192.0.2.2", 17, _udp(5, 4789, b"\x08\0\0\0" + page.to_bytes(3, "big") + b"\0" + _eth(inner))), None, _ip4("192.0.2.1", "192.0.2.2", 4, inner)]
        return [(1, _eth(struct.pack("!II", 17 << 12 | 64, page % 1000 << 12 | 1 << 8 | 63) + inner, 0x8847))] if page % 4 == 2 else [(1, _eth(options[page % 4]))]

    df = layers.packets(_raw_pages(spark, sf_dir, make), ["gre", "vxlan", "mpls"])
    return _page(df).select("page_id", "src_ip", "dst_port", "app_len", "gre.key", "vxlan.vni", "mpls.label", "mpls.stack_depth")


TUNNEL_FRAMES = f"SELECT page_id, {CLIENT} AS src_ip, 2222 AS dst_port, 3 AS app_len, CASE WHEN page_id % 4 = 0 THEN page_id END AS key, CASE WHEN page_id % 4 = 1 THEN page_id END AS vni, CASE WHEN page_id % 4 = 2 THEN page_id % 1000 END AS label, CASE WHEN page_id % 4 = 2 THEN 2 END AS stack_depth FROM pages"


def parse_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hello, query and Initial at three depths: which layers are there."""
    hello = build.client_hello("a.example")

    def make(page: int, url: str) -> list[tuple[int, bytes]]:
        data = [(6, 443, hello), (17, 53, build.dns_message(page, "a.example"))][page % 2]
        return [(1, build.frame(_client(page), 40000, "192.0.2.10", data[1], data[0], data[2]))]

    out = None
    for depth in layers.DEPTHS:
        df = layers.packets(_raw_pages(spark, sf_dir, make), ["tls", "dns"], depth)
        part = _page(df).select("page_id", F.lit(depth).alias("depth"), F.col("tls").isNotNull().alias("tls"), F.col("dns").isNotNull().alias("dns"))
        out = part if out is None else out.unionByName(part)
    return out


PARSE_DEPTHS = "SELECT page_id, depth, page_id % 2 = 0 AND depth = 'full' AS tls, page_id % 2 = 1 AND depth <> 'none' AS dns FROM pages, (SELECT unnest(['full', 'port_only', 'none']) AS depth)"

# ---- conversations ----


def _dhcp(page: int, kind: int, yours: bool) -> bytes:
    head = struct.pack("!BBBBIHH", 2 if yours else 1, 1, 6, 0, page, 0, 0) + bytes(4) + (bytes(map(int, _client(page).split("."))) if yours else bytes(4)) + bytes(8) + b"\x02\0" + page.to_bytes(4, "big") + bytes(10) + bytes(192) + b"\x63\x82\x53\x63"
    more = b"\x36\x04\xc0\0\2\x01\x33\x04" + struct.pack("!I", 3600 + page) if yours else b"\x0c" + _vector(f"pc{page}".encode(), 1) + b"\x3c\x04test"
    return head + bytes([53, 1, kind]) + more + b"\xff"


def dhcp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discover, offer, request; every third page gets no acknowledgement."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        return [(True, _dhcp(page, 1, False)), (False, _dhcp(page, 2, True)), (True, _dhcp(page, 3, False))] + ([(False, _dhcp(page, 5, True))] if page % 3 else [])

    r = l7.metadata(_page_packets(spark, sf_dir, 67, 17, talk), "dhcp")
    return r.select(_client_page(r), "messages", "discover_count", "offer_count", "request_count", "ack_count", "mac", "hostname", "vendor", "assigned_ip", "server_ip", "lease_secs")


DHCP_FRAMES = f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 4 END AS messages, 1 AS discover_count, 1 AS offer_count, 1 AS request_count, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS ack_count, concat('02:00:', regexp_replace(printf('%08x', page_id), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4')) AS mac, concat('pc', CAST(page_id AS VARCHAR)) AS hostname, 'test' AS vendor, {CLIENT} AS assigned_ip, '192.0.2.1' AS server_ip, 3600 + page_id AS lease_secs FROM pages"


def dhcp_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DHCP and DHCPv6 as layers."""

    def make(page: int, url: str) -> list[tuple[int, bytes]]:
        return [(1, _eth(_ip4("0.0.0.0", "255.255.255.255", 17, _udp(68, 67, _dhcp(page, 1, False))))), (1, _eth(_ip6(page, 17, _udp(546, 547, struct.pack("!I", 1 + page % 3 << 24 | page) + b"\0\1\0\0")), 0x86DD))]

    df = layers.packets(_raw_pages(spark, sf_dir, make), ["dhcp", "dhcpv6"])
    return _page(df).groupBy("page_id").agg(F.max("dhcp.op").alias("op"), F.max("dhcp.xid").alias("xid"), F.max("dhcp.chaddr").alias("chaddr"), F.max("dhcpv6.msg_type").alias("msg_type"), F.max("dhcpv6.transaction_id").alias("transaction_id"))


DHCP_LAYERS = "SELECT page_id, 1 AS op, page_id AS xid, concat('02:00:', regexp_replace(printf('%08x', page_id), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4')) AS chaddr, 1 + page_id % 3 AS msg_type, page_id % 16777216 AS transaction_id FROM pages"


def _ssh_packet(body: bytes) -> bytes:
    return struct.pack("!IB", len(body) + 5, 4) + body + bytes(4)


def _kex(*lists: str) -> bytes:
    names = list(lists) + ["none"] * (8 - len(lists)) + ["", ""]
    return _ssh_packet(b"\x14" + bytes(16) + b"".join(_vector(n.encode(), 4) for n in names) + bytes(5))


def ssh_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banners, key exchange with a host key and new keys; on odd pages the server knows only the older exchange."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        server = ("curve25519-sha256", "diffie-hellman-group14-sha256")[page % 2]
        key = _vector(_vector(b"ssh-ed25519", 4) + _vector(bytes(32), 4), 4)
        return [
            (True, f"SSH-2.0-probe_{page % 9}\r\n".encode()), (False, b"SSH-2.0-srv\r\n"), (True, _kex("curve25519-sha256,diffie-hellman-group14-sha256", "ssh-ed25519", "aes128-ctr,aes256-ctr", "aes128-ctr")),
            (False, _kex(server, "ssh-ed25519", "aes256-ctr", "aes256-ctr,aes128-ctr")), (True, _ssh_packet(b"\x1e" + bytes(36))), (False, _ssh_packet(b"\x1f" + key + bytes(36)) + _ssh_packet(b"\x15")), (True, _ssh_packet(b"\x15")), (True, bytes(64)),
        ]

    r = l7.metadata(_page_packets(spark, sf_dir, 22, 6, talk), "ssh")
    return r.select(_client_page(r), "cli_banner", "srv_banner", "state", "neg_kex", "kex_type", "neg_enc_c2s", "neg_enc_s2c", "host_key_type", "pkts_total", "bytes_post_enc")


SSH_FRAMES = "SELECT page_id, concat('SSH-2.0-probe_', CAST(page_id % 9 AS VARCHAR)) AS cli_banner, 'SSH-2.0-srv' AS srv_banner, 'ENCRYPTED' AS state, CASE WHEN page_id % 2 = 0 THEN 'curve25519-sha256' ELSE 'diffie-hellman-group14-sha256' END AS neg_kex, CASE WHEN page_id % 2 = 0 THEN 'ecdh' ELSE 'dh-group' END AS kex_type, 'aes256-ctr' AS neg_enc_c2s, 'aes128-ctr' AS neg_enc_s2c, 'ssh-ed25519' AS host_key_type, 8 AS pkts_total, 64 AS bytes_post_enc FROM pages"


def mqtt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connect, acknowledgement, a subscription and as many publications as the page's number says."""

    def control(kind: int, body: bytes) -> bytes:
        return bytes([kind << 4, len(body)]) + body

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        connect = _vector(b"MQTT", 2) + b"\x04\x02" + struct.pack("!H", 60 + page % 5) + _vector(f"dev{page}".encode(), 2)
        sub = b"\0\1" + _vector(b"t/" + str(page % 7).encode(), 2) + b"\0"
        return [(True, control(1, connect)), (False, control(2, bytes([0, page % 6]))), (True, control(8, sub)), (False, control(9, b"\0\1" + (b"\x80" if page % 4 == 0 else b"\1")))] + [(False, control(3, _vector(b"t/x", 2) + b"hi"))] * (page % 5)

    r = l7.metadata(_page_packets(spark, sf_dir, 1883, 6, talk), "mqtt")
    return r.select(_client_page(r), "protocol_name", "protocol_version", "client_id", "keep_alive_secs", "clean_session", "connack_return_code", "publishes", F.array_join("sub_topics", ",").alias("sub_topics"), "granted", "refused", "pkts_cli", "pkts_srv")


MQTT_FRAMES = "SELECT page_id, 'MQTT' AS protocol_name, '3.1.1' AS protocol_version, concat('dev', CAST(page_id AS VARCHAR)) AS client_id, 60 + page_id % 5 AS keep_alive_secs, 1 AS clean_session, page_id % 6 AS connack_return_code, page_id % 5 AS publishes, concat('t/', CAST(page_id % 7 AS VARCHAR)) AS sub_topics, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS granted, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS refused, 2 AS pkts_cli, 2 + page_id % 5 AS pkts_srv FROM pages"


def sip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invitation, trying, and an answer: busy on every third page; headers in short form on odd ones."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        short = page % 2
        names = ("v", "f", "t", "i") if short else ("Via", "From", "To", "Call-ID")
        common = f"{names[0]}: SIP/2.0/UDP a\r\n{names[1]}: <sip:a{page}@x>\r\n{names[2]}: <sip:b@y>\r\n{names[3]}: c{page}\r\nCSeq: 1 INVITE\r\n"
        code = "486 Busy Here" if page % 3 == 0 else "200 OK"
        return [(True, f"INVITE sip:b@y SIP/2.0\r\n{common}User-Agent: ua\r\n\r\nv=0\r\nm=audio 1 RTP\r\nm=video 2 RTP\r\n".encode()), (False, f"SIP/2.0 100 Trying\r\n{common}\r\n".encode()), (False, f"SIP/2.0 {code}\r\n{common}Server: srv\r\n\r\n".encode())]

    r = l7.metadata(_page_packets(spark, sf_dir, 5060, 17, talk), "sip")
    return r.select(_client_page(r), "method", "status_code", "status_reason", "call_id", "from_uri", "to_uri", "user_agent", "server", "messages", "transactions", "resp_1xx", "resp_2xx", "resp_4xx", "via_hops", "sdp_media_cnt")


SIP_FRAMES = "SELECT page_id, 'INVITE' AS method, CASE WHEN page_id % 3 = 0 THEN 486 ELSE 200 END AS status_code, CASE WHEN page_id % 3 = 0 THEN 'Busy Here' ELSE 'OK' END AS status_reason, concat('c', CAST(page_id AS VARCHAR)) AS call_id, concat('sip:a', CAST(page_id AS VARCHAR), '@x') AS from_uri, 'sip:b@y' AS to_uri, 'ua' AS user_agent, 'srv' AS server, 3 AS messages, 1 AS transactions, 1 AS resp_1xx, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS resp_2xx, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS resp_4xx, 1 AS via_hops, 2 AS sdp_media_cnt FROM pages"


def rdp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection request with a cookie, confirmation or refusal, the client's core data."""

    def tpkt(body: bytes) -> bytes:
        return b"\x03\0" + struct.pack("!H", 4 + len(body)) + body

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        cookie = f"Cookie: mstshash=u{page}\r\n".encode()
        request = tpkt(bytes([6 + len(cookie) + 8, 0xE0]) + bytes(5) + cookie + b"\1\0\x08\0" + struct.pack("<I", 1 + page % 3))
        if page % 5 == 0:
            return [(True, request), (False, tpkt(b"\x0e\xd0" + bytes(5) + b"\3\0\x08\0" + struct.pack("<I", 2)))]
        core = b"\x01\xc0" + struct.pack("<H", 200) + struct.pack("<IHHHH", 0x80004, 800 + page % 100, 600, 0xCA03, 0) + bytes(8) + "host".encode("utf-16-le").ljust(32, b"\0") + bytes(40)
        return [(True, request), (False, tpkt(b"\x0e\xd0" + bytes(5) + b"\2\0\x08\0" + struct.pack("<I", 1))), (True, tpkt(b"\x02\xf0\x80" + core))]

    r = l7.metadata(_page_packets(spark, sf_dir, 3389, 6, talk), "rdp")
    return r.select(_client_page(r), "seen_cr", "seen_cc", "seen_dt", "cookie", "req_protocols", "sel_protocol", "neg_failure", "client_name", "desktop_width", "desktop_height", "color_depth")


_GOOD = "page_id % 5 <> 0"
RDP_FRAMES = f"SELECT page_id, TRUE AS seen_cr, TRUE AS seen_cc, {_GOOD} AS seen_dt, concat('u', CAST(page_id AS VARCHAR)) AS cookie, 1 + page_id % 3 AS req_protocols, CASE WHEN {_GOOD} THEN 1 ELSE 0 END AS sel_protocol, NOT ({_GOOD}) AS neg_failure, CASE WHEN {_GOOD} THEN 'host' END AS client_name, CASE WHEN {_GOOD} THEN 800 + page_id % 100 ELSE 0 END AS desktop_width, CASE WHEN {_GOOD} THEN 600 ELSE 0 END AS desktop_height, CASE WHEN {_GOOD} THEN 16 ELSE 0 END AS color_depth FROM pages"


def vnc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handshakes with a password; on every fourth page it is wrong."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        out = [(False, b"RFB 003.008\n"), (True, b"RFB 003.008\n"), (False, b"\x02\x01\x02"), (True, b"\x02"), (False, bytes(16)), (True, bytes(16)), (False, b"\0\0\0\1" if page % 4 == 0 else bytes(4))]
        return out if page % 4 == 0 else [*out, (True, b"\1"), (False, struct.pack("!HH", 640 + page % 10, 480) + bytes(16) + _vector(f"desk{page}".encode(), 4))]

    r = l7.metadata(_page_packets(spark, sf_dir, 5900, 6, talk), "vnc")
    r = _of_client(r)
    return r.select(_client_page(r, "client"), "proto_version", "state", F.array_join(F.transform("security_types", lambda x: x.cast("string")), ",").alias("security_types"), "chosen_security", "auth_ok", "width", "height", "desktop_name")


VNC_FRAMES = "SELECT page_id, '3.8' AS proto_version, CASE WHEN page_id % 4 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS state, '1,2' AS security_types, 2 AS chosen_security, page_id % 4 <> 0 AS auth_ok, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 640 + page_id % 10 END AS width, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 480 END AS height, CASE WHEN page_id % 4 <> 0 THEN concat('desk', CAST(page_id AS VARCHAR)) END AS desktop_name FROM pages"


def quic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long headers of three kinds, then short ones; every fifth page begins with a version negotiation."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        dcid, scid = page.to_bytes(8, "big"), b"\x07" * 4
        ends = _vector(dcid, 1) + _vector(scid, 1)
        long = [(kind == 0, bytes([0xC0 | kind << 4]) + b"\0\0\0\1" + ends + b"\0" * 24) for kind in (0, 2, 2)]
        first = [(False, b"\xc0" + bytes(4) + ends + b"\0\0\0\1")] if page % 5 == 0 else []
        return first + long + [(False, bytes([0x40 | (page % 2) << 5]) + dcid + bytes(20))] * (page % 4)

    r = l7.metadata(_page_packets(spark, sf_dir, 443, 17, talk), "quic")
    r = _of_client(r)
    return r.select(_client_page(r, "client"), "version", "version_hex", "n_total", "n_initial", "n_handshake", "n_short", "seen_version_neg", "first_dcid", "first_scid", "spin_bit")


QUIC_FRAMES = "SELECT page_id, 'v1' AS version, '0x00000001' AS version_hex, CASE WHEN page_id % 5 = 0 THEN 4 ELSE 3 END + page_id % 4 AS n_total, 1 AS n_initial, 2 AS n_handshake, page_id % 4 AS n_short, page_id % 5 = 0 AS seen_version_neg, printf('%016x', page_id) AS first_dcid, '07070707' AS first_scid, CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % 2 END AS spin_bit FROM pages"


def dns_rdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six kinds, an authority and an EDNS size, as text."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        name = b"\x01a\x02bc\0"
        data = [(1, bytes([192, 0, 2, page % 256])), (28, bytes(15) + bytes([1 + page % 9])), (5, name), (15, struct.pack("!H", page % 100) + name), (16, b"\x03abc\x02de"), (33, struct.pack("!HHH", 1, 2, page % 1000) + name)][page % 6]
        question = name + struct.pack("!HH", data[0], 1)
        answer = b"\xc0\x0c" + struct.pack("!HHIH", data[0], 1, 300, len(data[1])) + data[1]
        ns = b"\xc0\x0c" + struct.pack("!HHIH", 2, 1, 60, len(name)) + name
        opt = b"\0" + struct.pack("!HHIH", 41, 1232 + page % 3, 0, 0)
        return [(True, struct.pack("!HHHHHH", page & 0xFFFF, 0x100, 1, 0, 0, 1) + question + opt), (False, struct.pack("!HHHHHH", page & 0xFFFF, 0x8180, 1, 1, 1, 0) + question + answer + ns)]

    r = l7.metadata(_page_packets(spark, sf_dir, 53, 17, talk), "dns")
    return r.select(_client_page(r), F.element_at("messages", 2).alias("answer"), "ns_records", "edns_size")


_RDATA = _case(6, "concat('A 192.0.2.', CAST(page_id % 256 AS VARCHAR))", "concat('AAAA ::', CAST(1 + page_id % 9 AS VARCHAR))", "'CNAME a.bc'", "concat('MX ', CAST(page_id % 100 AS VARCHAR), ' a.bc')", "'TXT abcde'", "concat('SRV 1 2 ', CAST(page_id % 1000 AS VARCHAR), ' a.bc')")
_RTYPE = _case(6, "'A'", "'AAAA'", "'CNAME'", "'MX'", "'TXT'", "'SRV'")
DNS_RDATA = f"SELECT page_id, concat('R ', CAST(page_id % 65536 AS VARCHAR), ' QUERY NOERROR a.bc ', {_RTYPE}, ' a.bc 300 ', {_RDATA}, '; a.bc 60 NS a.bc') AS answer, 1 AS ns_records, 1232 + page_id % 3 AS edns_size FROM pages"

# ---- reassembly ----


def analyze_tls_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's hello over one to three segments, with the server's in another: what flows say in the end."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        hello = build.client_hello(_host(url), (0x1301 + page % 3,))
        cuts = [0, *((), (40,), (7, 60))[page % 3], len(hello)]
        server = b"\x16\x03\x03\0\x2a\x02\0\0\x26\x03\x03" + bytes(32) + b"\0" + struct.pack("!H", 0x1301 + page % 3) + b"\0"
        return [(True, hello[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] + [(False, server[:20]), (False, server[20:])]

    packets = _page_packets(spark, sf_dir, 443, 6, talk)
    step = F.sum(F.length("payload")).over(Window.partitionBy("src_ip", "dst_ip").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1))
    df = layers.packets(build.frames_of(packets.withColumn("tcp_seq", F.coalesce(step, F.lit(0)) + 1)), ["tls"])
    r = flow_table(flow_packets(df.drop("file", "vlan_id")), statistics=False)
    return r.select(_client_page(r), "packet_count", "tls.sni", F.element_at("tls.cipher_suites", 1).alias("cipher_offered"), "tls.cipher_suite", F.array_join(F.transform("tls.handshake_types", lambda x: x.cast("string")), ",").alias("handshakes"), F.array_join("ext_protocol", "/").alias("ext_protocol"))


ANALYZE_TLS_SPLIT = f"SELECT page_id, 3 + page_id % 3 AS packet_count, {_HOST} AS sni, 4865 + page_id % 3 AS cipher_offered, 4865 + page_id % 3 AS cipher_suite, '1,2' AS handshakes, 'IPv4/TCP/TLS/HTTPS' AS ext_protocol FROM pages"


def tcp_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url in segments of five bytes out of order, some sent twice: the stream is the url."""

    def expand(batches):
        for batch in batches:
            rows = []
            for p, u, c in zip(batch["page_id"], batch["url"], batch["client"], strict=True):
                data = u.encode()
                parts = [(at, data[at : at + 5]) for at in range(0, len(data), 5)]
                parts = parts[:1] + parts[1:][::-1] + parts[2:3]
                rows += [(p, p * 1000 + k, c, 1000 + at, x) for k, (at, x) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["page_id", "pkt_no", "client", "tcp_seq", "payload"])

    pages = views.table(spark, sf_dir, "pages").filter("url is not null").select("page_id", "url", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("client"))
    rows = pages.mapInPandas(expand, "page_id bigint, pkt_no bigint, client string, tcp_seq bigint, payload binary")
    df = rows.select("pkt_no", F.col("client").alias("src_ip"), F.lit("server").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(24).alias("tcp_flags"), "tcp_seq", "payload")
    r = reassembly.tcp_streams(flows.oriented(df))
    return r.select(F.regexp_extract("flow", "p([0-9]+)", 1).cast("bigint").alias("page_id"), F.col("data").cast("string").alias("url"), "segments", "missing")


TCP_STREAM_TEXT = "SELECT page_id, url, CAST(ceil(length(url) / 5.0) AS BIGINT) + CASE WHEN length(url) > 10 THEN 1 ELSE 0 END AS segments, 0 AS missing FROM pages WHERE url IS NOT NULL"


def ip_fragment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url as a datagram in fragments of eight bytes; every fourth lacks one."""
    pages = views.table(spark, sf_dir, "pages").filter("url is not null").select("page_id", "url", F.explode(F.expr("sequence(0, (length(url) - 1) div 8)")).alias("k"))
    rows = pages.select(
        (F.col("page_id") * 1000 + F.pmod(F.col("k") * 7, F.lit(1000))).alias("pkt_no"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src_ip"), F.lit("server").alias("dst_ip"), F.lit(17).alias("protocol"), F.lit(9).alias("ip_id"), (F.col("k") * 8).cast("bigint").alias("offset"),
        (F.col("k") < F.expr("(length(url) - 1) div 8")).alias("more"), F.expr("substring(url, k * 8 + 1, 8)").cast("binary").alias("payload"), "page_id", "k",
    )
    r = reassembly.ip_fragments(rows.filter("not (page_id % 4 = 0 and k = 1)"))
    return r.select(F.substring("src_ip", 2, 20).cast("bigint").alias("page_id"), F.col("payload").cast("string").alias("url"), F.col("n_fragments").cast("bigint").alias("n_fragments"))


IP_FRAGMENT_TEXT = "SELECT page_id, url, CAST((length(url) - 1) // 8 + 1 AS BIGINT) AS n_fragments FROM pages WHERE url IS NOT NULL AND (page_id % 4 <> 0 OR length(url) <= 8) AND length(url) > 0"


def tls_record_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each direction from reassembled streams: a hello whose second part comes first, and a record that is cut off."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        return [(True, build.client_hello(_host(url)) + b"\x14\x03\x03\0\1\1" + b"\x17\x03\x03\0\x09" + bytes(page % 9))]

    packets = flows.oriented(_page_packets(spark, sf_dir, 443, 6, talk))
    r = reassembly.tls_records(packets)
    return r.select((F.regexp_extract("flow", r"10\.(\d+)", 1).cast("bigint") * 65536 + F.regexp_extract("flow", r"10\.\d+\.(\d+)", 1).cast("bigint") * 256 + F.regexp_extract("flow", r"10\.\d+\.\d+\.(\d+)", 1).cast("bigint")).alias("page_id"), "sni", F.array_join(F.transform("record_types", lambda x: x.cast("string")), ",").alias("record_types"), "left_over")


TLS_RECORD_STREAMS = f"SELECT page_id, {_HOST} AS sni, '22,20' AS record_types, 5 + page_id % 9 AS left_over FROM pages"


def capture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows split into captures of their own, and those read back: packets, bytes and times by flow."""
    packets = views.addressed(views.packets_from_events(views.table(spark, sf_dir, "events")))
    raw = build.frames_of(packets.withColumn("payload", F.repeat(F.lit("x"), F.col("app_len").cast("int")).cast("binary")), "t")
    split = sinks.split_captures(raw, views.labelled(layers.packets(raw, []).drop("vlan_id")))

    def read(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                found = list(captures.packets_in(bytes(content)))
                rows.append((name, len(found), sum(x[2] for x in found), min(x[0] for x in found), sum(len(x[3]) for x in found)))
            yield pd.DataFrame(rows, columns=["name", "packets", "wire_bytes", "first_us", "captured_bytes"])

    return split.select("name", "content").mapInPandas(read, "name string, packets bigint, wire_bytes bigint, first_us bigint, captured_bytes bigint")


_FRAME = "app_len + CASE WHEN protocol = 6 THEN 54 ELSE 42 END"
CAPTURE_ROUND_TRIP = f"""WITH {views.EVENTS_SQL}, f AS (SELECT *, CASE WHEN (src_ip, src_port) > (dst_ip, dst_port) THEN concat(dst_ip, src_ip, src_port, dst_port) ELSE concat(src_ip, dst_ip, dst_port, src_port) END AS flow FROM pk)
SELECT concat('t_', arg_min(src_ip, pkt_no), '_', arg_min(src_port, pkt_no), '_', arg_min(dst_ip, pkt_no), '_', arg_min(dst_port, pkt_no), '_', min(protocol), '.pcap') AS name, count(*) AS packets,
  CAST(sum({_FRAME}) AS BIGINT) AS wire_bytes, min(ts_us) AS first_us, CAST(sum({_FRAME}) AS BIGINT) AS captured_bytes FROM f GROUP BY flow"""

# ---- classifiers ----

_MIXED = bytes((k * 167 + 13) % 256 for k in range(128))  # 128 different bytes: seven bits of entropy each


def vpn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of eleven kinds, each classified by itself."""

    def talk(page: int, url: str) -> tuple[int, int, bytes]:
        return [
            (17, 51820, b"\1\0\0\0" + bytes(144)), (17, 1194, b"\x38" + bytes(13)), (17, 8443, b"\xc3\0\0\0\1\x08" + bytes(8) + b"\0" + bytes(1185)), (6, 22, b"SSH-2.0-x\r\n"), (6, 80, b"GET / HTTP/1.1\r\nX-Lantern-Version: 1\r\n\r\n"), (6, 7890, b"abcd"),
            (6, 80, b"GET / HTTP/1.1\r\nUpgrade: websocket\r\n\r\n"), (6, 8388, _MIXED), (6, 443, b"\x16\x03\x01\0\5\1\0\0\1\0"), (6, 80, b"GET / HTTP/1.1\r\nHost: a.b\r\n\r\n"), (6, 80, b"GET / HTTP/1.1\r\nX-Psiphon-Address: 1\r\n\r\n"),
        ][page % 11]

    return _by_payload(spark, sf_dir, talk, classifiers.vpn_packets, "vpn", "confidence", "transport")


def _by_payload(spark: SparkSession, sf_dir: str, talk: Callable[[int, str], tuple[int, int, bytes]], classify: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))

    def expand(batches):
        for batch in batches:
            yield pd.DataFrame([(int(p), *talk(int(p), u)) for p, u in zip(batch["page_id"], batch["url"], strict=True)], columns=["pkt_no", "protocol", "dst_port", "payload"])

    rows = pages.mapInPandas(expand, "pkt_no bigint, protocol int, dst_port bigint, payload binary").withColumn("src_port", F.lit(40000).cast("bigint"))
    return classify(rows).select(F.col("pkt_no").alias("page_id"), *columns)


_VPN = (("wireguard", 3, "udp"), ("openvpn", 3, "udp"), ("hysteria", 2, "quic"), ("psiphon", 2, "ssh"), ("lantern", 3, "http"), ("clash", 2, "tcp"), ("vmess", 2, "ws"), ("shadowsocks", 3, "tcp"), ("trojan", 1, "tls"), ("unknown", 0, ""), ("psiphon", 3, "meek"))
VPN_RULES = "SELECT page_id, " + ", ".join(f"{_case(11, *[repr(v[k]) for v in _VPN])} AS {name}" for k, name in enumerate(("vpn", "confidence", "transport"))) + " FROM pages"


def im_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First payloads of eight kinds, as flows."""

    def talk(page: int, url: str) -> list[tuple[bool, bytes]]:
        return [(True, [b"\xef" + bytes(60), b"<?xml version='1.0'?><stream:stream>", b"WA\6\2", b"\x10\x10\0\4MQTT\4\2\0\x3c\0\4abcd", b"GET / HTTP/1.1\r\nHost: gateway.discord.gg\r\nUpgrade: websocket\r\n\r\n", build.client_hello("mmg.whatsapp.net"), b"GET / HTTP/1.1\r\nHost: web.wire.com\r\n\r\n", b"GET / HTTP/1.1\r\nHost: a.b\r\nUser-Agent: Telegram 1\r\n\r\n"][page % 8])]

    r = classifiers.im_flows(flows.canonical(_page_packets(spark, sf_dir, 5222, 6, talk)))
    return r.select(_client_page(r), "app", "confidence", "packets")


_IM = (("telegram_", 3), ("xmpp", 3), ("whatsapp", 3), ("messenger", 2), ("discord", 2), ("whatsapp", 3), ("wire", 3), ("telegram", 2))
IM_RULES = "SELECT page_id, " + _case(8, "'mtproto'", *[repr(a) for a, _ in _IM[1:]]) + " AS app, " + _case(8, *[str(c) for _, c in _IM]) + " AS confidence, 1 AS packets FROM pages"

# ---- flows of the packet view ----


def _kept_flows(drop: Callable[[DataFrame], DataFrame], least: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = drop(views.packets_from_events(views.table(spark, sf_dir, "events")))
        return flows.canonical(df).groupBy("flow").agg(F.count(F.lit(1)).alias("packets"), F.sum("wirelen").alias("bytes")).filter(F.col("packets") >= least)

    return query


_FLOW_KEY = "CASE WHEN (src_ip, src_port) > (dst_ip, dst_port) THEN concat(dst_ip, ':', dst_port, '-', src_ip, ':', src_port) ELSE concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port) END || '/' || protocol"


def _kept_sql(where: str, least: int) -> str:
    return f"WITH {views.EVENTS_SQL} SELECT {_FLOW_KEY} AS flow, count(*) AS packets, CAST(sum(wirelen) AS BIGINT) AS bytes FROM pk WHERE {where} GROUP BY 1 HAVING count(*) >= {least}"


def signed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed sequences of the library as text."""
    df = flows.oriented(views.packets_from_events(views.table(spark, sf_dir, "events")))
    r = flows.sequences(df)
    return r.select("flow", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("packet_lengths", "app_lengths", "iats_us", "tcp_flags", "tcp_window_sizes")])


SIGNED_SEQUENCES = f"""WITH {views.EVENTS_SQL}, f AS (SELECT *, {_FLOW_KEY} AS flow FROM pk), o AS (SELECT *, CASE WHEN (src_ip, src_port) = (first(src_ip) OVER w, first(src_port) OVER w) THEN 1 ELSE -1 END AS d, ts_us - lag(ts_us) OVER w AS gap FROM f WINDOW w AS (PARTITION BY flow ORDER BY pkt_no))
SELECT flow, string_agg(CAST(wirelen * d AS VARCHAR), ',' ORDER BY pkt_no) AS packet_lengths, string_agg(CAST(app_len * d AS VARCHAR), ',' ORDER BY pkt_no) AS app_lengths, coalesce(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY pkt_no), '') AS iats_us,
  coalesce(string_agg(CASE WHEN protocol = 6 THEN CAST(tcp_flags AS VARCHAR) END, ',' ORDER BY pkt_no), '') AS tcp_flags, coalesce(string_agg(CAST(tcp_win AS VARCHAR), ',' ORDER BY pkt_no), '') AS tcp_window_sizes FROM o GROUP BY flow"""


def dns_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS layers of a flow's packets merged: names in the order first seen, the first code that isn't 0."""

    def make(page: int, url: str) -> list[tuple[int, bytes]]:
        def message(name: str, code: int) -> bytes:
            b = bytearray(build.dns_message(page, name, True))
            b[3] = b[3] & 0xF0 | code
            return bytes(b)

        return [(1, build.frame("192.0.2.10", 53, _client(page), 40000, 17, message(n, c))) for n, c in (("b.c", 0), (f"h{page % 5}.c", page % 4), ("b.c", 5))]

    df = layers.packets(_raw_pages(spark, sf_dir, make), ["dns"])
    r = flows.canonical(df.drop("file", "vlan_id")).groupBy("flow").agg(merge.dns_union().alias("dns"), F.first("dst_ip").alias("client"))
    return r.select(_client_page(r, "client"), F.array_join("dns.queries", ",").alias("queries"), "dns.response_code", "dns.question_count", "dns.answer_count")


DNS_MERGE = "SELECT page_id, concat('b.c,h', CAST(page_id % 5 AS VARCHAR), '.c') AS queries, CASE WHEN page_id % 4 = 0 THEN 5 ELSE page_id % 4 END AS response_code, 1 AS question_count, 1 AS answer_count FROM pages"

_TCP_FLAGS = "(tcp_flags & {0}) <> 0"
QUERIES = {
    "link_frames": link_frames, **{name: link_filter(text) for name, (text, _) in LINK_FILTERS.items()}, "link_names": link_names, "tunnel_frames": tunnel_frames, "parse_depths": parse_depths, "dhcp_frames": dhcp_frames, "dhcp_layers": dhcp_layers, "ssh_frames": ssh_frames, "mqtt_frames": mqtt_frames, "sip_frames": sip_frames,
    "rdp_frames": rdp_frames, "vnc_frames": vnc_frames, "quic_frames": quic_frames, "dns_rdata": dns_rdata, "analyze_tls_split": analyze_tls_split, "tcp_stream_text": tcp_stream_text, "ip_fragment_text": ip_fragment_text, "tls_record_streams": tls_record_streams, "capture_round_trip": capture_round_trip,
    "vpn_rules": vpn_rules, "im_rules": im_rules, "filter_rst": _kept_flows(flows.without_resets, 1), "filter_ack": _kept_flows(flows.without_bare_acks, 1), "min_packets": _kept_flows(lambda df: df, 20), "signed_sequences": signed_sequences, "dns_merge": dns_merge,
}
ORACLES = {
    "link_frames": LINK_FRAMES, **{name: f"SELECT page_id FROM pages WHERE {where}" for name, (_, where) in LINK_FILTERS.items()}, "link_names": LINK_NAMES, "tunnel_frames": TUNNEL_FRAMES, "parse_depths": PARSE_DEPTHS, "dhcp_frames": DHCP_FRAMES, "dhcp_layers": DHCP_LAYERS, "ssh_frames": SSH_FRAMES, "mqtt_frames": MQTT_FRAMES,
    "sip_frames": SIP_FRAMES, "rdp_frames": RDP_FRAMES, "vnc_frames": VNC_FRAMES, "quic_frames": QUIC_FRAMES, "dns_rdata": DNS_RDATA, "analyze_tls_split": ANALYZE_TLS_SPLIT, "tcp_stream_text": TCP_STREAM_TEXT, "ip_fragment_text": IP_FRAGMENT_TEXT, "tls_record_streams": TLS_RECORD_STREAMS, "capture_round_trip": CAPTURE_ROUND_TRIP,
    "vpn_rules": VPN_RULES, "im_rules": IM_RULES, "filter_rst": _kept_sql("protocol <> 6 OR (tcp_flags & 4) = 0", 1), "filter_ack": _kept_sql("NOT (protocol = 6 AND tcp_flags = 16 AND app_len = 0)", 1), "min_packets": _kept_sql("TRUE", 20), "signed_sequences": SIGNED_SEQUENCES, "dns_merge": DNS_MERGE,
}
