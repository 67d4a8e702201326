import struct

import pytest
from frames import capture, client_hello, dns_query, eth, ip4, ip6, record, tcp, tcp4, udp, udp4
from pyspark.sql import functions as F

from tidelane.functions import filters
from tidelane.operators import flows, l7, merge, sinks
from tidelane.plans.analyze import flow_packets, flow_table
from tidelane.sources import declared, headers, layers
from tidelane.sources.captures import RAW_SCHEMA

FRAMES = [
    (1, tcp4("10.0.0.1", 4000, "10.0.0.2", 443, data=b"x")), (1, udp4("10.0.0.1", 4000, "8.8.8.8", 53, dns_query(1, "a.b"))), (1, udp4("10.0.0.3", 68, "10.0.0.1", 67, b"x" * 300)),
    (1, eth(struct.pack("!HH", 5, 0x0800) + ip4("10.0.0.1", "10.0.0.9", 6, tcp(1, 80)), 0x8100)), (1, eth(struct.pack("!HHHH", 5, 0x8100, 6, 0x0800) + ip4("10.0.0.1", "10.0.0.9", 6, tcp(1, 80)), 0x8100)),
    (1, eth(ip6("fe80::1", "2001:db8::2", 6, tcp(9, 443)), 0x86DD)), (1, eth(ip6("::1", "2001:db8:0:0:1::2", 17, udp(546, 547, b"abcd")), 0x86DD)), (1, eth(ip6("::1", "::2", 58, bytes(8)), 0x86DD)),
    (1, eth(ip6("::1", "::2", 0, struct.pack("!BB", 6, 0) + bytes(6) + tcp(5, 443)), 0x86DD)), (1, eth(ip4("1.2.3.4", "10.0.0.2", 1, bytes(8)))), (1, eth(bytes(28), 0x0806)), (1, eth(bytes(10), 0x0806)),
    (101, ip4("10.0.0.1", "10.0.0.2", 17, udp(7, 8, b"x"))), (101, ip6("::5", "::6", 17, udp(53, 8, b"x"))), (113, bytes(14) + b"\x08\0" + ip4("10.0.0.1", "10.0.0.2", 6, tcp(1, 443))),
    (0, b"\2\0\0\0" + ip4("10.0.0.1", "10.0.0.2", 6, tcp(1, 443))), (1, eth(ip4("10.0.0.1", "10.0.0.2", 4, ip4("172.16.0.1", "172.16.0.2", 6, tcp(1, 443))))), (1, eth(ip4("10.0.0.1", "10.0.0.2", 47, b"\0\0\x08\0" + ip4("172.16.0.1", "172.16.0.2", 17, udp(1, 53))))),
    (1, udp4("10.0.0.1", 4789, "10.0.0.2", 4789, b"\x08" + bytes(7) + eth(ip4("172.16.0.1", "172.16.0.2", 6, tcp(1, 443))))), (1, eth(ip4("10.0.0.1", "10.0.0.2", 17, b"rest of it", offset=3))), (1, eth(ip4("10.0.0.1", "10.0.0.2", 6, tcp(1, 443)))[:40]), (1, b"short"), (1, b""),
]
FILTERS = ["tcp", "udp", "icmp", "icmpv6", "arp", "not arp", "ip", "ipv6", "host 10.0.0.1", "src host 10.0.0.1 and tcp", "dst 10.0.0.2", "port 443", "src port 53", "not port 443", "udp and not port 53", "host 172.16.0.1", "::1", "host fe80::1 or host 8.8.8.8", "2001:db8::1:0:0:2", "host 2001:db8:0:0:1::2", "dhcp", "dhcpv6", "gre or vxlan", "not (tcp or udp)", filters.DEFAULT_FILTER]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("f", k, k * 1000, link, len(b), len(b), bytearray(b)) for k, (link, b) in enumerate(FRAMES)], RAW_SCHEMA).cache()


@pytest.mark.parametrize("text", FILTERS)
def test_filter_below_the_parser(raw, text):
    """What headers drop is what the parsed filter drops, on all links; plain packets that go never reach the parser."""
    tree = filters.parse(text)
    head, rest = filters.split(tree)
    assert rest is None
    before = headers.plainly_kept(raw, head)
    found = layers.packets(before, ["arp"])
    whole = layers.packets(raw, ["arp"])
    want = {r.pkt_no for r in whole.filter(filters.compiled(tree, whole.columns)).select("pkt_no").collect()}
    assert {r.pkt_no for r in found.filter(filters.compiled(tree, found.columns)).select("pkt_no").collect()} == want
    left = {r.pkt_no for r in before.select("pkt_no").collect()}
    told = {r.pkt_no for r in raw.filter(headers.told(lambda t: t["plain"])).select("pkt_no").collect()}
    assert len(told) > 9 and left & told <= want | (left - told)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter")


def flow_of(spark, packets):
    rows = [("f", k, k * 1000, 1, len(b), len(b), bytearray(b)) for k, b in enumerate(packets)]
    return flow_table(flow_packets(layers.packets(spark.createDataFrame(rows, RAW_SCHEMA), ["tls", "dns", "quic"])), statistics=False).collect()


def test_tls_over_segments(spark):
    """Hellos over two and three segments, records that share segments, a client hello beside a server's, and what is enciphered."""
    hello = record(22, client_hello("split.example.com"))
    server = record(22, b"\x02" + (38).to_bytes(3, "big") + b"\x03\x03" + bytes(32) + b"\0" + b"\x13\x01" + b"\0")
    done = record(20, b"\x01") + record(22, bytes(range(100, 140))) + record(23, bytes(30))
    for cuts in ((40,), (3, 60), (5,), (len(hello) - 1,)):
        at = [0, *cuts, len(hello)]
        seq, out = 1, []
        for a, b in zip(at, at[1:], strict=False):
            out.append(tcp4("10.0.0.1", 4000, "10.0.0.2", 443, seq=seq, data=hello[a:b]))
            seq += b - a
        out.append(tcp4("10.0.0.2", 443, "10.0.0.1", 4000, seq=1, data=server + done[:9]))
        out.append(tcp4("10.0.0.2", 443, "10.0.0.1", 4000, seq=1 + len(server) + 9, data=done[9:]))
        (r,) = flow_of(spark, out)
        assert r.tls.sni == "split.example.com" and r.tls.cipher_suites == [0x0A0A, 0x1301, 0xC02F] and r.tls.cipher_suite == 0x1301, cuts
        assert r.tls.handshake_types == [1, 2] and r.tls.record_types == [22, 22, 20, 22, 23] and "TLS" in r.ext_protocol
    (r,) = flow_of(spark, [tcp4("10.0.0.1", 4000, "10.0.0.2", 443, data=hello[:40])])
    assert r.tls is None  # no record is whole
    (r,) = flow_of(spark, [tcp4("10.0.0.1", 4000, "10.0.0.2", 9999, seq=1, data=hello[:70]), tcp4("10.0.0.1", 4000, "10.0.0.2", 9999, seq=71, data=hello[70:])])
    assert r.tls.sni == "split.example.com"  # not a port of TLS, but a packet that looks like it


def test_quic_over_packets(spark):
    hello = client_hello("quic.example.com")
    parts = [(60, hello[60:]), (0, hello[:25]), (25, hello[25:60])]
    kind = "struct<sni:string,alpn:array<string>,cipher_suites:array<bigint>,crypto_fragments:array<struct<offset:bigint,data:binary>>>"
    rows = [(1, (None, [], [], [(o, bytearray(d)) for o, d in parts])), (2, ("kept.example.com", ["h3"], [1], [(4, bytearray(b"zz"))])), (3, None), (4, (None, [], [], []))]
    got = {r.k: r.q for r in spark.createDataFrame(rows, f"k int, quic {kind}").select("k", merge.quic_reassembled(F.col("quic")).alias("q")).collect()}
    assert got[1].sni == "quic.example.com" and got[1].alpn == ["h2"] and got[1].cipher_suites == [0x0A0A, 0x1301, 0xC02F]
    assert got[2].sni == "kept.example.com" and got[2].alpn == ["h3"] and got[3] is None and got[4].sni is None


def fed(fold, *payloads, port=80):
    for k, (client, data) in enumerate(payloads):
        a, b = ("10.0.0.1", 4000), ("10.0.0.2", port)
        (s, sp), (d, dp) = (a, b) if client else (b, a)
        fold.feed({"payload": data, "src_ip": s, "src_port": sp, "dst_ip": d, "dst_port": dp, "protocol": 17 if port == 53 else 6, "ts_us": 1000 * k})
    return fold.result()


def test_long_bodies_are_counted():
    """100 MB in segments take a moment, and what follows the body is read."""
    size, segment = 100_000_000, bytes(1400)
    head = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\nServer: s\r\n\r\n" % size
    n, rest = divmod(size, len(segment))
    last = segment[:rest] + b"HTTP/1.1 404 No\r\nContent-Length: 0\r\n\r\n"
    r = fed(l7.Http(), (True, b"GET /a HTTP/1.1\r\nHost: h\r\n\r\nGET /b HT"), (True, b"TP/1.1\r\n\r"), (True, b"\n"), (False, head), *[(False, segment)] * n, (False, last))
    assert (r["requests"], r["responses"], r["status_2xx"], r["status_4xx"], r["url"], r["response_bytes"]) == (2, 2, 1, 1, "/b", size + len(head) + 38)


def test_open_dns_queries():
    queries = [(True, dns_query(k % 50_000, "a.b")) for k in range(100_000)]
    r = fed(l7.Dns(), *queries, (False, dns_query(7, "a.b", True, "1.2.3.4")), (False, dns_query(7, "a.b", True)), (False, dns_query(7, "a.b", True)), port=53)
    assert r["queries"] == 100_000 and r["responses"] == 3 and r["rtt_samples"] == 2 and r["rtt_max_ms"] == 100_000 - 7


def test_reset_and_ack_filters(raw):
    df = flows.canonical(layers.packets(raw, []))
    assert df.count() == len(FRAMES) and flows.without_resets(df.filter("protocol = 6")).count() == df.filter("protocol = 6").count()


def test_sequences_have_tls_types(spark):
    payloads = [b"\x16\x03\x01\0\5\x01", b"\x16\x03\x03\0\5\x0b", b"\x14\x03\x03\0\1\1", b"\x17\x03\x03\0\1\1", b"\x16\x03\x03\0\1\x63", b"\x17\x03\x03\0\1", b"\x17\x09\x03\0\1\1", b"GET / HTTP", b"", b"\x15\x03\x03\0\2\1", b"\x18\x03\x03\0\2\1"]
    rows = [("f", k, k * 1000, 1, 0, 0, bytearray(tcp4("10.0.0.1", 4000, "10.0.0.2", 443, seq=k * 50, data=p))) for k, p in enumerate(payloads)]
    r = flows.plain_sequences(layers.packets(spark.createDataFrame(rows, RAW_SCHEMA), [])).first()
    assert r.tls_type == [1, 3, 11, 13, 15, 0, 0, 0, 0, 12, 14] and r.n_pkts == 11 and r.iat_us == [0] + [1000] * 10 and r.direction == [1] * 11


def test_exports(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, (1.5, 2.0), [1, -2], b"\1")], "k int, packet_lengths struct<mean:double,std:double>, iats array<int>, b binary")
    assert sinks.with_features(df, ["packet_lengths", "iats"]).columns == ["k", "b", "feature.packet_lengths.mean", "feature.packet_lengths.std", "feature.iats"]
    sinks.save_array(df, str(tmp_path / "a.json"), indent=4)
    assert json.loads((tmp_path / "a.json").read_text()) == [{"k": 1, "packet_lengths": {"mean": 1.5, "std": 2.0}, "iats": [1, -2], "b": "01"}] and "\n    {" in (tmp_path / "a.json").read_text()
    sinks.save_array(df.filter("k > 1"), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_runs(spark, tmp_path, capsys):
    from tidelane.__main__ import main
    from tidelane.operators import registry
    from tidelane.plans.analyze import run_statistics

    (tmp_path / "c.pcap").write_bytes(capture([tcp4("10.0.0.1", 5, "10.0.0.2", 443, data=b"x"), tcp4("10.0.0.2", 443, "10.0.0.1", 5, data=b"y"), udp4("10.0.0.3", 5, "10.0.0.2", 53, dns_query(1, "a.b")), eth(bytes(28), 0x0806)]))
    (tmp_path / "d.pcap").write_bytes(b"no capture")
    assert run_statistics(spark, str(tmp_path), "*.pcap") == {"files_processed": 1, "packets_processed": 4, "packets_filtered": 1, "flows_created": 2, "errors": [f"file:{tmp_path}/d.pcap"]}
    assert main(["--list"]) == 0 and "pcap" not in capsys.readouterr().out.split("\n")[0]
    assert main([str(tmp_path / "c.pcap"), "--feature", "seq", "dns", "--output", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "seq\tflows=2\tpackets=4" in said and "dns\tflows=1" in said
    flow = registry.extract(spark, str(tmp_path / "c.pcap"), "flow", str(tmp_path / "flows.json"))
    meta = spark.read.json(str(tmp_path / "flows.json.meta")).first()
    assert flow.flows == 2 and flow.packets == 4 and (meta.total_flows, meta.total_packets) == (2, 3) and spark.read.json(str(tmp_path / "flows.json")).count() == 2
    whole = registry.extract(spark, str(tmp_path / "c.pcap"), "flow", str(tmp_path / "whole.json"), document=True)
    assert whole.message == "ok" and spark.read.json(str(tmp_path / "whole.json")).first().meta.total_flows == 2
    with pytest.raises(SystemExit):
        main([str(tmp_path / "c.pcap"), "--feature", "nothing"])


def test_hosts_of_tls_by_port(spark):
    hello = record(22, client_hello())
    rows = [("f", k, k, 1, 0, 0, bytearray(tcp4("10.0.0.1", 4000, "10.0.0.2", port, data=hello))) for k, port in enumerate((443, 8443))]
    df = layers.packets(spark.createDataFrame(rows, RAW_SCHEMA), [])
    assert l7.metadata(df, "tls").count() == 2 and [r.dst_port for r in l7.metadata(df, "tls", filter_port=8443).collect()] == [8443]


def test_users_layers_keep_their_fields(spark):
    rows = [(1, 1, {"a": '{"x":1}'}), (1, 2, {"a": '{"x":2}', "b": "{}"}), (2, 3, None)]
    got = {r.flow: r.m for r in spark.createDataFrame(rows, "flow int, pkt_no int, extra map<string,string>").groupBy("flow").agg(merge.first_entries("extra").alias("m")).collect()}
    assert got == {1: {"a": '{"x":1}', "b": "{}"}, 2: {}}
    name, parse, _ = declared.compiled({"name": "q", "fields": [{"name": "n", "type": "fixed", "size": "1"}, {"name": "host", "type": "hardcoded", "parser": "dns_name"}, {"name": "rest", "type": "rest"}]})
    assert parse(b"\x07\x01a\x02bc\0zz") == ({"n": 7, "host": "a.bc", "rest": "7a7a"}, 9)
    with pytest.raises(ValueError):
        declared.compiled({"name": "q", "fields": [{"name": "n", "type": "hardcoded", "parser": "x"}]})
