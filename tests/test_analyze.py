import pytest
from frames import capture, client_hello, dns_query, eth, record, tcp4, udp4

from tidelane.plans.analyze import analyze


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("a") / "x.pcap"
    hello = record(22, client_hello())
    up, down = ("10.0.0.1", 4000, "10.0.0.2", 443), ("10.0.0.2", 443, "10.0.0.1", 4000)
    frames = [
        tcp4(*up, seq=1, flags=2), tcp4(*down, seq=9, flags=18), tcp4(*up, seq=2, flags=16), tcp4(*up, seq=2, data=hello), tcp4(*up, seq=2, data=hello), tcp4(*down, seq=10, data=record(23, b"x" * 50)),
        udp4("10.0.0.1", 5000, "8.8.8.8", 53, dns_query(1, "a.example")), udp4("8.8.8.8", 53, "10.0.0.1", 5000, dns_query(1, "a.example", True, "1.2.3.4")), udp4("10.0.0.1", 68, "10.0.0.9", 67, bytes(300)), eth(b"\0" * 28, 0x0806), udp4("10.0.0.5", 9, "10.0.0.6", 7777, b"\x05hello"),
    ]
    p.write_bytes(capture(frames))
    return str(p)


def test_flows(spark, path):
    rows = {r.dst_port: r for r in analyze(spark, path, sequences=True).collect()}
    assert set(rows) == {443, 53, 7777}
    t = rows[443]
    assert (t.packet_count, t.retrans_count, t.up_packet_count, t.down_packet_count, t.syn_count) == (5, 1, 3, 2, 2)
    assert t.up_packet_count + t.down_packet_count == t.packet_count == len(t.packet_lengths_seq) == t.packet_lengths["count"]
    assert t.tls.sni == "www.example.com" and list(t.ext_protocol) == ["IPv4", "TCP", "TLS", "HTTPS"] and t.iats["count"] == 4
    assert rows[53].dns.queries == ["a.example"] and list(rows[53].ext_protocol) == ["IPv4", "UDP", "DNS"] and rows[53].tls is None


def test_options(spark, path):
    def ports(**more):
        return sorted(r.dst_port for r in analyze(spark, path, statistics=False, **more).collect())

    assert ports(bpf_filter="tls") == [443] and ports(bpf_filter="host 8.8.8.8 and tls") == [] and ports(bpf_filter="host 8.8.8.8 and tls", loose_filter=True) == [443]
    assert ports(bpf_filter="udp and not port 53") == [7777] and ports(min_packets=2) == [53, 443] and 67 in ports(default_filter=None)
    none = {r.dst_port: r for r in analyze(spark, path, filter_retrans=False, filter_ack=True).collect()}
    assert none[443].packet_count == 5 and none[443].retrans_count == 0
    shallow = {r.dst_port: r for r in analyze(spark, path, app_layer_parsing="none").collect()}
    assert shallow[443].tls is None and shallow[53].dns is None
    with pytest.raises(ValueError):
        analyze(spark, path, bpf_filter="tcp port 443")
    with pytest.raises(ValueError):
        analyze(spark, path, app_layer_parsing="some")


def test_user_protocol(spark, path):
    probe = {"name": "probe", "routing": {"udp": [7777]}, "fields": [{"name": "text", "type": "length_prefixed", "prefix": 1, "format": "ascii"}]}
    rows = {r.dst_port: r for r in analyze(spark, path, protocols=[probe]).collect()}
    assert list(rows[7777].ext_protocol) == ["IPv4", "UDP", "PROBE"]
