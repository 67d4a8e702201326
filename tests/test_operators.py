import random
import re

import numpy as np
import pyarrow as pa
import pytest
from frames import capture, client_hello, dns_query, record, tcp4, udp4, vector
from pyspark.sql import functions as F

from tidelane.functions import filters, stats, text
from tidelane.functions.dictionaries import in_data_centre, messaging_host
from tidelane.operators import classifiers, features, flows, l7, reassembly, registry, sinks
from tidelane.sources import captures, layers
from tidelane.sources.views import packets_from_events

SCHEMA = "pkt_no long, ts_us long, src_ip string, src_port long, dst_ip string, dst_port long, protocol int, wirelen long, ip_len long, app_len long, tcp_flags int, tcp_win long, tcp_seq long, payload binary"


def rows(spark, items):
    """Packets from (seconds, from a to b?, flags, seq, data) of one TCP flow."""
    a, b = ("10.0.0.1", 1234), ("10.0.0.2", 80)
    out = []
    for k, (at, up, flags, seq, data) in enumerate(items):
        s, d = (a, b) if up else (b, a)
        out.append((k, int(at * 1e6), *s, *d, 6, 54 + len(data), 40 + len(data), len(data), flags, 8192, seq, data))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    """Frames of several protocols, parsed from a capture."""

    def run(frames, layers_wanted=()):
        path = tmp_path_factory.mktemp("c") / "x.pcap"
        path.write_bytes(capture(frames))
        raw = captures.raw_packets(spark, str(path))
        return raw, layers.packets(raw, list(layers_wanted))

    return run


# ---- statistics ----


def test_array_stats_goldens(spark):
    def of(values):
        return spark.createDataFrame([(v,) for v in values], "x long").agg(*stats.array_stats(F.col("x"))).first()

    r = of([100, 200, 300, 400, 500])
    assert (r["mean"], r["min"], r["max"], r["count"], r["median"], r["range"], r["down_count"], r["down_std"]) == (300, 100, 500, 5, 300, 400, 0, 0)
    r = of([100, 200, -150, -250, 300])
    assert (r["mean"], r["up_count"], r["up_mean"], r["down_count"], r["down_mean"]) == (200, 3, 200, 2, 200)
    r = of([0, 0, 7])
    assert r["up_count"] == 1 and r["up_std"] == 0 and abs(r["std"] - np.std([0, 0, 7])) < 1e-12


def test_distribution_against_numpy(spark):
    x = np.array([3.0, 1, 4, 1, 5, 9, 2, 6])
    r = spark.createDataFrame([(float(v),) for v in x], "x double").agg(*stats.distribution(F.col("x"), "d")).first()
    n, m = len(x), x.mean()
    std = np.sqrt(((x - m) ** 2).sum() * n / (n - 1))
    z = (x - m) / std
    assert np.allclose([r[f"d_p{k}0"] for k in range(1, 10)], np.percentile(x, range(10, 100, 10))) and np.isclose(r["d_std"], std)
    assert np.isclose(r["d_skew"], n / ((n - 1) * (n - 2)) * (z**3).sum())
    assert np.isclose(r["d_kurt"], n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))


# ---- filters ----


@pytest.mark.parametrize("bad", ["invalid syntax here", "(tcp and port 443", "port", "tcp port 443", "net 10.0.0.0", "host", "tcp and", "port x", "tcp)"])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        filters.parse(bad)


def test_filter_trees():
    t = filters.parse("not tcp or udp and PORT 53")
    assert t.kind == "or" and t.parts[0].kind == "not" and t.parts[1].kind == "and"
    assert filters.parse("") is None and filters.parse("2001:db8::1").value == "2001:db8::1"
    head, rest = filters.split(filters.parse("host 10.0.0.1 and tls and not arp"))
    assert [n.kind for n in head.parts] == ["host", "not"] and rest.value == "tls"


def test_filter_rows(spark, parsed):
    _, df = parsed([tcp4("10.0.0.1", 1, "10.0.0.2", 443, data=record(22, client_hello())), udp4("10.0.0.1", 2, "8.8.8.8", 53, dns_query(1, "a.b")), tcp4("10.0.0.3", 3, "10.0.0.2", 80, data=b"x")], ["tls", "dns", "arp"])

    def kept(what, default=None):
        return [r.pkt_no for r in df.filter(filters.packet_filter(what, df.columns, default)).orderBy("pkt_no").collect()]

    assert kept("tls") == [0] and kept("not tls") == [1, 2] and kept("dns or port 80") == [1, 2] and kept("src host 10.0.0.1 and not udp") == [0] and kept("") == [0, 1, 2] and kept(None) == [0, 1, 2] and kept("arp") == [] and kept("not arp") == [0, 1, 2]
    assert kept("udp", filters.DEFAULT_FILTER) == [1]
    whole = df.groupBy().agg(F.first("tls", True).alias("tls"), F.first("dns", True).alias("dns"))

    def passes(what):
        return whole.filter(filters.flow_filter(filters.parse(what), whole.columns)).count() == 1

    assert passes("tls") and passes("icmp or tls") and not passes("dhcp") and not passes("not tls") and passes("tcp")


# ---- flows ----


def loop_retrans(items):
    nxt, out = {}, []
    for _, up, flags, seq, data in items:
        size = len(data) + bool(flags & 2) + bool(flags & 1)
        end, hit = (seq + size) % 2**32, False
        if size:
            if up in nxt:
                keep = len(data) <= 1 and not flags & 3 and seq == (nxt[up] - 1) % 2**32
                behind = (nxt[up] - end) % 2**32 < 2**31
                hit = behind and not keep
                if not behind and not keep:
                    nxt[up] = end
            else:
                nxt[up] = end
        out.append(hit)
    return out


def test_retransmissions_against_a_loop(spark):
    rng = random.Random(3)
    for base in (1000, 2**32 - 300):
        items = [(k, rng.random() < 0.6, rng.choice([16, 24, 2, 17]), (base + rng.randrange(0, 600, 50)) % 2**32, b"x" * rng.choice([0, 1, 50, 100])) for k in range(150)]
        got = [r.is_retrans for r in flows.retransmissions(flows.oriented(rows(spark, items))).orderBy("pkt_no").collect()]
        assert got == loop_retrans(items)


def test_direction_and_canonical_key(spark):
    df = flows.oriented(rows(spark, [(0, False, 2, 1, b""), (1, True, 18, 1, b""), (2, False, 16, 2, b"abc")]))
    assert [r.dir for r in df.orderBy("pkt_no").collect()] == [1, -1, 1] and df.select("flow").distinct().collect()[0].flow == "10.0.0.1:1234-10.0.0.2:80/6"


def test_udp_sessions(spark):
    df = rows(spark, [(t, True, 0, 0, b"x") for t in (0, 5, 70, 71, 60, 200)]).withColumn("protocol", F.lit(17))
    got = flows.udp_sessions(flows.canonical(df), 60)
    assert [r.session for r in got.orderBy("pkt_no").collect()] == [0, 0, 1, 1, 1, 2]


def test_limits(spark):
    df = rows(spark, [(k, True, 16, 1, b"") for k in range(7)])
    assert sorted(r["count"] for r in flows.limited(df, 3).groupBy("flow").count().collect()) == [1, 3, 3]
    assert flows.limited(df, 3, rechunk=False).count() == 3 and flows.limited(df, 0).count() == 7


def test_bursts_and_sequences(spark):
    df = flows.oriented(rows(spark, [(0, True, 2, 1, b""), (1, True, 24, 1, b"ab"), (2, False, 24, 1, b"abc"), (3, True, 24, 1, b"")]))
    assert flows.bursts(df).first().burst == [2, -1, 1]
    s = flows.sequences(df).first()
    assert s.packet_lengths == [54, 56, -57, 54] and s.iats_us == [1_000_000] * 3 and s.tcp_flags == [2, 24, 24, 24] and len(s.tcp_window_sizes) == 4


def loop_bulks(items, gap=1.0, least=4):
    out = {1: [0, 0, 0, 0.0], -1: [0, 0, 0, 0.0]}
    cur = {1: None, -1: None}
    last = {1: None, -1: None}

    def flush(d):
        c = cur[d]
        if c and c[0] >= least:
            out[d][0] += 1
            out[d][1] += c[0]
            out[d][2] += c[1]
            out[d][3] += c[3] - c[2]
        cur[d] = None

    for t, up, _, _, data in items:
        d = 1 if up == items[0][1] else -1
        if cur[d] and last[-d] is not None and last[-d] > cur[d][3]:
            flush(d)
        if data:
            if cur[d] and t - cur[d][3] > gap:
                flush(d)
            c = cur[d]
            cur[d] = [1, len(data), t, t] if c is None else [c[0] + 1, c[1] + len(data), c[2], t]
        last[d] = t
    flush(1)
    flush(-1)
    return out


def test_bulks_against_a_loop(spark):
    rng = random.Random(5)
    t, items = 1.0, []
    for _ in range(300):
        t += rng.choice([0.1, 0.3, 2.0]) if rng.random() < 0.3 else 0.05
        items.append((round(t, 3), rng.random() < 0.9, 24, 1, b"x" * rng.choice([0, 10, 20])))
    got = {r.dir: r for r in features.bulks(flows.oriented(rows(spark, items))).collect()}
    for d, (states, pkts, size, secs) in loop_bulks(items).items():
        if states:
            assert (got[d].states, got[d].bulk_pkts, got[d].bulk_bytes) == (states, pkts, size) and abs(got[d].bulk_us / 1e6 - secs) < 1e-6
        else:
            assert d not in got


def loop_argus(items):
    state, fin, est, flags = "INIT", {True: False, False: False}, False, {True: "", False: ""}
    first = items[0][1]
    for _, up, f, _, data in items:
        fwd = up == first
        syn, ack, fn, rst, urg = (bool(f & x) for x in (2, 16, 1, 4, 32))
        if rst:
            state = "RST"
        elif state == "INIT":
            state = "REQ" if syn and not ack else state
        elif state == "REQ":
            state = "ACC" if syn and ack else "CON" if ack and not syn and not fn else state
        elif state == "ACC":
            if ack and not syn:
                state, est = "CON", True
        elif state == "CON":
            if data:
                state, est = "EST", True
            if fn:
                state = "FIN"
        elif state == "EST":
            state = "FIN" if fn else state
        elif state == "FIN":
            if fn:
                fin[fwd] = True
            state = "CLO" if all(fin.values()) else state
        if fn:
            fin[fwd] = True
        marks = [(est, "e"), (syn and not ack, "s"), (syn and ack, "S"), (bool(data), "d" if fwd else "D"), (fn, "f" if fwd else "F"), (rst, "r" if fwd else "R"), (urg, "u")]
        for cond, c in marks:
            if cond and c not in flags[fwd]:
                flags[fwd] += c
    return state, flags[True], flags[False]


def test_argus_state_against_a_loop(spark):
    rng = random.Random(11)
    plain = [(0, True, 2, 1, b""), (1, False, 18, 1, b""), (2, True, 16, 2, b""), (3, True, 24, 2, b"x"), (4, True, 17, 3, b""), (5, False, 17, 3, b"")]
    cases = [plain, plain[:1]] + [[(k, rng.random() < 0.5, rng.choice([2, 18, 16, 24, 17, 4, 48]), 5, b"x" * rng.choice([0, 3])) for k in range(rng.randrange(3, 25))] for _ in range(25)]
    all_rows = None
    for n, items in enumerate(cases):
        one = rows(spark, items).withColumn("src_port", F.when(F.col("src_port") == 1234, 2000 + n).otherwise(F.col("src_port"))).withColumn("dst_port", F.when(F.col("dst_port") == 1234, 2000 + n).otherwise(F.col("dst_port")))
        all_rows = one if all_rows is None else all_rows.unionByName(one)
    got = {int(re.search(r":(2\d+)-|:(2\d+)/", r.flow)[1] or re.search(r":(2\d+)/", r.flow)[1]): r for r in features.argus(flows.oriented(all_rows)).collect()}
    for n, items in enumerate(cases):
        state, sflgs, dflgs = loop_argus(items)
        if state in ("INIT", "REQ") and items[-1][0] - items[0][0] < 1 and len(items) < 3:
            state = "INT"
        r = got[2000 + n]
        assert (r.state, r.sflgs, r.dflgs) == (state, sflgs, dflgs), n
    assert got[2000].state == "CLO" and got[2000].syn_ack_rtt_ms == 1000 and got[2000].ack_dat_rtt_ms == 1000 and got[2000].service == "http"


def test_invariants_of_the_view(spark):
    df = flows.oriented(packets_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))
    c = features.cic(df)
    assert len(features.CIC_COLUMNS) == 80 and c.columns == ["flow", *features.CIC_COLUMNS] and c.count() == df.select("flow").distinct().count()
    assert c.agg(F.sum(F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts"))).first()[0] == df.count()
    assert len(features.cic_extended(df).columns) == 1 + 272


# ---- text ----


def test_entropy_addresses_hosts(spark):
    df = spark.createDataFrame([(b"", "1.2.3.4", "x.T.ME"), (bytes(range(256)), "91.108.4.1", "none"), (b"aabb", "nope", None)], "b binary, ip string, h string")
    got = df.select(text.byte_entropy("b"), text.ip_number("ip"), in_data_centre(F.col("ip")), *messaging_host(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0x01020304, False, "telegram", 3), (8.0, 0x5B6C0401, True, None, 0), (1.0, None, False, None, 0)]
    assert spark.range(1).select(text.ip_text(F.lit(0x0A000001))).first()[0] == "10.0.0.1"


# ---- application metadata ----


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_http(spark, parsed):
    req = b"GET /a?b=1 HTTP/1.1\r\nHost: www.example.com\r\nUser-Agent: probe\r\nAuthorization: x\r\n\r\n"
    rsp = b"HTTP/1.1 404 Not Found\r\nServer: s\r\nContent-Length: 5\r\nSet-Cookie: a=b\r\n\r\nhello"
    _, df = parsed([tcp4("10.0.0.1", 4000, "10.0.0.2", 80, data=req[:20]), tcp4("10.0.0.1", 4000, "10.0.0.2", 80, data=req[20:]), tcp4("10.0.0.2", 80, "10.0.0.1", 4000, data=rsp), tcp4("10.0.0.9", 1, "10.0.0.8", 9, data=b"zz")])
    r = one(l7.metadata(df, "http"))
    assert (r.method, r.url, r.host, r.user_agent, r.status_code, r.status_reason, r.server, r.requests, r.responses, r.status_4xx, r.has_auth, r.set_cookies, r.rtt_us) == ("GET", "/a?b=1", "www.example.com", "probe", 404, "Not Found", "s", 1, 1, 1, True, 1, 1000)


def test_dns(spark, parsed):
    frames = [udp4("10.0.0.1", 5000, "8.8.8.8", 53, dns_query(7, "a.example")), udp4("8.8.8.8", 53, "10.0.0.1", 5000, dns_query(7, "a.example", True, "1.2.3.4"))]
    r = one(l7.metadata(parsed(frames)[1], "dns"))
    assert (r.queries, r.responses, r.rtt_samples, r.rtt_avg_ms, r.qnames) == (1, 1, 1, 1.0, ["a.example"]) and "a.example 60 A 1.2.3.4" in r.messages[1]


def test_tls_and_fingerprint(spark, parsed):
    hello = record(22, client_hello())
    r = l7.metadata(parsed([tcp4("10.0.0.1", 5000, "10.0.0.2", 443, data=hello[:30]), tcp4("10.0.0.1", 5000, "10.0.0.2", 443, data=hello[30:])])[1], "tls")
    line = one(r.select("sni", "records", text.ja3(F.col("hello_version"), F.col("cipher_suites"), F.col("extensions"), F.col("supported_groups"), F.col("point_formats"))[0].alias("ja3")))
    assert (line.sni, line.records, line.ja3) == ("www.example.com", 1, "771,4865-49199,0-10-11-16-43,29-23,0")


def test_ssh_mqtt_sip_vnc_rdp_dhcp(spark, parsed):
    def kex(names):
        body = b"\x14" + bytes(16) + b"".join(vector(n.encode(), 4) for n in names) + bytes(13)
        return (len(body) + 1 + 4).to_bytes(4, "big") + b"\x04" + body + bytes(4)

    lists = ["curve25519-sha256,ecdh", "rsa", "aes128-ctr", "aes256-ctr", "h", "h", "n", "n"]
    up, down = ("10.0.0.1", 4000, "10.0.0.2", 22), ("10.0.0.2", 22, "10.0.0.1", 4000)
    r = one(l7.metadata(parsed([tcp4(*up, data=b"SSH-2.0-a\r\n"), tcp4(*down, data=b"SSH-2.0-b\r\n"), tcp4(*up, data=kex(lists)), tcp4(*down, data=kex(["ecdh"] + lists[1:]))])[1], "ssh"))
    assert (r.cli_banner, r.srv_banner, r.neg_kex, r.kex_type, r.neg_enc_c2s, r.state) == ("SSH-2.0-a", "SSH-2.0-b", "ecdh", "ecdh", "aes128-ctr", "KEXINIT")
    connect = vector(b"MQTT", 2) + b"\x04\x82" + b"\0\x3c" + vector(b"dev", 2) + vector(b"user", 2)
    publish = vector(b"t/1", 2) + b"data"
    r = one(l7.metadata(parsed([tcp4("10.0.0.1", 4000, "10.0.0.2", 1883, data=b"\x10" + bytes([len(connect)]) + connect + b"\x30" + bytes([len(publish)]) + publish)])[1], "mqtt"))
    assert (r.protocol_name, r.protocol_version, r.client_id, r.username, r.keep_alive_secs, r.clean_session, r.publish_topics) == ("MQTT", "3.1.1", "dev", "user", 60, 1, ["t/1"])
    sip = b"INVITE sip:b@x SIP/2.0\r\nVia: 1\r\nVia: 2\r\nf: <sip:a@x>\r\nTo: <sip:b@x>\r\ni: 77\r\nCSeq: 1 INVITE\r\n\r\nv=0\r\nm=audio 1\r\nm=video 2\r\n"
    r = one(l7.metadata(parsed([udp4("10.0.0.1", 5060, "10.0.0.2", 5060, sip), udp4("10.0.0.2", 5060, "10.0.0.1", 5060, b"SIP/2.0 200 OK\r\nCSeq: 1 INVITE\r\n\r\n")])[1], "sip"))
    assert (r.method, r.status_code, r.call_id, r.from_uri, r.messages, r.transactions, r.resp_2xx, r.via_hops, r.sdp_media_cnt) == ("INVITE", 200, "77", "sip:a@x", 2, 1, 1, 2, 2)
    up, down = ("10.0.0.1", 4000, "10.0.0.2", 5900), ("10.0.0.2", 5900, "10.0.0.1", 4000)
    steps = [(down, b"RFB 003.008\n"), (up, b"RFB 003.008\n"), (down, b"\2\1\2"), (up, b"\1"), (down, bytes(4)), (up, b"\1"), (down, b"\x04\0\x03\0" + bytes(16) + vector(b"desk", 4))]
    r = one(l7.metadata(parsed([tcp4(*e, data=d) for e, d in steps])[1], "vnc"))
    assert (r.proto_version, r.state, r.security_types, r.chosen_security, r.auth_ok, r.width, r.height, r.desktop_name) == ("3.8", "RUNNING", [1, 2], 1, True, 1024, 768, "desk")
    cr = b"\3\0\0\x2b\x26\xe0\0\0\0\0\0Cookie: mstshash=me\r\n\1\0\x08\0\3\0\0\0"
    r = one(l7.metadata(parsed([tcp4("10.0.0.1", 4000, "10.0.0.2", 3389, data=cr)])[1], "rdp"))
    assert r.seen_cr and r.cookie == "me" and r.req_protocols == 3 and not r.seen_cc
    dhcp = b"\1\1\6\0" + bytes(24) + b"\xaa\xbb\xcc\xdd\xee\xff" + bytes(10 + 64 + 128) + b"\x63\x82\x53\x63" + b"\x35\1\1" + b"\x0c\4host" + b"\x32\4\x0a\0\0\x05" + b"\xff"
    r = one(l7.metadata(parsed([udp4("0.0.0.0", 68, "255.255.255.255", 67, dhcp)])[1], "dhcp"))
    assert (r.discover_count, r.mac, r.hostname, r.requested_ip) == (1, "aa:bb:cc:dd:ee:ff", "host", "10.0.0.5")


def test_quic_flow(spark, parsed):
    from test_sources import sealed_initial

    frames = [udp4("10.0.0.1", 5000, "10.0.0.2", 443, sealed_initial(client_hello("q.example"))), udp4("10.0.0.2", 443, "10.0.0.1", 5000, b"\x60" + bytes(30))]
    r = one(l7.metadata(parsed(frames)[1], "quic"))
    assert (r.version, r.n_initial, r.n_short, r.spin_bit, r.first_dcid, r.sni) == ("v1", 1, 1, 1, "0102030405060708", "q.example")


# ---- classifiers ----


def test_vpn_rules(spark, parsed):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 200, dtype=np.uint8).tobytes()
    assert classifiers.wireguard(b"\1\0\0\0" + bytes(144), 17, 1, 2)[0] == 3 and classifiers.wireguard(b"\1\0\0\0" + bytes(140), 17, 1, 2)[0] == 0
    assert classifiers.openvpn(b"\x38" + bytes(13), 17, 1, 1194) == (3, "udp") and classifiers.openvpn(b"\0\x0e\x38" + bytes(13), 6, 1, 1194) == (3, "tcp")
    assert classifiers.shadowsocks(noise, 6, 1, 8388)[0] == 3 and classifiers.shadowsocks(bytes(200), 6, 1, 8388)[0] == 0
    assert classifiers.quic_vpn(b"\xc0\0\0\0\1\x08" + bytes(1194), 17, 1, 4433) == (3, "quic")
    assert classifiers.psiphon(b"GET / HTTP/1.1\r\nX-Psiphon-Address: x\r\n\r\n", 6, 1, 80)[0] == 3 and classifiers.clash(b"GET / HTTP/1.1\r\nUser-Agent: ClashX\r\n\r\n", 6, 1, 80)[0] == 3
    assert classifiers.vmess(b"GET / HTTP/1.1\r\nUpgrade: websocket\r\n\r\n", 6, 1, 80) == (2, "ws") and classifiers.vpn_packet(b"", 6, 1, 2) == ("unknown", 0, "")
    _, df = parsed([udp4("10.0.0.1", 5, "10.0.0.2", 51820, b"\1\0\0\0" + bytes(144)), udp4("10.0.0.2", 51820, "10.0.0.1", 5, b"\2\0\0\0" + bytes(88)), udp4("10.0.0.7", 5, "10.0.0.2", 7, b"plain text here")])
    r = one(classifiers.vpn_flows(df))
    assert (r.vpn, r.confidence, r.packets, r.fwd_packets, r.lengths) == ("wireguard", 3, 2, 1, [148, 92])
    native = df.select("pkt_no", classifiers.wireguard_column(F.col("payload"), F.col("protocol")).alias("c")).orderBy("pkt_no").collect()
    assert [x.c for x in native] == [3, 3, 0] and [x.vpn for x in classifiers.vpn_packets(df).orderBy("pkt_no").collect()][:2] == ["wireguard"] * 2


def test_im_rules(spark, parsed):
    assert classifiers.mtproto(b"\xef\1", 6) == 3 and classifiers.mtproto(b"\xef\1", 17) == 0 and classifiers.xmpp(b"<?xml version") == 3 and classifiers.im_packet(b"WA\x05", 6, 1, 443) == ("whatsapp", 3)
    assert classifiers.mqtt_connect(b"\x10\x20\0\4MQTT\x04\2\0\x3c") == 2
    _, df = parsed([tcp4("10.0.0.1", 5, "10.0.0.2", 443, data=record(22, client_hello("web.telegram.org"))), tcp4("10.0.0.3", 5, "10.0.0.2", 80, data=b"GET / HTTP/1.1\r\nHost: slack.com\r\n\r\n"), tcp4("10.0.0.4", 5, "10.0.0.2", 9, data=b"plain words")])
    assert {(r.app, r.sni) for r in classifiers.im_flows(df).collect() if r.confidence == 3} == {("telegram", "web.telegram.org"), ("slack", None)}


# ---- sinks, registry, reassembly ----


def test_sinks(spark, parsed, tmp_path):
    raw, df = parsed([tcp4("10.0.0.1", 5, "10.0.0.2", 80, data=b"a"), tcp4("10.0.0.2", 80, "10.0.0.1", 5, data=b"b"), udp4("10.0.0.3", 5, "10.0.0.2", 53, b"c")])
    split = {r.name: r for r in sinks.split_captures(raw, df).collect()}
    assert set(split) == {"x_10.0.0.1_5_10.0.0.2_80_6.pcap", "x_10.0.0.3_5_10.0.0.2_53_17.pcap"}
    assert len(list(captures.packets_in(split["x_10.0.0.1_5_10.0.0.2_80_6.pcap"].content))) == 2
    nested = df.select("pkt_no", F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit(2).alias("d")).alias("a"), F.array(F.lit(1)).alias("l"))
    assert sinks.flattened(nested).columns == ["pkt_no", "a.b.c", "a.d", "l"]
    for kind in ("json", "csv", "parquet"):
        sinks.save(nested, str(tmp_path / f"o.{kind}"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).count() == 3
    with pytest.raises(ValueError):
        sinks.save(nested, str(tmp_path / "o.xyz"))
    assert sinks.default_output("/x/y.pcap", "tls") == "/x/y_tls.log"


def test_extract(spark, tmp_path):
    path = tmp_path / "c.pcap"
    path.write_bytes(capture([tcp4("10.0.0.1", 5, "10.0.0.2", 443, data=record(22, client_hello())), udp4("10.0.0.3", 5, "10.0.0.2", 53, dns_query(1, "a.b"))]))
    got = registry.extract_all(spark, str(path))
    assert set(got) == set(registry.DEFAULT_BATCH) and all(s.message == "ok" for s in got.values()), got
    assert got["cic"].flows == 2 and got["dns"].flows == 1
    for kind in ("flow", "vpn", "im", "pcap_split", "smtp"):
        assert registry.extract(spark, str(path), kind).message == "ok"
    assert registry.resolve_feature("RFB") == "vnc" and registry.resolve_feature("split") == "pcap_split" and len(registry.list_features()) == 19
    with pytest.raises(ValueError):
        registry.resolve_feature("nothing")


def test_line_protocols(spark, parsed):
    up, down = ("10.0.0.1", 4000, "10.0.0.2", 25), ("10.0.0.2", 25, "10.0.0.1", 4000)
    _, df = parsed([tcp4(*down, data=b"220 hi\r\n"), tcp4(*up, data=b"EHLO me\r\nMAIL FR"), tcp4(*up, data=b"OM:<a@x>\r\n"), tcp4(*down, data=b"250 ok\r\n550 no\r\n")])
    r = one(registry.features_of(df, "smtp"))
    assert (r.helo, r.mail_from, r.login_ok, r.resp_2xx, r.resp_5xx) == ("me", "a@x", True, 2, 1)


def test_user_features(spark):
    df = flows.oriented(rows(spark, [(0, True, 2, 1, b"abc"), (1, False, 16, 1, b"de")]))
    reg = registry.Registry()
    reg.register("n", registry.FeatureType.STATISTICAL)(lambda: F.count(F.lit(1)))
    reg.register("double", dependencies=("n",))(lambda: F.col("n") * 2)
    with pytest.raises(ValueError):
        reg.register("n")(lambda: F.lit(1))
    r = reg.extract(df).first()
    assert (r.n, r["double"]) == (2, 4) and reg.names(registry.FeatureType.STATISTICAL) == ["n"]
    reg.register("x", dependencies=("y",))(lambda: F.lit(1))
    reg.register("y", dependencies=("x",))(lambda: F.lit(1))
    with pytest.raises(ValueError):
        reg.extract(df)

    class Longest:
        def initialize(self):
            self.most = 0

        def update(self, row):
            self.most = max(self.most, len(row["payload"]))

        def get_value(self):
            return self.most

    assert registry.incremental(df, "longest", Longest, pa.int64(), ["payload"]).first().longest == 3


def test_reassembly(spark):
    df = spark.createDataFrame([("a", "b", 17, 1, 0, True, b"abc", 0), ("a", "b", 17, 1, 3, False, b"de", 1), ("a", "b", 17, 1, 0, True, b"zzz", 2), ("a", "b", 17, 2, 3, False, b"x", 3)], "src_ip string, dst_ip string, protocol int, ip_id int, offset long, more boolean, payload binary, pkt_no long")
    r = one(reassembly.ip_fragments(df))
    assert bytes(r.payload) == b"abcde" and r.n_fragments == 2
    hello = record(22, client_hello())
    df = flows.oriented(rows(spark, [(0, True, 2, 99, b""), (1, True, 24, 150, hello[50:]), (2, True, 24, 100, hello[:50]), (3, True, 24, 100, hello[:10])]))
    s = one(reassembly.tcp_streams(df))
    assert bytes(s.data) == hello and s.out_of_order == 1 and s.missing == 0
    assert one(reassembly.tls_records(df)).sni == "www.example.com"


def test_unified_sequences_and_dicts(spark, parsed, tmp_path):
    _, df = parsed([tcp4("10.0.0.1", 5, "10.0.0.2", 80, seq=1, data=b"ab"), tcp4("10.0.0.1", 5, "10.0.0.2", 80, seq=1, data=b"ab"), tcp4("10.0.0.2", 80, "10.0.0.1", 5, seq=9, data=b"c")])
    r = one(flows.unified_sequences(df))
    assert r.app_lengths == [2, -1] and r.pay_len == [2, 2, 1] and r.direction == [1, 1, -1] and r.n_pkts == 3 and r.iat_us == [0, 1000, 1000]
    nested = df.limit(1).select("pkt_no", F.struct(F.lit(1).alias("b")).alias("a"))
    assert list(sinks.to_dicts(nested)) == [{"pkt_no": 0, "a": {"b": 1}}] and list(sinks.to_dicts(nested, flatten=True)) == [{"pkt_no": 0, "a.b": 1}]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in sinks.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()) == [1, 2]
