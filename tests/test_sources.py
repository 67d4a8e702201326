import struct

import pytest
from frames import capture, client_hello, dns_query, eth, ip4, ip6, record, tcp, tcp4, udp, udp4, vector

from tidelane.sources import captures, declared, layers, quic, tls


def test_pcap_orders_and_units():
    frame = b"x" * 60
    for order, magic, unit in (("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000), (">", 0xA1B23C4D, 1000)):
        raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101) + struct.pack(order + "IIII", 7, 123456 * unit, 60, 90) + frame
        assert list(captures.packets_in(raw)) == [(7_123_456, 101, 90, frame)]
        assert list(captures.packets_in(raw + b"\0" * 10)) == [(7_123_456, 101, 90, frame)]  # a truncated record ends it


def test_pcapng_blocks():
    def block(kind, body):
        body = body.ljust(-(-len(body) // 4) * 4, b"\0")
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    raw = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 113, 0, 0)) + block(5, b"unknown.") + block(6, struct.pack("<IIIII", 0, 1, 5, 4, 99) + b"abcd")
    assert list(captures.packets_in(raw)) == [((1 << 32) + 5, 113, 99, b"abcd")]


def test_not_a_capture():
    with pytest.raises(ValueError):
        list(captures.packets_in(b"PK\3\4" + bytes(40)))
    assert captures.link_layer(1) == "ethernet" and captures.link_layer(999) == "unknown"


def test_ip_tcp():
    p = layers.parse(tcp4("10.0.0.1", 1234, "10.0.0.2", 80, seq=7, flags=0x12, data=b"hello"))
    assert p["ip"]["src"] == "10.0.0.1" and p["ip_len"] == 45 and p["trans_len"] == 25 and p["app_len"] == 5 and p["payload"] == b"hello"
    assert (p["tcp"]["sport"], p["tcp"]["dport"], p["tcp"]["seq"], p["tcp"]["flags"], p["tcp"]["win"]) == (1234, 80, 7, 0x12, 8192)


def test_ethernet_padding_is_no_data():
    p = layers.parse(tcp4("10.0.0.1", 1, "10.0.0.2", 2, flags=0x10) + bytes(6))
    assert p["app_len"] == 0


def test_link_types():
    inner = ip4("1.2.3.4", "5.6.7.8", 17, udp(9, 10, b"abc"))
    sll = struct.pack("!HHH", 0, 1, 6) + b"\2\0\0\0\0\1\0\0" + struct.pack("!H", 0x0800)
    sll2 = struct.pack("!HHIHBB", 0x0800, 0, 1, 1, 0, 6) + b"\2\0\0\0\0\1\0\0"
    for link, head in ((101, b""), (113, sll), (276, sll2), (0, struct.pack("<I", 2)), (108, struct.pack(">I", 2))):
        p = layers.parse(head + inner, link)
        assert p["udp"]["dport"] == 10 and p["payload"] == b"abc", link
    assert layers.parse(struct.pack("<I", 30) + ip6("::1", "::2", 17, udp(1, 2)), 0)["ip6"]["dst"] == "::2"


def test_vlan_arp_icmp():
    p = layers.parse(eth(struct.pack("!HH", 3 << 13 | 42, 0x0800) + ip4("1.1.1.1", "2.2.2.2", 1, b"\x08\0\0\0rest"), 0x8100))
    assert p["vlan"] == {"vlan_id": 42, "priority": 3, "dei": 0, "ether_type": 0x0800} and p["icmp"]["type"] == 8
    a = layers.parse(eth(struct.pack("!HHBBH", 1, 0x0800, 6, 4, 2) + b"\2" * 6 + bytes([10, 0, 0, 1]) + b"\3" * 6 + bytes([10, 0, 0, 2]), 0x0806))
    assert a["arp"]["opcode"] == 2 and a["arp"]["sender_ip"] == "10.0.0.1"


def test_tunnels_show_the_inner_packet():
    inner = ip4("10.1.1.1", "10.2.2.2", 6, tcp(5, 6, data=b"zz"))
    gre = ip4("1.1.1.1", "2.2.2.2", 47, struct.pack("!HHI", 0x2000, 0x0800, 77) + inner)
    p = layers.parse(eth(gre))
    assert p["gre"]["key"] == 77 and p["ip"]["src"] == "10.1.1.1" and p["payload"] == b"zz"
    vxlan = ip4("1.1.1.1", "2.2.2.2", 17, udp(4000, 4789, b"\x08\0\0\0" + (5000).to_bytes(3, "big") + b"\0" + eth(inner)))
    p = layers.parse(eth(vxlan))
    assert p["vxlan"]["vni"] == 5000 and p["ip"]["dst"] == "10.2.2.2"
    mpls = (100 << 12 | 1 << 9 | 64).to_bytes(4, "big") + (200 << 12 | 1 << 8 | 63).to_bytes(4, "big")
    p = layers.parse(eth(mpls + inner, 0x8847))
    assert p["mpls"]["label"] == 200 and p["mpls"]["stack_depth"] == 2 and p["tcp"]["dport"] == 6


def test_fragments_stop_at_ip():
    p = layers.parse(eth(ip4("1.1.1.1", "2.2.2.2", 6, b"x" * 20, offset=10)))
    assert "tcp" not in p and p["ip"]["offset"] == 10


def test_ip6_extension_headers():
    body = bytes([6, 0]) + bytes(6) + tcp(1, 2)
    p = layers.parse(eth(ip6("fe80::1", "fe80::2", 0, body), 0x86DD))
    assert p["ip6"]["next_header"] == 6 and p["tcp"]["dport"] == 2 and p["ip_len"] == 40 + len(body)


def test_dns_and_depth():
    frame = udp4("1.1.1.1", 5000, "8.8.8.8", 53, dns_query(7, "www.example.com"))
    assert layers.parse(frame)["dns"]["queries"] == ["www.example.com"]
    assert "dns" not in layers.parse(frame, depth="none") and "dns" in layers.parse(frame, depth="port_only")
    hello = tcp4("1.1.1.1", 5000, "2.2.2.2", 443, data=record(22, client_hello()))
    assert layers.parse(hello)["tls"]["sni"] == "www.example.com" and "tls" not in layers.parse(hello, depth="port_only")
    with pytest.raises(ValueError):
        layers.parse(frame, depth="some")


def test_client_hello_fields():
    found, used = tls.records(record(22, client_hello()) + record(20, b"\1") + b"\x17\x03\x03\x01")
    assert found["alpn"] == ["h2"] and found["cipher_suites"] == [0x0A0A, 0x1301, 0xC02F] and found["supported_groups"] == [29, 23] and found["extensions"] == [0, 10, 11, 16, 43] and found["supported_versions"] == [0x0304, 0x0303]
    assert found["record_types"] == [22, 20] and tls.is_client_hello(record(22, client_hello())) and not tls.is_server_hello(record(22, client_hello()))


def test_merge_takes_the_first():
    a, b = tls.empty() | {"sni": None, "handshake_types": [1]}, tls.empty() | {"sni": "x", "handshake_types": [2], "certificates": [b"c"]}
    m = tls.merged([a, b])
    assert m["sni"] == "x" and m["handshake_types"] == [1, 2] and m["certificates"] == [b"c"] and tls.merged([]) is None


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_certificate():
    def name(cn):
        return _der(0x30, _der(0x31, _der(0x30, _der(6, bytes([0x55, 4, 3])) + _der(12, cn.encode()))))

    rsa = _der(0x30, _der(6, bytes.fromhex("2a864886f70d010101")) + _der(5, b""))
    sig = _der(0x30, _der(6, bytes.fromhex("2a864886f70d01010b")) + _der(5, b""))
    key = _der(0x30, rsa + _der(3, b"\0" + _der(0x30, _der(2, b"\0" + b"\xff" * 256) + _der(2, b"\1\0\1"))))
    san = _der(0x30, _der(6, bytes([0x55, 0x1D, 0x11])) + _der(4, _der(0x30, _der(0x82, b"a.example") + _der(0x82, b"b.example"))))
    ca = _der(0x30, _der(6, bytes([0x55, 0x1D, 0x13])) + _der(1, b"\xff") + _der(4, _der(0x30, _der(1, b"\xff"))))
    tbs = _der(0x30, _der(0xA0, _der(2, b"\2")) + _der(2, b"\x12\x34") + sig + name("issuer") + _der(0x30, _der(23, b"240101000000Z") + _der(23, b"250101000000Z")) + name("subject") + key + _der(0xA3, _der(0x30, san + ca)))
    c = tls.certificate(_der(0x30, tbs + sig + _der(3, b"\0sig")))
    assert (c["subject"], c["issuer"], c["serial"], c["version"], c["key_bits"], c["san"], c["is_ca"]) == ({"CN": "subject"}, {"CN": "issuer"}, "1234", 3, 2048, ["a.example", "b.example"], True)
    assert c["signature_algorithm"] == "sha256WithRSAEncryption" and c["not_before"] == "240101000000Z"
    with pytest.raises(ValueError):
        tls.certificate(b"\x30\x82\xff\xff\0")


def test_quic_known_answers():
    key, iv, hp = quic.initial_keys(bytes.fromhex("8394c8f03e515708"))
    assert (key.hex(), iv.hex(), hp.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
    assert quic.aes_block(quic._round_keys(hp), bytes.fromhex("d1b1c98dd7689fb8ec11d242b123dc9b")).hex().startswith("437b9aec36")
    sealed = bytes.fromhex("42831ec2217774244b7221b784d0d49ce3aa212f2c02a4e035c17e2329aca12e21d514b25466931c7d8f6a5aac84aa051ba30b396a0aac973d58e0915bc94fbc3221a5db94fae95ae7121a47")
    plain = quic.gcm_open(bytes.fromhex("feffe9928665731c6d6a8f9467308308"), bytes.fromhex("cafebabefacedbaddecaf888"), sealed, bytes.fromhex("feedfacedeadbeeffeedfacedeadbeefabaddad2"))
    assert plain.hex().startswith("d9313225f88406e5") and quic.gcm_open(bytes(16), bytes(12), sealed, b"") is None


def sealed_initial(hello, dcid=b"\1\2\3\4\5\6\7\x08"):
    """An Initial as a client would send it."""
    key, iv, hp = quic.initial_keys(dcid)
    frames = b"\x06\0" + (0x4000 | len(hello)).to_bytes(2, "big") + hello + bytes(40)
    size = 2 + len(frames) + 16
    head = b"\xc1" + (1).to_bytes(4, "big") + vector(dcid, 1) + b"\0" + b"\0" + (0x4000 | size).to_bytes(2, "big")
    number = b"\0\2"
    keys = quic._round_keys(key)
    nonce = bytes(a ^ b for a, b in zip(iv, number.rjust(12, b"\0"), strict=True))
    stream = b"".join(quic.aes_block(keys, nonce + (2 + k).to_bytes(4, "big")) for k in range(-(-len(frames) // 16)))
    body = bytes(a ^ b for a, b in zip(frames, stream, strict=False))
    h, y, aad = int.from_bytes(quic.aes_block(keys, bytes(16)), "big"), 0, head + number
    for part in (aad, body):
        for k in range(0, len(part), 16):
            y = quic._gf_multiply(y ^ int.from_bytes(part[k : k + 16].ljust(16, b"\0"), "big"), h)
    y = quic._gf_multiply(y ^ (len(aad) * 8 << 64 | len(body) * 8), h)
    tag = (y ^ int.from_bytes(quic.aes_block(keys, nonce + b"\0\0\0\1"), "big")).to_bytes(16, "big")
    packet = head + number + body + tag
    at = len(head)
    mask = quic.aes_block(quic._round_keys(hp), packet[at + 4 : at + 20])
    return bytes([packet[0] ^ mask[0] & 15]) + packet[1:at] + bytes(x ^ m for x, m in zip(number, mask[1:], strict=False)) + packet[at + 2 :]


def test_quic_initial_is_opened():
    fields = quic.parsed(sealed_initial(client_hello("quic.example", alpn=("h3",))))[0]
    assert fields["sni"] == "quic.example" and fields["alpn"] == ["h3"] and fields["packet_type_str"] == "Initial"


def test_declared_protocol():
    name, parse, routes = declared.compiled(
        {
            "name": "probe", "routing": {"udp": [9999]},
            "fields": [
                {"name": "kind", "type": "fixed", "size": 1}, {"name": "b", "type": "bitfield", "size": 1, "bits": {"high": 3, "low": 5}}, {"name": "host", "type": "length_prefixed", "prefix": 1, "format": "ascii"},
                {"name": "n", "type": "fixed", "size": 1}, {"name": "twice", "type": "computed", "expression": "(n + 1) * 2 / 1"}, {"name": "items", "type": "counted_list", "count": "n", "item": 2}, {"name": "options", "type": "tlv"}, {"name": "rest", "type": "rest"},
            ],
        }
    )
    raw = b"\x07\xa3\x03abc\x02\0\1\0\2" + b"\x05\x02hi"
    fields, used = parse(raw)
    assert fields == {"kind": 7, "high": 5, "low": 3, "host": "abc", "n": 2, "twice": 6, "items": [1, 2], "options": {"5": "6869"}, "rest": ""} and used == len(raw)
    p = layers.parse(udp4("1.1.1.1", 5, "2.2.2.2", 9999, raw), more={name: parse}, routes=routes)
    assert p["extra"]["probe"]["host"] == "abc"
    with pytest.raises(ValueError):
        declared.expression("__import__('os')")


def test_capture_to_rows(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([tcp4("10.0.0.1", 1234, "10.0.0.2", 443, data=record(22, client_hello())), udp4("10.0.0.1", 5, "8.8.8.8", 53, dns_query(1, "a.example"))]))
    (tmp_path / "b.pcap").write_bytes(b"junk")
    rows = layers.stack(layers.packets(captures.raw_packets(spark, str(tmp_path), "*.pcap"), ["ip", "tcp", "udp", "tls", "dns"])).orderBy("pkt_no").collect()
    assert [r.protocol for r in rows] == [6, 17] and rows[0].tls.sni == "www.example.com" and rows[1].dns.queries == ["a.example"] and rows[0].protocol_stack == ["ip", "tcp", "tls"]
    assert [r.path.rsplit("/", 1)[1] for r in captures.bad_captures(spark, str(tmp_path)).collect()] == ["b.pcap"]
    assert captures.files(spark, str(tmp_path)).filter(captures.is_capture("content")).count() == 1
