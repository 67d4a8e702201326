"""Packet bytes to layers: one Arrow pass that yields a nullable struct for each layer (null: absent).

A packet is followed layer by layer, sixteen at most; a layer that occurs again (in a tunnel) replaces the earlier one. Fragments after the first stop at
the network layer. ``depth``: ``full``, ``port_only`` (no TLS, DNS, QUIC or other payloads beyond what ports say) or ``none`` (nothing above TCP and UDP).
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import joined, pieces
from . import quic, tls

_L, _S, _B = pa.int64(), pa.string(), pa.binary()


def _struct(**fields: pa.DataType) -> pa.DataType:
    return pa.struct(list(fields.items()))


LAYERS = {
    "eth": _struct(src=_S, dst=_S, type=_L),
    "vlan": _struct(vlan_id=_L, priority=_L, dei=_L, ether_type=_L),
    "sll": _struct(packet_type=_L, arphrd_type=_L, addr=_S, protocol=_L),
    "arp": _struct(hw_type=_L, proto_type=_L, opcode=_L, sender_mac=_S, sender_ip=_S, target_mac=_S, target_ip=_S),
    "ip": _struct(version=_L, src=_S, dst=_S, proto=_L, ttl=_L, len=_L, id=_L, flags=_L, offset=_L, tos=_L, header_len=_L, options=_B),
    "ip6": _struct(version=_L, src=_S, dst=_S, next_header=_L, hop_limit=_L, flow_label=_L, len=_L, header_len=_L),
    "tcp": _struct(sport=_L, dport=_L, seq=_L, ack_num=_L, flags=_L, win=_L, urgent=_L, header_len=_L, options=_B),
    "udp": _struct(sport=_L, dport=_L, len=_L),
    "icmp": _struct(type=_L, code=_L, checksum=_L, rest_data=_B),
    "icmp6": _struct(type=_L, code=_L, checksum=_L, rest_data=_B),
    "gre": _struct(flags=_L, protocol_type=_L, checksum=_L, key=_L, sequence=_L),
    "vxlan": _struct(flags=_L, vni=_L),
    "mpls": _struct(label=_L, tc=_L, ttl=_L, stack_depth=_L, bottom_of_stack=_L),
    "dhcp": _struct(op=_L, htype=_L, xid=_L, ciaddr=_S, yiaddr=_S, siaddr=_S, giaddr=_S, chaddr=_S, options_raw=_B),
    "dhcpv6": _struct(msg_type=_L, transaction_id=_L, options_raw=_B),
    "dns": _struct(id=_L, queries=pa.list_(_S), qtypes=pa.list_(_L), response=pa.bool_(), response_code=_L, question_count=_L, answer_count=_L, authority_count=_L, additional_count=_L, flags=_L),
    "tls": tls.SCHEMA,
    "quic": quic.SCHEMA,
}
#: Numbers of protocols in frames.
ETHERTYPES = {0x0800: "ip", 0x86DD: "ip6", 0x0806: "arp", 0x8100: "vlan", 0x88A8: "vlan", 0x8847: "mpls", 0x8848: "mpls"}
IP_PROTOCOLS = {1: "icmp", 4: "ip", 6: "tcp", 17: "udp", 41: "ip6", 47: "gre", 58: "icmp6"}
EXTENSIONS = (0, 43, 44, 50, 51, 60)
UDP_PORTS = {53: "dns", 4789: "vxlan", 67: "dhcp", 68: "dhcp", 546: "dhcpv6", 547: "dhcpv6"}
LINKS = {1: "eth", 113: "sll", 276: "sll2", 101: "raw", 12: "raw", 14: "raw", 0: "loop", 108: "loop", 239: "nflog"}

Parsed = tuple[dict | None, str | None, int, int | None]  # fields, next layer, bytes used, end of what belongs to it


def mac(b: bytes) -> str:
    return ":".join(f"{x:02x}" for x in b)


def ip_text(b: bytes) -> str:
    return str(ipaddress.ip_address(b))


def _eth(b: bytes) -> Parsed:
    if len(b) < 14:
        return None, None, 0, None
    kind = b[12] << 8 | b[13]
    return {"src": mac(b[6:12]), "dst": mac(b[:6]), "type": kind}, ETHERTYPES.get(kind), 14, None


def _vlan(b: bytes) -> Parsed:
    if len(b) < 4:
        return None, None, 0, None
    tci, kind = struct.unpack_from("!HH", b)
    return {"vlan_id": tci & 0xFFF, "priority": tci >> 13, "dei": tci >> 12 & 1, "ether_type": kind}, ETHERTYPES.get(kind), 4, None


def _sll(b: bytes) -> Parsed:
    if len(b) < 16:
        return None, None, 0, None
    kind, hardware, size = struct.unpack_from("!HHH", b)
    protocol = b[14] << 8 | b[15]
    return {"packet_type": kind, "arphrd_type": hardware, "addr": mac(b[6 : 6 + min(size, 8)]), "protocol": protocol}, ETHERTYPES.get(protocol), 16, None


def _sll2(b: bytes) -> Parsed:
    if len(b) < 20:
        return None, None, 0, None
    protocol, _, _, hardware, kind, size = struct.unpack_from("!HHIHBB", b)
    return {"packet_type": kind, "arphrd_type": hardware, "addr": mac(b[12 : 12 + min(size, 8)]), "protocol": protocol}, ETHERTYPES.get(protocol), 20, None


def _by_version(b: bytes, at: int = 0) -> str | None:
    return {4: "ip", 6: "ip6"}.get(b[at] >> 4) if len(b) > at else None


def _raw(b: bytes) -> Parsed:
    return None, _by_version(b), 0, None


def _loop(b: bytes) -> Parsed:
    if len(b) < 4:
        return None, None, 0, None
    family = int.from_bytes(b[:4], "little")
    family = int.from_bytes(b[:4], "big") if family > 255 else family
    return None, "ip" if family == 2 else "ip6" if family in (10, 24, 28, 30) else None, 4, None


def _nflog(b: bytes) -> Parsed:
    at = 4
    while at + 4 <= len(b):
        size, kind = struct.unpack_from("<HH", b, at)
        if size < 4 or at + size > len(b):
            break
        if kind & 0x7FFF == 9:
            return None, {2: "ip", 10: "ip6"}.get(b[0]) or _by_version(b, at + 4), at + 4, at + size
        at += size + 3 & ~3
    return None, None, 0, None


def _arp(b: bytes) -> Parsed:
    if len(b) < 28:
        return None, None, 0, None
    hardware, protocol, _, _, op = struct.unpack_from("!HHBBH", b)
    return {"hw_type": hardware, "proto_type": protocol, "opcode": op, "sender_mac": mac(b[8:14]), "sender_ip": ip_text(b[14:18]), "target_mac": mac(b[18:24]), "target_ip": ip_text(b[24:28])}, None, 28, None


def _ip(b: bytes) -> Parsed:
    if len(b) < 20 or b[0] >> 4 != 4:
        return None, None, 0, None
    size = min(max((b[0] & 15) * 4, 20), len(b))
    total, number, part = struct.unpack_from("!HHH", b, 2)
    offset = part & 0x1FFF
    fields = {"version": 4, "src": ip_text(b[12:16]), "dst": ip_text(b[16:20]), "proto": b[9], "ttl": b[8], "len": total, "id": number, "flags": (part >> 13 & 1) | (part >> 14 & 1) << 1, "offset": offset, "tos": b[1], "header_len": size, "options": b[20:size]}
    return fields, None if offset else IP_PROTOCOLS.get(b[9]), size, max(total, size) if total else None


def _ip6(b: bytes) -> Parsed:
    if len(b) < 40 or b[0] >> 4 != 6:
        return None, None, 0, None
    size, kind, at, fragment = struct.unpack_from("!H", b, 4)[0], b[6], 40, False
    while kind in EXTENSIONS and at + 8 <= len(b):
        following = b[at]
        if kind == 44:
            fragment = bool(struct.unpack_from("!H", b, at + 2)[0] >> 3)
            step = 8
        else:
            step = (b[at + 1] + 2) * 4 if kind == 51 else (b[at + 1] + 1) * 8
        if kind == 50:
            break
        kind, at = following, at + step
    fields = {"version": 6, "src": ip_text(b[8:24]), "dst": ip_text(b[24:40]), "next_header": kind, "hop_limit": b[7], "flow_label": int.from_bytes(b[1:4], "big") & 0xFFFFF, "len": size, "header_len": at}
    return fields, None if fragment else IP_PROTOCOLS.get(kind), at, 40 + size if size else None


def _tcp(b: bytes) -> Parsed:
    if len(b) < 20:
        return None, None, 0, None
    sport, dport, seq, ack, offset, flags, win, _, urgent = struct.unpack_from("!HHIIBBHHH", b)
    size = min(max((offset >> 4) * 4, 20), len(b))
    data = b[size:]
    looks = len(data) >= 5 and data[0] in range(0x14, 0x18) and data[1] == 3 and data[2] <= 4
    return {"sport": sport, "dport": dport, "seq": seq, "ack_num": ack, "flags": flags, "win": win, "urgent": urgent, "header_len": size, "options": b[20:size]}, "tls" if looks else None, size, None


def _udp(b: bytes) -> Parsed:
    if len(b) < 8:
        return None, None, 0, None
    sport, dport, size = struct.unpack_from("!HHH", b)
    following = UDP_PORTS.get(dport) or (UDP_PORTS.get(sport) if sport != 4789 else None)
    if not following and quic.is_long_header(b[8:]):
        following = "quic"
    return {"sport": sport, "dport": dport, "len": size}, following, 8, None


def _icmp(b: bytes) -> Parsed:
    if len(b) < 4:
        return None, None, 0, None
    return {"type": b[0], "code": b[1], "checksum": b[2] << 8 | b[3], "rest_data": b[4:]}, None, len(b), None


def _gre(b: bytes) -> Parsed:
    if len(b) < 4:
        return None, None, 0, None
    flags, protocol = struct.unpack_from("!HH", b)
    at, words = 4, {}
    for bit, name in ((0x8000, "checksum"), (0x2000, "key"), (0x1000, "sequence")):
        if flags & bit:
            if at + 4 > len(b):
                return None, None, 0, None
            words[name] = int.from_bytes(b[at : at + (2 if name == "checksum" else 4)], "big")
            at += 4
    return {"flags": flags, "protocol_type": protocol, "checksum": None, "key": None, "sequence": None} | words, "eth" if protocol == 0x6558 else ETHERTYPES.get(protocol), at, None


def _vxlan(b: bytes) -> Parsed:
    return ({"flags": b[0], "vni": int.from_bytes(b[4:7], "big")}, "eth", 8, None) if len(b) >= 8 else (None, None, 0, None)


def _mpls(b: bytes) -> Parsed:
    at, depth = 0, 0
    while at + 4 <= len(b):
        word = int.from_bytes(b[at : at + 4], "big")
        at, depth = at + 4, depth + 1
        if word >> 8 & 1:
            return {"label": word >> 12, "tc": word >> 9 & 7, "ttl": word & 255, "stack_depth": depth, "bottom_of_stack": 1}, _by_version(b, at), at, None
    return None, None, 0, None


def _dhcp(b: bytes) -> Parsed:
    if len(b) < 236:
        return None, None, 0, None
    addresses = {n: ip_text(b[k : k + 4]) for n, k in (("ciaddr", 12), ("yiaddr", 16), ("siaddr", 20), ("giaddr", 24))}
    return {"op": b[0], "htype": b[1], "xid": int.from_bytes(b[4:8], "big"), "chaddr": mac(b[28 : 28 + min(b[2], 16)]), "options_raw": b[236:]} | addresses, None, len(b), None


def _dhcpv6(b: bytes) -> Parsed:
    return ({"msg_type": b[0], "transaction_id": int.from_bytes(b[1:4], "big"), "options_raw": b[4:]}, None, len(b), None) if len(b) >= 4 else (None, None, 0, None)


def dns_name(b: bytes, at: int) -> tuple[str, int]:
    """(name, place after it); compression pointers are followed 64 times at most."""
    labels, after, jumps = [], None, 0
    while at < len(b):
        size = b[at]
        if size == 0:
            at += 1
            break
        if size >= 0xC0:
            if at + 1 >= len(b) or jumps >= 64:
                break
            after = at + 2 if after is None else after
            at, jumps = (size & 0x3F) << 8 | b[at + 1], jumps + 1
            continue
        labels.append(b[at + 1 : at + 1 + size].decode("latin-1"))
        at += 1 + size
    return ".".join(labels), at if after is None else after


def _dns(b: bytes) -> Parsed:
    if len(b) < 12:
        return None, None, 0, None
    number, flags, questions, answers, authorities, more = struct.unpack_from("!HHHHHH", b)
    names, kinds, at = [], [], 12
    for _ in range(min(questions, 32)):
        if at >= len(b):
            break
        name, at = dns_name(b, at)
        names.append(name)
        kinds.append(int.from_bytes(b[at : at + 2], "big"))
        at += 4
    fields = {"id": number, "queries": names, "qtypes": kinds, "response": bool(flags >> 15), "response_code": flags & 15, "question_count": questions, "answer_count": answers, "authority_count": authorities, "additional_count": more, "flags": flags}
    return fields, None, len(b), None


PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    "eth": _eth, "vlan": _vlan, "sll": _sll, "sll2": _sll2, "raw": _raw, "loop": _loop, "nflog": _nflog, "arp": _arp, "ip": _ip, "ip6": _ip6, "tcp": _tcp, "udp": _udp, "icmp": _icmp, "icmp6": _icmp,
    "gre": _gre, "vxlan": _vxlan, "mpls": _mpls, "dhcp": _dhcp, "dhcpv6": _dhcpv6, "dns": _dns, "tls": tls.parsed, "quic": quic.parsed,
}
DEPTHS = {"full": 0, "port_only": 1, "none": 2}


def parse(data: bytes, link_type: int = 1, depth: str = "full", more: dict[str, Callable] | None = None, routes: dict[tuple[str, int], str] | None = None) -> dict:
    """Layers of one packet by name, with payload, ip_len, trans_len and app_len.

    ``more`` has parsers of users' own protocols, which land in ``extra``; ``routes`` sends (tcp or udp, port) to them.
    """
    if depth not in DEPTHS:
        raise ValueError(f"app_layer_parsing is full, port_only or none, not {depth!r}")
    out: dict = {}
    extra: dict[str, dict] = {}
    layer, b = LINKS.get(link_type), data
    for _ in range(16):
        if layer is None:
            break
        if layer in PARSERS:
            fields, following, used, end = PARSERS[layer](b)
            if fields is None and layer not in ("raw", "loop", "nflog"):
                break
            if fields is not None:
                out["sll" if layer == "sll2" else layer] = fields
        else:
            fields, used = more[layer](b)
            extra[layer] = fields
            following, end = None, None
        if layer in ("tcp", "udp"):
            out["payload"] = b[used:]
            out["trans_len"] = fields["len"] if layer == "udp" else len(b)
            out["app_len"] = len(b) - used
            for port in (fields["dport"], fields["sport"]):
                following = (routes or {}).get((layer, port), following)
            if DEPTHS[depth] == 2 or DEPTHS[depth] == 1 and following in ("tls", "quic"):
                following = None
            if used >= len(b):
                following = None
        if layer == "ip":
            out["ip_len"] = fields["len"]
        elif layer == "ip6":
            out["ip_len"] = fields["len"] + 40
        b = b[used : end if end is not None else len(b)]
        layer = following if following in PARSERS or following in (more or {}) else None
    if extra:
        out["extra"] = extra
    return out


PACKET_FIELDS = [
    ("file", _S), ("pkt_no", _L), ("ts_us", _L), ("caplen", _L), ("wirelen", _L), ("src_ip", _S), ("dst_ip", _S), ("src_port", _L), ("dst_port", _L), ("protocol", pa.int32()), ("vlan_id", _L), ("ip_len", _L), ("trans_len", _L), ("app_len", _L),
    ("tcp_flags", pa.int32()), ("tcp_win", _L), ("tcp_seq", _L), ("tcp_options", _B), ("ip_hdr", _L), ("l4_hdr", _L), ("ttl", _L), ("tos", _L), ("ip_id", _L), ("payload", _B), ("extra", pa.map_(_S, _S)),
]


def flat(p: dict) -> dict:
    """The columns that flow operators use."""
    ip, ip6, tcp, udp = p.get("ip"), p.get("ip6"), p.get("tcp"), p.get("udp")
    net, l4 = ip or ip6 or {}, tcp or udp or {}
    protocol = ip["proto"] if ip else ip6["next_header"] if ip6 else None
    return {
        "src_ip": net.get("src"), "dst_ip": net.get("dst"), "src_port": l4.get("sport", 0), "dst_port": l4.get("dport", 0), "protocol": protocol, "vlan_id": p["vlan"]["vlan_id"] if "vlan" in p else 0, "ip_len": p.get("ip_len", 0), "trans_len": p.get("trans_len", 0), "app_len": p.get("app_len", 0),
        "tcp_flags": tcp["flags"] if tcp else 0, "tcp_win": tcp["win"] if tcp else None, "tcp_seq": tcp["seq"] if tcp else None, "tcp_options": tcp["options"] if tcp else None, "ip_hdr": net.get("header_len", 0), "l4_hdr": tcp["header_len"] if tcp else 8 if udp else 0,
        "ttl": net.get("ttl", net.get("hop_limit")), "tos": net.get("tos", 0), "ip_id": net.get("id", 0), "payload": p.get("payload"),
    }


def parsing(layers: list[str] | None = None, depth: str = "full", more: dict[str, Callable] | None = None, routes: dict[tuple[str, int], str] | None = None) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], pa.Schema]:
    """From batches of raw packets to batches of what ``packets`` returns, and their schema."""
    import json

    if depth not in DEPTHS:
        raise ValueError(f"app_layer_parsing is full, port_only or none, not {depth!r}")
    wanted = list(LAYERS) if layers is None else layers
    schema = pa.schema(PACKET_FIELDS + [(name, LAYERS[name]) for name in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(rows: list[dict]) -> Iterator[dict]:
            for row in rows:
                p = parse(row["data"], row["link_type"], depth, more, routes)
                extra = [(k, json.dumps(v, default=lambda x: x.hex())) for k, v in p.get("extra", {}).items()]
                yield {k: row[k] for k in ("file", "pkt_no", "ts_us", "caplen", "wirelen")} | flat(p) | {"extra": extra} | {k: p.get(k) for k in wanted}

        for rows in pieces(batches):
            yield from joined(parsed(rows), schema)

    return run, schema


def packets(raw: DataFrame, layers: list[str] | None = None, depth: str = "full", more: dict[str, Callable] | None = None, routes: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """Raw packets with flat columns, payload, and a struct for each of ``layers`` (all by default; name only those that are used)."""
    run, schema = parsing(layers, depth, more, routes)

    from pyspark.sql.pandas.types import from_arrow_schema

    return raw.select("file", "pkt_no", "ts_us", "link_type", "caplen", "wirelen", "data").mapInArrow(run, from_arrow_schema(schema))


def stack(df: DataFrame) -> DataFrame:
    """Adds protocol_stack: the names of the layers that are there, outermost first."""
    names = [n for n in LAYERS if n in df.columns]
    return df.withColumn("protocol_stack", F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), n) for n in names])))
