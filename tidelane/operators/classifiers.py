"""VPN and messaging classification: rules on payloads with a confidence (0 none, 1 low, 2 medium, 3 high), and folds of them over flows.

For VPNs a rule must be more confident than the best so far; for messaging a rule as confident as the best replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DATA_CENTRES, HIGH, HTTP_METHODS, LOW, MEDIUM, MESSAGING_HOSTS
from ..functions.text import entropy_of
from ..sources import tls
from .flows import canonical
from .folds import folded

NONE = 0
#: Entropy in bits a byte above which bytes count as enciphered; and for short random prefixes.
RANDOM, RANDOM_PREFIX = 6.0, 4.8
_HTTP = re.compile(rb"(?:%s) |HTTP/1\." % b"|".join(m.encode() for m in HTTP_METHODS))
_FRONTS = (b"psiphon", b"az668.vo.msecnd.net", b"d2zfqthxsdq309.cloudfront.net", b"s3.amazonaws.com")
#: Lengths of a WireGuard message by its type; operation codes of an OpenVPN reset; ports of local proxies.
WIREGUARD_LENGTHS, OPENVPN_RESETS, PROXY_PORTS, API_PORT, SHADOWSOCKS_PORT = {1: 148, 2: 92, 3: 64}, (1, 2, 7, 8), (7890, 7891), 9090, 8388


def is_tls(p: bytes) -> bool:
    return len(p) >= 5 and 20 <= p[0] <= 23 and p[1] == 3


def is_http(p: bytes) -> bool:
    return _HTTP.match(p) is not None


def http_value(p: bytes, name: bytes) -> bytes:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", p)
    return found[1] if found else b""


# ---- VPN: each takes payload, protocol, source and destination port, and gives (confidence, transport) ----

Rule = Callable[[bytes, int, int, int], tuple[int, str]]


def wireguard(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if proto != 17 or len(p) < 32:
        return NONE, ""
    kind = int.from_bytes(p[:4], "little")
    fits = kind == 4 and (len(p) - 32) % 16 == 0 or WIREGUARD_LENGTHS.get(kind) == len(p)
    return (HIGH if fits else NONE), "udp"


def openvpn(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    data, transport = p, "udp"
    if len(p) < 4:
        return NONE, ""
    if proto == 6:
        size = int.from_bytes(p[:2], "big")
        if size < 3 or size + 2 > len(p):
            return NONE, ""
        data, transport = p[2 : 2 + size], "tcp"
    code = data[0] >> 3
    if len(data) < 2 or not 1 <= code <= 9:
        return NONE, ""
    if len(data) >= 9 and code in OPENVPN_RESETS:
        return HIGH, transport
    return (MEDIUM if code in (4, 5) and len(data) >= 9 else LOW), transport


def quic_vpn(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if proto != 17 or len(p) < 20:
        return NONE, ""
    web = 443 in (sport, dport)
    if p[0] & 0xC0 == 0x40:
        return (NONE if web else LOW), "quic"
    if p[0] & 0xC0 != 0xC0:
        return NONE, ""
    version = int.from_bytes(p[1:5], "big")
    if version not in (0, 1, 0x6B3343CF) and version >> 24 != 0xFF:
        return NONE, ""
    dcid = p[5]
    if dcid > 20 or 7 + dcid > len(p) or 7 + dcid + p[6 + dcid] > len(p):
        return NONE, ""
    if p[0] >> 4 & 3 == 0 and len(p) == 1200:
        return (MEDIUM if web or 8443 in (sport, dport) else HIGH), "quic"
    return (LOW if web else MEDIUM), "quic"


def psiphon(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if len(p) >= 8 and p.startswith(b"SSH-"):
        return MEDIUM, "ssh"
    at = p.find(b"SSH-", 8, 260)
    if len(p) > 20 and at > 0 and entropy_of(p[:at]) > RANDOM_PREFIX:
        return HIGH, "ossh"
    if is_http(p):
        host = http_value(p, b"Host").lower()
        if http_value(p, b"X-Psiphon-Address") or b"psiphon" in http_value(p, b"User-Agent").lower():
            return HIGH, "meek"
        if any(front in host for front in _FRONTS):
            return MEDIUM, "meek"
    return NONE, ""


def lantern(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if len(p) < 8:
        return NONE, ""
    if is_http(p):
        if http_value(p, b"X-Lantern-Version") or http_value(p, b"X-Lantern-Auth") or p.startswith(b"CONNECT ") and b"lantern" in http_value(p, b"User-Agent").lower():
            return HIGH, "http"
    if proto == 6 and p[2] <= 4 and 8 <= int.from_bytes(p[:2], "big") <= len(p) + 64 and entropy_of(p[8:72]) > RANDOM_PREFIX:
        return MEDIUM, "tcp"
    if proto == 17 and len(p) >= 16 and p[0] & 0xC0 == 0xC0:
        version = int.from_bytes(p[1:5], "big")
        if version not in (1, 0x6B3343CF) and version >> 24 != 0xFF and entropy_of(p[:64]) > RANDOM:
            return MEDIUM, "quic"
    return NONE, ""


def clash(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if (sport in PROXY_PORTS or dport in PROXY_PORTS) and len(p) >= 3 or API_PORT in (sport, dport) and is_http(p):
        return MEDIUM, "tcp"
    if is_http(p) and (b"clash" in http_value(p, b"User-Agent").lower() or http_value(p, b"X-Clash-Version")):
        return HIGH, "http"
    return NONE, ""


def vmess(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if len(p) < 16:
        return NONE, ""
    if is_http(p) and b"websocket" in http_value(p, b"Upgrade").lower():
        return MEDIUM, "ws"
    if len(p) >= 24 and p.startswith(b"PRI * HTTP/2.0"):
        return MEDIUM, "h2"
    if is_http(p) and b"application/grpc" in http_value(p, b"Content-Type").lower():
        return MEDIUM, "grpc"
    return (LOW if entropy_of(p[:128]) > RANDOM and not is_tls(p) else NONE), "tcp"


def vless(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    confidence, transport = vmess(p, proto, sport, dport)
    if confidence == NONE and len(p) >= 18 and p[0] == 0 and entropy_of(p[1:33]) > 7.0:
        return LOW, "tcp"
    return confidence, transport


def shadowsocks(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    if len(p) < 32 or is_tls(p) or entropy_of(p[:128]) < RANDOM:
        return NONE, ""
    own = dport == SHADOWSOCKS_PORT
    if 66 <= len(p) <= 400:
        return (HIGH if own else MEDIUM), "tcp" if proto == 6 else "udp"
    return (MEDIUM if own and len(p) <= 600 else LOW), "tcp" if proto == 6 else "udp"


def trojan(p: bytes, proto: int, sport: int, dport: int) -> tuple[int, str]:
    hit = is_tls(p) and dport in (80, 443, 8443) and (len(p) > 5 and p[5] == 1 or p[0] == 23)
    return (LOW if hit else NONE), "tls"


VPN_RULES: dict[str, Rule] = {"wireguard": wireguard, "openvpn": openvpn, "hysteria": quic_vpn, "psiphon": psiphon, "lantern": lantern, "clash": clash, "vmess": vmess, "vless": vless, "shadowsocks": shadowsocks, "trojan": trojan}
#: Rules that a flow asks only while it is unknown or theirs.
_EXCLUSIVE = ("wireguard", "openvpn")


def vpn_packet(p: bytes, proto: int, sport: int, dport: int) -> tuple[str, int, str]:
    """(protocol, confidence, transport) of one payload."""
    best = ("unknown", NONE, "")
    if p:
        for name, rule in VPN_RULES.items():
            confidence, transport = rule(p, proto, sport, dport)
            if confidence > best[1]:
                best = (name, confidence, transport)
    return best


class VpnFlow:
    """A flow's best rule so far, with the mean entropy and first lengths of its payloads."""

    fields = [("src_ip", pa.string()), ("src_port", pa.int64()), ("dst_ip", pa.string()), ("dst_port", pa.int64()), ("protocol", pa.int64()), ("vpn", pa.string()), ("confidence", pa.int64()), ("transport", pa.string()), ("packets", pa.int64()), ("fwd_packets", pa.int64()), ("mean_entropy", pa.float64()), ("lengths", pa.list_(pa.int64())), ("has_tls", pa.bool_()), ("has_http", pa.bool_())]

    def __init__(self):
        self.ends = None
        self.best = ("unknown", NONE, "")
        self.entropy, self.n, self.fwd, self.lengths, self.tls, self.http = 0.0, 0, 0, [], False, False

    def feed(self, row: dict) -> None:
        p = row["payload"]
        if not p:
            return
        if self.ends is None:
            self.ends = {k: row[k] for k in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}
        e = self.ends
        self.n += 1
        self.fwd += row["src_ip"] == e["src_ip"] and row["src_port"] == e["src_port"]
        self.entropy += entropy_of(p[:128])
        self.lengths = (self.lengths + [len(p)])[:16]
        self.tls, self.http = self.tls or is_tls(p), self.http or is_http(p)
        for name, rule in VPN_RULES.items():
            if name in _EXCLUSIVE and self.best[0] not in ("unknown", name):
                continue
            confidence, transport = rule(p, e["protocol"], e["src_port"], e["dst_port"])
            if confidence > self.best[1]:
                self.best = (name, confidence, transport)

    def result(self) -> dict | None:
        if self.best[0] == "unknown":
            return None
        name, confidence, transport = self.best
        return self.ends | {"vpn": name, "confidence": confidence, "transport": transport, "packets": self.n, "fwd_packets": self.fwd, "mean_entropy": self.entropy / self.n, "lengths": self.lengths, "has_tls": self.tls, "has_http": self.http}


# ---- messaging ----


def _by_host(host: str) -> tuple[str, int]:
    low = host.lower()
    return next(((name, conf) for pattern, name, conf in MESSAGING_HOSTS if pattern in low), ("unknown", NONE))


def _in_centre(ip: str) -> bool:
    try:
        number = tuple(int(x) for x in ip.split("."))
    except ValueError:
        return False
    return any(tuple(map(int, lo.split("."))) <= number <= tuple(map(int, hi.split("."))) for lo, hi in DATA_CENTRES)


def mtproto(p: bytes, proto: int) -> int:
    if proto != 6 or not p or is_tls(p):
        return NONE
    if p[0] == 0xEF or p[:4] in (b"\xee" * 4, b"\xdd" * 4):
        return HIGH
    if len(p) >= 8 and 4 <= int.from_bytes(p[:4], "little") <= 65536 and int.from_bytes(p[:4], "little") + 4 <= len(p) + 64:
        return MEDIUM
    return LOW if 56 <= len(p) <= 128 and not is_http(p) and 5.8 < entropy_of(p[:64]) < 7.2 else NONE


def whatsapp(p: bytes, proto: int) -> int:
    if p[:2] == b"WA":
        return HIGH
    if proto == 6 and len(p) >= 3:
        if p[0] >= 0xF8:
            return MEDIUM
        if len(p) >= 4 and 4.0 < entropy_of(p[:32]) < 7.5:
            return LOW
    return NONE


def xmpp(p: bytes) -> int:
    return HIGH if p.startswith((b"<?xml", b"<stream:", b"<stream ")) or len(p) >= 14 and b"jabber" in p.lower() else NONE


def mqtt_connect(p: bytes) -> int:
    if len(p) < 2 or p[0] >> 4 != 1:
        return NONE
    k = 1
    while k < min(len(p), 4) and p[k] & 128:
        k += 1
    return MEDIUM if p[k + 1 : k + 7] == b"\0\4MQTT" and len(p) > k + 7 else NONE


def discord(p: bytes) -> int:
    low = p.lower()
    return MEDIUM if is_http(p) and (b"upgrade: websocket" in low or b"discord" in low) else NONE


def im_packet(p: bytes, proto: int, sport: int, dport: int) -> tuple[str, int]:
    """(application, confidence) of one payload: the first rule with at least medium confidence, then hosts, agents and ports."""
    if not p:
        return "unknown", NONE
    for name, confidence in (("mtproto", mtproto(p, proto)), ("xmpp", xmpp(p)), ("whatsapp", whatsapp(p, proto)), ("messenger", mqtt_connect(p)), ("discord", discord(p))):
        if confidence >= MEDIUM:
            return name, confidence
    if tls.is_client_hello(p):
        found = _by_host((tls.parsed(p)[0] or {}).get("sni") or "")
        if found[1] >= MEDIUM:
            return found
    if is_http(p):
        found = _by_host(http_value(p, b"Host").decode("latin-1"))
        if found[1] >= MEDIUM:
            return found
        agent = http_value(p, b"User-Agent").lower()
        for name in ("telegram", "whatsapp"):
            if name.encode() in agent:
                return name, MEDIUM
    if (5222 in (sport, dport) or dport in (5223, 5228)) and entropy_of(p[:256]) > RANDOM:
        return "generic", LOW
    return "unknown", NONE


def fake_tls(p: bytes, server_ip: str, server_port: int) -> int:
    """A padded ClientHello to an unusual port, or any to a data centre."""
    if not tls.is_client_hello(p):
        return NONE
    padded = 480 <= len(p) <= 600 and p[-160:].count(0) >= 50
    return HIGH if padded and server_port > 1024 and server_port not in (443, 8443) or _in_centre(server_ip) else NONE


class ImFlow:
    """A flow's application; a rule as confident as the best so far replaces it."""

    fields = [("src_ip", pa.string()), ("src_port", pa.int64()), ("dst_ip", pa.string()), ("dst_port", pa.int64()), ("protocol", pa.int64()), ("app", pa.string()), ("confidence", pa.int64()), ("packets", pa.int64()), ("sni", pa.string())]

    def __init__(self):
        self.ends, self.app, self.confidence, self.n, self.sni = None, "unknown", NONE, 0, None

    def best(self, app: str, confidence: int) -> None:
        if app != "unknown" and confidence > NONE and confidence >= self.confidence:
            self.app, self.confidence = app, confidence

    def feed(self, row: dict) -> None:
        p = row["payload"]
        if not p:
            return
        if self.ends is None:
            self.ends = {k: row[k] for k in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}
        e = self.ends
        self.n += 1
        if tls.is_client_hello(p):
            self.sni = self.sni or (tls.parsed(p)[0] or {}).get("sni")
            self.best("telegram", fake_tls(p, e["dst_ip"], e["dst_port"]))
        self.best(*im_packet(p, e["protocol"], e["src_port"], e["dst_port"]))

    def result(self) -> dict | None:
        return None if self.app == "unknown" else self.ends | {"app": self.app, "confidence": self.confidence, "packets": self.n, "sni": self.sni}


_COLUMNS = ["payload", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _keyed(packets: DataFrame) -> DataFrame:
    return packets if "flow" in packets.columns else canonical(packets)


def vpn_flows(packets: DataFrame) -> DataFrame:
    """One row for each flow that a VPN rule fits."""
    return folded(_keyed(packets).filter(F.col("protocol").isin(6, 17)), VpnFlow, VpnFlow.fields, _COLUMNS)


def im_flows(packets: DataFrame) -> DataFrame:
    """One row for each flow that a messaging rule fits."""
    return folded(_keyed(packets).filter(F.col("protocol").isin(6, 17)), ImFlow, ImFlow.fields, _COLUMNS)


def wireguard_column(payload: Column, protocol: Column) -> Column:
    """The WireGuard rule without Python: confidence from the first bytes and the length."""
    kind, size = F.hex(F.substring(payload, 1, 4)), F.length(payload)
    fits = F.coalesce(*[F.when(kind == f"0{k}000000", size == n) for k, n in WIREGUARD_LENGTHS.items()], F.when(kind == "04000000", (size - 32) % 16 == 0), F.lit(False))
    return F.when((protocol == 17) & (size >= 32) & fits, HIGH).otherwise(NONE)


def vpn_packets(packets: DataFrame) -> DataFrame:
    """Each packet's own classification: pkt_no, vpn, confidence, transport."""

    def run(batches):
        for batch in batches:
            found = [vpn_packet(p or b"", proto or 0, s or 0, d or 0) for p, proto, s, d in zip(batch["payload"], batch["protocol"], batch["src_port"], batch["dst_port"], strict=True)]
            yield pd.DataFrame({"pkt_no": batch["pkt_no"], "vpn": [x[0] for x in found], "confidence": [x[1] for x in found], "transport": [x[2] for x in found]})

    return packets.select("pkt_no", "payload", "protocol", "src_port", "dst_port").mapInPandas(run, "pkt_no bigint, vpn string, confidence int, transport string")
