"""Application metadata by flow: HTTP, SSH, MQTT, SIP, QUIC, RDP, VNC, DNS, DHCP and TLS.

Each kind takes packets with ``payload`` (see ``sources.layers.packets``), admits those of its ports or with its signature, and folds each flow in order. A
flow without a sign of the protocol gives no row.
"""

from __future__ import annotations

import collections
import re
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DNS_OPCODES, DNS_RCODES, DNS_TYPES, DHCP_MESSAGES, HTTP_METHODS, PORTS, SIP_METHODS
from ..sources import quic as quic_bytes
from ..sources import tls as tls_bytes
from ..sources.layers import dns_name, ip_text, mac
from .flows import canonical
from .folds import folded

_L, _S, _B, _D = pa.int64(), pa.string(), pa.bool_(), pa.float64()
_COLUMNS = ["payload", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts_us"]
_TEXT = "latin-1"


def _ends(row: dict) -> dict:
    return {k: row[k] for k in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}


_END_FIELDS = [("src_ip", _S), ("src_port", _L), ("dst_ip", _S), ("dst_port", _L), ("protocol", _L)]


class Fold:
    """The common part: ends of the first packet, which side sent a packet, counters of packets and bytes of each side."""

    ports: tuple[int, ...] = ()
    fields: list[tuple[str, pa.DataType]] = []

    def __init__(self):
        self.ends: dict | None = None
        self.out: dict = {name: [] if pa.types.is_list(kind) else False if kind == _B else None if kind == _S else 0 for name, kind in self.fields}
        self.packets, self.bytes = [0, 0], [0, 0]

    def feed(self, row: dict) -> None:
        if not row["payload"]:
            return
        if self.ends is None:
            self.ends = _ends(row)
        to, by = row["dst_port"] in self.ports, row["src_port"] in self.ports
        client = True if to and not by else False if by and not to else row["src_port"] > row["dst_port"]
        self.packets[not client] += 1
        self.bytes[not client] += len(row["payload"])
        self.data(row["payload"], client, row["ts_us"])

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        raise NotImplementedError

    def seen(self) -> bool:
        return True

    def result(self) -> dict | None:
        return None if self.ends is None or not self.seen() else self.ends | self.out

    def first(self, name: str, value) -> None:
        if not self.out[name]:
            self.out[name] = value

    def add(self, name: str, value, most: int) -> None:
        if value not in self.out[name] and len(self.out[name]) < most:
            self.out[name].append(value)


def _headers(head: str) -> dict[str, str]:
    """Headers by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for line in head.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class Http(Fold):
    """Messages are cut at the blank line and by Content-Length; later ones replace what earlier ones said."""

    ports = PORTS["http"]
    fields = [
        ("http_version", _S), ("is_http2", _B), ("method", _S), ("status_code", _L), ("status_reason", _S), ("url", _S), ("host", _S), ("user_agent", _S), ("server", _S), ("content_type", _S), ("content_length", _L), ("requests", _L), ("responses", _L),
        ("status_1xx", _L), ("status_2xx", _L), ("status_3xx", _L), ("status_4xx", _L), ("status_5xx", _L), ("request_bytes", _L), ("response_bytes", _L), ("has_auth", _B), ("websocket_upgrade", _B), ("set_cookies", _L), ("rtt_us", _L),
    ]
    signature = re.compile(rb"(?:%s) |HTTP/1\.|PRI \* HTTP/2\.0" % b"|".join(m.encode() for m in HTTP_METHODS))

    #: Bytes of a head that never ends which are kept: its last ones.
    longest_head = 65536

    def __init__(self):
        super().__init__()
        self.heads, self.bodies, self.asked = [b"", b""], [None, None], None  # what of a head is there; (line, headers, whole size, bytes still to come)

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        side, at = not client, 0
        while at < len(payload):
            if self.bodies[side] is not None:  # a body is counted, never kept
                line, found, size, left = self.bodies[side]
                step = min(left, len(payload) - at)
                at += step
                self.bodies[side] = (line, found, size, left - step)
                if left > step:
                    return
            else:
                head, before = self.heads[side] + payload[at:], len(self.heads[side])
                if head.startswith(b"PRI * HTTP/2.0"):
                    self.out["is_http2"], self.heads[side] = True, b""
                    self.first("http_version", "2.0")
                    return
                end = head.find(b"\r\n\r\n", max(0, before - 3))
                if end < 0:
                    self.heads[side] = head[-self.longest_head :]
                    return
                at += end + 4 - before
                text = head[:end].decode(_TEXT)
                found = _headers(text)
                left = int(found["content-length"]) if found.get("content-length", "").isdigit() else 0
                self.heads[side], self.bodies[side] = b"", (text.split("\r\n", 1)[0], found, end + 4 + left, left)
            line, found, size, left = self.bodies[side]
            if not left:
                self.message(line, found, size, ts_us)
                self.bodies[side] = None

    def message(self, line: str, h: dict[str, str], size: int, ts_us: int) -> None:
        o, parts = self.out, line.split(" ", 2)
        if line.startswith("HTTP/"):
            o["http_version"], o["responses"], o["response_bytes"] = parts[0][5:], o["responses"] + 1, o["response_bytes"] + size
            code = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 0
            o["status_code"], o["status_reason"] = code, parts[2] if len(parts) > 2 else ""
            if f"status_{code // 100}xx" in o:
                o[f"status_{code // 100}xx"] += 1
            o["server"] = h.get("server", o["server"])
            o["set_cookies"] += "set-cookie" in h
            if self.asked is not None:
                o["rtt_us"], self.asked = ts_us - self.asked, None
        elif parts[0] in HTTP_METHODS and len(parts) > 1:
            o["requests"], o["request_bytes"], self.asked = o["requests"] + 1, o["request_bytes"] + size, ts_us
            o["method"], o["url"], o["http_version"] = parts[0], parts[1][:511], parts[2][5:] if len(parts) > 2 else o["http_version"]
            o["host"], o["user_agent"] = h.get("host", o["host"]), h.get("user-agent", o["user_agent"])
            o["has_auth"] |= "authorization" in h or "x-api-key" in h
        else:
            return
        o["websocket_upgrade"] |= h.get("upgrade", "").lower() == "websocket"
        o["content_type"] = h.get("content-type", o["content_type"])
        o["content_length"] = int(h["content-length"]) if h.get("content-length", "").isdigit() else o["content_length"]

    def seen(self) -> bool:
        return bool(self.out["requests"] or self.out["responses"] or self.out["is_http2"])


class Ssh(Fold):
    """Banners, the algorithms that both sides' lists agree on (the client's first that the server has), and state until new keys are in use."""

    ports = PORTS["ssh"]
    fields = [("cli_banner", _S), ("srv_banner", _S), ("state", _S), ("neg_kex", _S), ("kex_type", _S), ("neg_enc_c2s", _S), ("neg_enc_s2c", _S), ("host_key_type", _S), ("pkts_total", _L), ("bytes_pre_enc", _L), ("bytes_post_enc", _L), ("disconnect_reason", _L)]
    signature = re.compile(rb"SSH-")
    states = ("INIT", "BANNER", "KEXINIT", "KEX", "NEWKEYS", "ENCRYPTED")

    def __init__(self):
        super().__init__()
        self.buffers, self.lists, self.keys, self.state = [b"", b""], [None, None], [False, False], 0

    def reach(self, name: str) -> None:
        self.state = max(self.state, self.states.index(name))

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        side = not client
        self.out["pkts_total"] += 1
        if all(self.keys):
            self.reach("ENCRYPTED")
            self.out["bytes_post_enc"] += len(payload)
            return
        self.out["bytes_pre_enc"] += len(payload)
        buf = self.buffers[side] + payload
        if buf.startswith(b"SSH-"):
            line, end, rest = buf.partition(b"\n")
            if not end:
                self.buffers[side] = buf
                return
            self.first("cli_banner" if client else "srv_banner", line.decode(_TEXT).strip())
            self.reach("BANNER")
            buf = rest
        while len(buf) >= 6 and not self.keys[side]:
            size, pad = struct.unpack_from("!IB", buf)
            if not 1 <= size <= 35000:
                buf = b""
            if not buf or len(buf) < 4 + size:
                break
            self.packet(buf[5 : 4 + size - pad], side)
            buf = buf[4 + size :]
        self.buffers[side] = buf

    def packet(self, body: bytes, side: bool) -> None:
        kind = body[0] if body else 0
        if kind == 20 and self.lists[side] is None:
            self.reach("KEXINIT")
            names, at = [], 17
            for _ in range(8):
                part, at = tls_bytes._vector(body, at, 4)
                names.append(part.decode(_TEXT).split(","))
            self.lists[side] = names
            if all(self.lists):
                agreed = [next((x for x in mine if x in theirs), None) for mine, theirs in zip(*self.lists, strict=True)]
                self.out["neg_kex"], self.out["neg_enc_c2s"], self.out["neg_enc_s2c"] = agreed[0], agreed[2], agreed[3]
                kex = agreed[0] or ""
                self.out["kex_type"] = "ecdh" if "ecdh" in kex or "curve" in kex else "dh-gex" if "group-exchange" in kex or "gex" in kex else "dh-group" if "diffie-hellman" in kex else "unknown"
        elif 30 <= kind <= 34:
            self.reach("KEX")
            if side and kind in (31, 33) and not self.out["host_key_type"]:  # a reply begins with the server's key, which begins with its kind
                key = tls_bytes._vector(body, 1, 4)[0]
                name = tls_bytes._vector(key, 0, 4)[0]
                if name and len(name) < 64 and name.isascii() and int.from_bytes(key[:4], "big") == len(name):
                    self.out["host_key_type"] = name.decode()
        elif kind == 21:
            self.reach("NEWKEYS")
            self.keys[side] = True
        elif kind == 1 and len(body) >= 5:
            self.out["disconnect_reason"] = int.from_bytes(body[1:5], "big")

    def seen(self) -> bool:
        self.out["state"] = self.states[self.state]
        self.out["kex_type"] = self.out["kex_type"] or "unknown"
        self.out["host_key_type"] = self.out["host_key_type"] or ""
        return bool(self.out["cli_banner"] or self.out["srv_banner"] or self.state)


class Mqtt(Fold):
    """Control packets; any first nibble from 1 to 15 admits a payload, so other TCP traffic gives rows too."""

    ports = PORTS["mqtt"]
    fields = [("protocol_name", _S), ("protocol_version", _S), ("client_id", _S), ("username", _S), ("keep_alive_secs", _L), ("clean_session", _L), ("connack_return_code", _L), ("publishes", _L), ("publish_topics", pa.list_(_S)), ("sub_topics", pa.list_(_S)), ("granted", _L), ("refused", _L), ("pkts_cli", _L), ("pkts_srv", _L), ("bytes_cli", _L), ("bytes_srv", _L)]
    signature = re.compile(rb"[\x10-\xff]")

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        at = 0
        while at + 2 <= len(payload):
            kind, flags, size, k = payload[at] >> 4, payload[at] & 15, 0, 0
            while at + 1 + k < len(payload) and k < 4:
                size |= (payload[at + 1 + k] & 127) << 7 * k
                k += 1
                if not payload[at + k] & 128:
                    break
            body = payload[at + 1 + k : at + 1 + k + size]
            if len(body) < size:
                break
            try:
                self.control(kind, flags, body)
            except IndexError:
                break
            at += 1 + k + size

    def control(self, kind: int, flags: int, b: bytes) -> None:
        o = self.out
        if kind == 1 and len(b) > 8:
            name, at = tls_bytes._vector(b, 0, 2)
            level, bits = b[at], b[at + 1]
            o["protocol_name"], o["protocol_version"] = name.decode(_TEXT), {3: "3.1", 4: "3.1.1", 5: "5.0"}.get(level, str(level))
            o["keep_alive_secs"], o["clean_session"], at = int.from_bytes(b[at + 2 : at + 4], "big"), bits >> 1 & 1, at + 4
            if level == 5:
                at = at + 1 + b[at]
            client, at = tls_bytes._vector(b, at, 2)
            o["client_id"] = client.decode(_TEXT)
            if bits & 4:
                for _ in range(2):
                    _, at = tls_bytes._vector(b, at, 2)
            if bits & 128:
                o["username"] = tls_bytes._vector(b, at, 2)[0].decode(_TEXT)
        elif kind == 2 and len(b) >= 2:
            o["connack_return_code"] = b[1]
        elif kind == 3:
            o["publishes"] += 1
            self.add("publish_topics", tls_bytes._vector(b, 0, 2)[0].decode(_TEXT), 8)
        elif kind == 8:
            at = 2
            while at + 3 <= len(b):
                topic, at = tls_bytes._vector(b, at, 2)
                self.add("sub_topics", topic.decode(_TEXT), 8)
                at += 1
        elif kind == 9:
            o["granted"] += sum(x <= 2 for x in b[2:])
            o["refused"] += sum(x == 0x80 for x in b[2:])

    def seen(self) -> bool:
        (self.out["pkts_cli"], self.out["pkts_srv"]), (self.out["bytes_cli"], self.out["bytes_srv"]) = self.packets, self.bytes
        return True


class Sip(Fold):
    """The first request's method, the last response's status, dialogue headers (also in short forms), responses by class, media lines."""

    ports = PORTS["sip"]
    fields = [("method", _S), ("status_code", _L), ("status_reason", _S), ("call_id", _S), ("from_uri", _S), ("to_uri", _S), ("user_agent", _S), ("server", _S), ("messages", _L), ("transactions", _L), *[(f"resp_{k}xx", _L) for k in range(1, 7)], ("via_hops", _L), ("sdp_media_cnt", _L)]
    signature = re.compile(rb"SIP/2\.0 |(?:%s) " % b"|".join(m.encode() for m in SIP_METHODS))
    short = {"v": "via", "f": "from", "t": "to", "i": "call-id", "m": "contact", "s": "subject"}

    def __init__(self):
        super().__init__()
        self.sequence = set()

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        if not self.signature.match(payload):
            return
        head, _, body = payload.decode(_TEXT).partition("\r\n\r\n")
        h = {self.short.get(k, k): v for k, v in _headers(head).items()}
        o, line = self.out, head.split("\r\n", 1)[0].split(" ", 2)
        o["messages"] += 1
        if line[0] == "SIP/2.0":
            code = int(line[1]) if len(line) > 1 and line[1].isdigit() else 0
            o["status_code"], o["status_reason"] = code, line[2] if len(line) > 2 else ""
            if f"resp_{code // 100}xx" in o:
                o[f"resp_{code // 100}xx"] += 1
        else:
            self.first("method", line[0])
        self.sequence.add(h.get("cseq"))
        o["transactions"] = len(self.sequence - {None})
        for name, key in (("call_id", "call-id"), ("from_uri", "from"), ("to_uri", "to"), ("user_agent", "user-agent"), ("server", "server")):
            if key in h:
                self.first(name, re.sub(r".*<([^>]*)>.*", r"\1", h[key]) if "uri" in name else h[key])
        o["via_hops"] = max(o["via_hops"], len(re.findall(r"\r\n(?:Via|v)\s*:", head, re.I)))
        o["sdp_media_cnt"] = max(o["sdp_media_cnt"], min(8, len(re.findall(r"(?m)^m=", body))))

    def seen(self) -> bool:
        return self.out["messages"] > 0


class Quic(Fold):
    """Counts by packet type, the first version and connection ids, version negotiation."""

    ports = PORTS["quic"]
    fields = [("version", _S), ("version_hex", _S), ("n_total", _L), ("n_initial", _L), ("n_0rtt", _L), ("n_handshake", _L), ("n_retry", _L), ("n_short", _L), ("seen_version_neg", _B), ("first_dcid", _S), ("first_scid", _S), ("first_us", _L), ("last_us", _L), ("spin_bit", _L), ("sni", _S)]
    signature = re.compile(rb"[\xc0-\xff]")

    def __init__(self):
        super().__init__()
        self.dcid_len = None

    def data(self, b: bytes, client: bool, ts_us: int) -> None:
        o = self.out
        if b[0] & 0x80 and len(b) >= 7:
            version = int.from_bytes(b[1:5], "big")
            known = version in (0, quic_bytes.V1, quic_bytes.V2) or version >> 24 == 0xFF or version == 0xFACE << 16 or version >> 16 == 0xFACE
            if not known or b[5] > 20:
                return
            dcid, at = tls_bytes._vector(b, 5, 1)
            scid, _ = tls_bytes._vector(b, at, 1)
            if version == 0:
                o["seen_version_neg"] = True
            else:
                o[("n_initial", "n_0rtt", "n_handshake", "n_retry")[b[0] >> 4 & 3]] += 1
                if self.dcid_len is None:
                    o["version"], o["version_hex"] = {1: "v1", quic_bytes.V2: "v2"}.get(version, "draft"), f"0x{version:08x}"
                    o["first_dcid"], o["first_scid"], self.dcid_len = dcid.hex(), scid.hex(), len(dcid)
                if not o["sni"] and (found := quic_bytes.parsed(b)[0]):
                    o["sni"] = found["sni"]
        elif self.dcid_len is not None and b[0] & 0xC0 == 0x40 and len(b) >= 1 + self.dcid_len:
            o["n_short"] += 1
            o["spin_bit"] = b[0] >> 5 & 1
        else:
            return
        o["n_total"] += 1
        o["first_us"], o["last_us"] = o["first_us"] or ts_us, ts_us

    def seen(self) -> bool:
        return self.dcid_len is not None or self.out["seen_version_neg"]


class Rdp(Fold):
    """Connection request and confirm, data and disconnect units; requested and selected protocol; the client's core and security data."""

    ports = PORTS["rdp"]
    fields = [("seen_cr", _B), ("seen_cc", _B), ("seen_dt", _B), ("seen_dr", _B), ("cookie", _S), ("req_protocols", _L), ("sel_protocol", _L), ("neg_failure", _B), ("client_name", _S), ("desktop_width", _L), ("desktop_height", _L), ("color_depth", _L), ("encryption_method", _L)]
    signature = re.compile(rb"\x03\x00..[\x02-\xff][\xe0\xd0\xf0\x80]", re.S)

    def data(self, b: bytes, client: bool, ts_us: int) -> None:
        if len(b) < 7 or b[0] != 3 or b[1] != 0:
            return
        kind, o = b[5] & 0xF0, self.out
        if kind == 0xE0:
            o["seen_cr"] = True
            if found := re.search(rb"Cookie: mstshash=([^\r\n]*)", b):
                o["cookie"] = found[1].decode(_TEXT)
            if len(b) >= 19 and b[-8] == 1:
                o["req_protocols"] = int.from_bytes(b[-4:], "little")
        elif kind == 0xD0:
            o["seen_cc"] = True
            if len(b) >= 19:
                o["sel_protocol"], o["neg_failure"] = (int.from_bytes(b[15:19], "little") if b[11] == 2 else 0), b[11] == 3
        elif kind == 0x80:
            o["seen_dr"] = True
        elif kind == 0xF0:
            o["seen_dt"] = True
            core = b.find(b"\x01\xc0")
            if client and 0 <= core and len(b) >= core + 56:
                o["desktop_width"], o["desktop_height"] = struct.unpack_from("<HH", b, core + 8)
                o["color_depth"] = {0xCA00: 4, 0xCA01: 8, 0xCA02: 15, 0xCA03: 16, 0xCA04: 24}.get(struct.unpack_from("<H", b, core + 12)[0], 0)
                o["client_name"] = b[core + 24 : core + 56].decode("utf-16-le", "ignore").split("\0")[0]
            security = b.find(b"\x02\xc0")
            if client and 0 <= security and len(b) >= security + 8:
                o["encryption_method"] = int.from_bytes(b[security + 4 : security + 8], "little")

    def seen(self) -> bool:
        return any(self.out[k] for k in ("seen_cr", "seen_cc", "seen_dt", "seen_dr"))


class Vnc(Fold):
    """The handshake of remote frame buffers: versions, security, result, size and name of the desktop."""

    ports = PORTS["vnc"]
    fields = [("proto_version", _S), ("state", _S), ("security_types", pa.list_(_L)), ("chosen_security", _L), ("auth_ok", _B), ("width", _L), ("height", _L), ("desktop_name", _S)]
    signature = re.compile(rb"RFB \d{3}\.\d{3}")

    def __init__(self):
        super().__init__()
        self.state = "SERVER_VERSION"

    def data(self, b: bytes, client: bool, ts_us: int) -> None:
        o, s = self.out, self.state
        if self.signature.match(b):
            o["proto_version"] = f"{int(b[4:7])}.{int(b[8:11])}"
            self.state = "SECURITY" if client else "CLIENT_VERSION"
        elif s == "SECURITY" and not client:
            if o["proto_version"] == "3.3" and len(b) >= 4:
                o["chosen_security"] = int.from_bytes(b[:4], "big")
                self.state = "AUTH" if o["chosen_security"] == 2 else "CLIENT_INIT"
            else:
                o["security_types"] = list(b[1 : 1 + b[0]])
                self.state = "CHOICE"
        elif s == "CHOICE" and client:
            o["chosen_security"] = b[0]
            self.state = "AUTH" if b[0] == 2 else "RESULT"
        elif s == "AUTH" and client and len(b) == 16:
            self.state = "RESULT"
        elif s == "RESULT" and not client and len(b) >= 4:
            o["auth_ok"] = b[:4] == bytes(4)
            self.state = "CLIENT_INIT" if o["auth_ok"] else "FAILED"
        elif s == "CLIENT_INIT" and client:
            self.state = "SERVER_INIT"
        elif s in ("CLIENT_INIT", "SERVER_INIT") and not client and len(b) >= 24:
            o["width"], o["height"] = struct.unpack_from("!HH", b)
            o["desktop_name"] = tls_bytes._vector(b, 20, 4)[0].decode(_TEXT)
            self.state = "RUNNING"

    def seen(self) -> bool:
        self.out["state"] = self.state
        return bool(self.out["proto_version"])


def rdata(b: bytes, kind: int, at: int, size: int) -> str:
    """A DNS record's data as text."""
    name = DNS_TYPES.get(kind)
    if name == "A" and size == 4 or name == "AAAA" and size == 16:
        return ip_text(b[at : at + size])
    if name in ("CNAME", "NS", "PTR"):
        return dns_name(b, at)[0]
    if name == "MX" and size > 2:
        return f"{int.from_bytes(b[at : at + 2], 'big')} {dns_name(b, at + 2)[0]}"
    if name == "TXT":
        out, k = [], at
        while k < at + size:
            part, k = tls_bytes._vector(b, k, 1)
            out.append(part.decode(_TEXT))
        return "".join(out)
    if name == "SOA":
        first, k = dns_name(b, at)
        second, k = dns_name(b, k)
        return " ".join([first, second, *map(str, struct.unpack_from("!IIIII", b, k))])
    if name == "SRV" and size > 6:
        return " ".join(map(str, struct.unpack_from("!HHH", b, at))) + " " + dns_name(b, at + 6)[0]
    return f"({size} bytes)"


def dns_message(b: bytes) -> dict | None:
    """Header, first question, up to 16 answers and authorities, and the EDNS payload size of a DNS message; None if it is too short."""
    if len(b) < 12:
        return None
    number, flags, questions, answers, authorities, more = struct.unpack_from("!HHHHHH", b)
    out = {"edns": 0, "authorities": [], "id": number, "response": bool(flags >> 15), "opcode": DNS_OPCODES.get(flags >> 11 & 15, str(flags >> 11 & 15)), "rcode": DNS_RCODES.get(flags & 15, str(flags & 15)), "qname": "", "qtype": "", "answers": []}
    at = 12
    for k in range(min(questions, 32)):
        name, at = dns_name(b, at)
        kind = int.from_bytes(b[at : at + 2], "big")
        at += 4
        if k == 0:
            out["qname"], out["qtype"] = name, DNS_TYPES.get(kind, str(kind))
    for section, n in (("answers", answers), ("authorities", authorities), ("", more)):
        for _ in range(n):
            if at >= len(b):
                return out
            name, at = dns_name(b, at)
            if at + 10 > len(b):
                return out
            kind, first, ttl, size = struct.unpack_from("!HHIH", b, at)
            at += 10
            if kind == 41:
                out["edns"] = first  # the largest payload over UDP that the sender takes
            elif section and len(out[section]) < 16:
                try:
                    out[section].append(f"{name} {ttl} {DNS_TYPES.get(kind, str(kind))} {rdata(b, kind, at, size)}")
                except (IndexError, struct.error):
                    return out
            at += size
    return out


class Dns(Fold):
    """Messages over UDP, and over TCP by their length prefix; each response is paired with the earliest open query of its number."""

    ports = PORTS["dns"]
    fields = [("queries", _L), ("responses", _L), ("nxdomain", _L), ("servfail", _L), ("rtt_min_ms", _D), ("rtt_max_ms", _D), ("rtt_avg_ms", _D), ("rtt_samples", _L), ("ns_records", _L), ("edns_size", _L), ("qnames", pa.list_(_S)), ("messages", pa.list_(_S))]
    signature = None

    def __init__(self):
        super().__init__()
        self.open, self.rtts, self.buffers = collections.defaultdict(collections.deque), [], [b"", b""]

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        parts = [payload]
        if self.ends["protocol"] == 6:
            buf, parts = self.buffers[not client] + payload, []
            while len(buf) >= 2 and len(buf) >= 2 + int.from_bytes(buf[:2], "big"):
                size = int.from_bytes(buf[:2], "big")
                parts.append(buf[2 : 2 + size])
                buf = buf[2 + size :]
            self.buffers[not client] = buf
        for part in parts:
            if not (m := dns_message(part)):
                continue
            o = self.out
            o["responses" if m["response"] else "queries"] += 1
            o["nxdomain"] += m["response"] and m["rcode"] == "NXDOMAIN"
            o["servfail"] += m["response"] and m["rcode"] == "SERVFAIL"
            o["ns_records"] += sum(" NS " in x for x in m["authorities"])
            o["edns_size"] = m["edns"] or o["edns_size"]
            self.add("qnames", m["qname"], 64)
            if len(o["messages"]) < 64:
                o["messages"].append(f"{'R' if m['response'] else 'Q'} {m['id']} {m['opcode']} {m['rcode']} {m['qname']} {m['qtype']} " + "; ".join(m["answers"] + m["authorities"]))
            if not m["response"]:
                self.open[m["id"]].append(ts_us)
            elif self.open[m["id"]]:
                self.rtts.append((ts_us - self.open[m["id"]].popleft()) / 1000)

    def seen(self) -> bool:
        if self.rtts:
            self.out |= {"rtt_min_ms": min(self.rtts), "rtt_max_ms": max(self.rtts), "rtt_avg_ms": sum(self.rtts) / len(self.rtts), "rtt_samples": len(self.rtts)}
        return self.out["queries"] + self.out["responses"] > 0


class Dhcp(Fold):
    """Message types, and the last hardware address, names and addresses."""

    ports = PORTS["dhcp"]
    fields = [("messages", _L), *[(f"{n.lower()}_count", _L) for n in DHCP_MESSAGES.values()], ("mac", _S), ("hostname", _S), ("vendor", _S), ("requested_ip", _S), ("assigned_ip", _S), ("server_ip", _S), ("lease_secs", _L), ("subnet", _S), ("router", _S), ("domain", _S)]
    signature = None
    addresses = {50: "requested_ip", 54: "server_ip", 1: "subnet", 3: "router"}
    texts = {12: "hostname", 15: "domain", 60: "vendor"}

    def data(self, b: bytes, client: bool, ts_us: int) -> None:
        if len(b) < 240:
            return
        o = self.out
        o["messages"] += 1
        o["mac"] = mac(b[28:34])
        if any(b[16:20]):
            o["assigned_ip"] = ip_text(b[16:20])
        at = 240
        while at + 1 < len(b) and b[at] != 255:
            if b[at] == 0:
                at += 1
                continue
            kind = b[at]
            body, at = tls_bytes._vector(b, at + 1, 1)
            if kind == 53 and body and body[0] in DHCP_MESSAGES:
                o[f"{DHCP_MESSAGES[body[0]].lower()}_count"] += 1
            elif kind in self.addresses and len(body) >= 4:
                o[self.addresses[kind]] = ip_text(body[:4])
            elif kind == 51:
                o["lease_secs"] = int.from_bytes(body, "big")
            elif kind in self.texts:
                o[self.texts[kind]] = body.decode(_TEXT)

    def seen(self) -> bool:
        return self.out["messages"] > 0


class Tls(Fold):
    """Records of each direction, put together from their segments in order of arrival; hellos, certificates, alerts, counters and fingerprints."""

    ports = PORTS["tls"]
    fields = [
        ("version", _L), ("hello_version", _L), ("negotiated_version", _L), ("sni", _S), ("alpn", pa.list_(_S)), ("cipher_suites", pa.list_(_L)), ("cipher_suite", _L), ("extensions", pa.list_(_L)), ("server_extensions", pa.list_(_L)), ("supported_groups", pa.list_(_L)), ("point_formats", pa.list_(_L)),
        ("signature_algorithms", pa.list_(_L)), ("supported_versions", pa.list_(_L)), ("handshake_types", pa.list_(_L)), ("certificates", pa.list_(_S)), ("records", _L), ("record_bytes", _L), ("alert_description", _L), ("handshake_complete", _B),
    ]
    signature = re.compile(rb"[\x14-\x17]\x03[\x00-\x04]")

    def __init__(self):
        super().__init__()
        self.buffers, self.hidden, self.said, self.changed = [b"", b""], [False, False], None, False

    def data(self, payload: bytes, client: bool, ts_us: int) -> None:
        buf = self.buffers[not client] + payload
        found, used, self.hidden[not client] = tls_bytes.records_after(buf, self.hidden[not client])
        if found:
            self.said = tls_bytes.merge_into(self.said, found)
            self.out["records"] += len(found["record_types"])
            self.out["record_bytes"] += used - 5 * len(found["record_types"])
            self.out["handshake_complete"] |= self.changed and 23 in found["record_types"]
            self.changed |= 20 in found["record_types"]
        self.buffers[not client] = buf[used : used + tls_bytes.LONGEST + 5]

    def seen(self) -> bool:
        if (merged := self.said) is None:
            return False
        for name, _ in self.fields:
            if name in merged and name != "certificates":
                self.out[name] = merged[name] if merged[name] is not None else self.out[name]
        for cert in merged["certificates"][:3]:
            try:
                said = tls_bytes.certificate(cert)
                self.out["certificates"].append(f"{said['subject'].get('CN', '')}|{said['issuer'].get('CN', '')}|{said['serial']}|{said['not_before']}|{said['not_after']}|{said['signature_algorithm']}|{said['key_bits'] or ''}|{','.join(said['san'])}|{said['sha1']}")
            except (ValueError, IndexError):
                self.out["certificates"].append("")
        return True


KINDS: dict[str, type[Fold]] = {"http": Http, "ssh": Ssh, "mqtt": Mqtt, "sip": Sip, "quic": Quic, "rdp": Rdp, "vnc": Vnc, "dns": Dns, "dhcp": Dhcp, "tls": Tls}
_TRANSPORT = {"quic": (17,), "dhcp": (17,), "http": (6,), "ssh": (6,), "mqtt": (6,), "rdp": (6,), "vnc": (6,), "tls": (6,)}


def metadata(packets: DataFrame, kind: str, filter_port: int = 0) -> DataFrame:
    """One row for each flow of that kind; packets without data take no part. ``filter_port``: only flows with that port at an end."""
    if filter_port:
        packets = packets.filter((F.col("src_port") == filter_port) | (F.col("dst_port") == filter_port))
    fold: Callable = KINDS[kind]
    near = F.col("src_port").isin(*fold.ports) | F.col("dst_port").isin(*fold.ports)
    signed = F.lit(False)
    if fold.signature is not None:
        begin = F.decode(F.substring("payload", 1, 64), "ISO-8859-1")  # bytes as characters of the same numbers; no signature is longer
        signed = begin.rlike(rf"(?s)\A(?:{fold.signature.pattern.decode()})")
    keyed = packets if "flow" in packets.columns else canonical(packets)
    # A flow takes part as a whole if any of its packets is admitted by port; others by their own signature.
    admitted = keyed.filter(F.col("protocol").isin(*_TRANSPORT.get(kind, (6, 17))) & (F.length("payload") > 0)).filter(near | signed)
    return folded(admitted, fold, [*_END_FIELDS, *fold.fields], _COLUMNS)
