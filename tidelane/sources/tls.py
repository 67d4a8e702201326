"""TLS records, handshake messages and X.509 certificates from bytes."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa

_L, _S, _B = pa.int64(), pa.string(), pa.binary()
_LIST = pa.list_(_L)
SCHEMA = pa.struct(
    [
        ("version", _L), ("content_type", _L), ("handshake_type", _L), ("handshake_types", _LIST), ("record_length", _L), ("record_types", _LIST), ("sni", _S), ("cipher_suites", _LIST), ("cipher_suite", _L), ("alpn", pa.list_(_S)), ("signature_algorithms", _LIST), ("supported_groups", _LIST),
        ("point_formats", _LIST), ("supported_versions", _LIST), ("key_shares", _LIST), ("extensions", _LIST), ("server_extensions", _LIST), ("hello_version", _L), ("session_id", _B), ("negotiated_version", _L), ("certificates", pa.list_(_B)), ("alert_level", _L), ("alert_description", _L),
    ]
)
FIELDS = [f.name for f in SCHEMA]
#: The longest record body that counts.
LONGEST = 16640


def _u16s(b: bytes) -> list[int]:
    return [x for (x,) in struct.iter_unpack("!H", b[: len(b) & ~1])]


def _vector(b: bytes, at: int, size: int) -> tuple[bytes, int]:
    """A length-prefixed part, cut off where the bytes end."""
    n = int.from_bytes(b[at : at + size], "big")
    return b[at + size : at + size + n], at + size + n


def extensions(b: bytes, hello: dict, server: bool) -> None:
    """Fills in what the extensions of a hello say."""
    at = 0
    while at + 4 <= len(b):
        kind = int.from_bytes(b[at : at + 2], "big")
        body, at = _vector(b, at + 2, 2)
        hello["server_extensions" if server else "extensions"].append(kind)
        if kind == 0 and not server and len(body) > 5:
            hello["sni"] = _vector(body, 3, 2)[0].decode("latin-1")
        elif kind == 10:
            hello["supported_groups"] += _u16s(_vector(body, 0, 2)[0])
        elif kind == 11:
            hello["point_formats"] += list(_vector(body, 0, 1)[0])
        elif kind == 13:
            hello["signature_algorithms"] += _u16s(_vector(body, 0, 2)[0])
        elif kind == 16:
            names, k = _vector(body, 0, 2)[0], 0
            while k < len(names):
                name, k = _vector(names, k, 1)
                hello["alpn"].append(name.decode("latin-1"))
        elif kind == 43:
            if server:
                hello["negotiated_version"] = int.from_bytes(body[:2], "big")
            else:
                hello["supported_versions"] += _u16s(_vector(body, 0, 1)[0])
        elif kind == 51:
            if server:
                hello["key_shares"].append(int.from_bytes(body[:2], "big"))
            else:
                shares, k = _vector(body, 0, 2)[0], 0
                while k + 4 <= len(shares):
                    hello["key_shares"].append(int.from_bytes(shares[k : k + 2], "big"))
                    k = _vector(shares, k + 2, 2)[1]


def hello(body: bytes, out: dict, server: bool) -> None:
    if len(body) < 35:
        return
    out["hello_version"] = int.from_bytes(body[:2], "big")
    session, at = _vector(body, 34, 1)
    out["session_id"] = session
    if server:
        out["cipher_suite"] = int.from_bytes(body[at : at + 2], "big")
        out["negotiated_version"] = out["hello_version"]
        at += 3
    else:
        suites, at = _vector(body, at, 2)
        out["cipher_suites"] += _u16s(suites)
        at = _vector(body, at, 1)[1]
    extensions(_vector(body, at, 2)[0], out, server)


def empty() -> dict:
    return {f.name: [] if pa.types.is_list(f.type) else None for f in SCHEMA}


def handshakes(b: bytes, out: dict) -> None:
    at = 0
    while at + 4 <= len(b):
        kind, size = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        body = b[at + 4 : at + 4 + size]
        out["handshake_types"].append(kind)
        out["handshake_type"] = kind
        if kind in (1, 2):
            hello(body, out, kind == 2)
        elif kind == 11:
            chain, k = _vector(body, 0, 3)[0], 0
            while k + 3 <= len(chain):
                cert, k = _vector(chain, k, 3)
                if cert:
                    out["certificates"].append(cert)
        at += 4 + size


def records(b: bytes) -> tuple[dict | None, int]:
    """(what the records of a stream say, bytes used); None if it doesn't begin with a record. After a change of cipher a handshake record counts only if
    its length field fits."""
    return records_after(b, False)[:2]


def records_after(b: bytes, hidden: bool) -> tuple[dict | None, int, bool]:
    """As ``records``, for a stream that goes on; ``hidden``: whether there was a change of cipher before, and, returned, by now."""
    out, at = empty(), 0
    while at + 5 <= len(b):
        kind, version, size = b[at], int.from_bytes(b[at + 1 : at + 3], "big"), int.from_bytes(b[at + 3 : at + 5], "big")
        if not 20 <= kind <= 23 or version >> 8 != 3 or size > LONGEST or at + 5 + size > len(b):
            break
        body = b[at + 5 : at + 5 + size]
        if out["content_type"] is None:
            out["version"], out["content_type"], out["record_length"] = version, kind, size
        out["record_types"].append(kind)
        if kind == 20:
            hidden = True
        elif kind == 21 and size == 2:
            out["alert_level"], out["alert_description"] = body
        elif kind == 22 and not (hidden and int.from_bytes(body[1:4], "big") + 4 > size):
            handshakes(body, out)
        at += 5 + size
    return (out if out["content_type"] is not None else None), at, hidden


def parsed(b: bytes):
    """As a layer: the records that are whole in a packet, or the first one's head."""
    out, used = records(b)
    if out is None:
        if len(b) < 5 or not 20 <= b[0] <= 23 or b[1] != 3:
            return None, None, 0, None
        out = empty() | {"version": int.from_bytes(b[1:3], "big"), "content_type": b[0], "record_length": int.from_bytes(b[3:5], "big"), "record_types": [b[0]]}
        if b[0] == 22:
            handshakes(b[5:], out)
        used = len(b)
    return out, None, len(b), None


def is_client_hello(b: bytes) -> bool:
    return len(b) >= 6 and b[0] == 22 and b[1] == 3 and b[5] == 1


def is_server_hello(b: bytes) -> bool:
    return len(b) >= 6 and b[0] == 22 and b[1] == 3 and b[5] == 2


def merge_into(out: dict | None, part: dict) -> dict:
    """What a flow has said so far, with what comes next: the first value that isn't empty; types and certificates one after another (in place)."""
    if out is None:
        return {k: list(v) if isinstance(v, list) else v for k, v in part.items()}
    for k, v in part.items():
        if k in ("handshake_types", "certificates", "record_types"):
            out[k] += v or []
        elif out[k] is None or isinstance(out[k], list) and not out[k]:
            out[k] = v
    return out


def merged(parts: list[dict]) -> dict | None:
    """A flow's TLS data from its packets' in order."""
    out = None
    for part in parts:
        out = merge_into(out, part)
    return out


# ---- X.509 ----

#: Object identifiers.
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.8": "ST", "2.5.4.7": "L", "2.5.4.10": "O"}
ALGORITHMS = {
    "1.2.840.113549.1.1.1": "rsaEncryption", "1.2.840.113549.1.1.5": "sha1WithRSAEncryption", "1.2.840.113549.1.1.11": "sha256WithRSAEncryption", "1.2.840.113549.1.1.12": "sha384WithRSAEncryption", "1.2.840.113549.1.1.13": "sha512WithRSAEncryption",
    "1.2.840.10045.2.1": "id-ecPublicKey", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.3.101.112": "ED25519",
}


def der(b: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(tag, first byte of the content, end) of the elements between two places."""
    end, out = len(b) if end is None else end, []
    while at + 2 <= end:
        tag, size = b[at], b[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(b[at : at + n], "big"), at + n
        if at + size > end:
            raise ValueError("an element is longer than what holds it")
        out.append((tag, at, at + size))
        at += size
    return out


def oid(b: bytes) -> str:
    parts, x = [], 0
    for byte in b:
        x = x << 7 | byte & 0x7F
        if not byte & 0x80:
            parts.append(x)
            x = 0
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def certificate(b: bytes) -> dict:
    """Subject and issuer names, serial, validity, algorithms, key bits (RSA), alternative names, whether an authority, version and SHA-1 of a certificate.
    ValueError for what isn't one."""
    (_, lo, hi), *_ = der(b)
    (_, tlo, thi), (_, slo, shi), *_ = der(b, lo, hi)
    fields = der(b, tlo, thi)
    version = 1
    if fields[0][0] == 0xA0:
        (_, vlo, vhi), *_ = der(b, *fields[0][1:])
        version, fields = int.from_bytes(b[vlo:vhi], "big") + 1, fields[1:]
    serial, _, issuer, validity, subject, key, *rest = fields

    def algorithm(at: int, end: int) -> str:
        (_, alo, ahi), *_ = der(b, at, end)
        name = oid(b[alo:ahi])
        return ALGORITHMS.get(name, name)

    def names(at: int, end: int) -> dict:
        out = {}
        for _, s, e in der(b, at, end):
            for _, s2, e2 in der(b, s, e):
                (_, o, oe), (_, v, ve), *_ = der(b, s2, e2)
                if short := NAMES.get(oid(b[o:oe])):
                    out[short] = b[v:ve].decode("utf-8", "replace")
        return out

    (_, klo, khi), (_, plo, phi), *_ = der(b, *key[1:])
    key_algorithm, bits = algorithm(klo, khi), None
    if key_algorithm == "rsaEncryption":
        (_, rlo, rhi), *_ = der(b, plo + 1, phi)
        (_, mlo, mhi), *_ = der(b, rlo, rhi)
        bits = (mhi - mlo - (b[mlo] == 0)) * 8
    alternative, authority = [], False
    for tag, at, end in rest:
        if tag != 0xA3:
            continue
        for _, s, e in der(b, *der(b, at, end)[0][1:]):
            parts = der(b, s, e)
            name, value = oid(b[parts[0][1] : parts[0][2]]), b[parts[-1][1] : parts[-1][2]]
            if name == "2.5.29.17":
                alternative = [value[x:y].decode("latin-1") for tag2, x, y in der(value, *der(value)[0][1:]) if tag2 == 0x82]
            elif name == "2.5.29.19":
                authority = any(tag2 == 1 and value[x] for tag2, x, _ in der(value, *der(value)[0][1:]))
    before, after = (b[s:e].decode("ascii") for _, s, e in der(b, *validity[1:]))
    return {
        "subject": names(*subject[1:]), "issuer": names(*issuer[1:]), "serial": b[serial[1] : serial[2]][:20].hex(), "not_before": before, "not_after": after, "signature_algorithm": algorithm(slo, shi), "key_algorithm": key_algorithm, "key_bits": bits,
        "san": alternative, "is_ca": authority, "version": version, "sha1": hashlib.sha1(b).hexdigest(),
    }
