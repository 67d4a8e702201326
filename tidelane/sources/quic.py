"""QUIC long headers, Initial packets (RFC 9001) and their CRYPTO frames.

Key derivation is HKDF over hashlib; AES is done by a small table-free implementation, which is enough for the one block of header protection and
the few blocks of an Initial. Connection close and unknown frames end the scan.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa

from . import tls

_L, _S, _B = pa.int64(), pa.string(), pa.binary()
SCHEMA = pa.struct([("version", _L), ("packet_type", _L), ("packet_type_str", _S), ("version_str", _S), ("dcid", _B), ("scid", _B), ("token", _B), ("sni", _S), ("alpn", pa.list_(_S)), ("cipher_suites", pa.list_(_L)), ("crypto_fragments", pa.list_(pa.struct([("offset", _L), ("data", _B)])))])
#: Fixed values.
V1, V2 = 1, 0x6B3343CF
SALT = bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a")
TYPES = {0: "Initial", 1: "0-RTT", 2: "Handshake", 3: "Retry"}


def is_long_header(b: bytes) -> bool:
    return len(b) >= 7 and bool(b[0] & 0x80) and int.from_bytes(b[1:5], "big") in (V1, V2)


def varint(b: bytes, at: int) -> tuple[int, int]:
    size = 1 << (b[at] >> 6)
    return int.from_bytes(b[at : at + size], "big") & (1 << 8 * size - 2) - 1, at + size


def hkdf_extract(salt: bytes, key: bytes) -> bytes:
    return hmac.new(salt, key, hashlib.sha256).digest()


def hkdf_expand_label(secret: bytes, label: str, size: int) -> bytes:
    name = b"tls13 " + label.encode()
    info, out, block, k = size.to_bytes(2, "big") + bytes([len(name)]) + name + b"\0", b"", b"", 1
    while len(out) < size:
        block = hmac.new(secret, block + info + bytes([k]), hashlib.sha256).digest()
        out, k = out + block, k + 1
    return out[:size]


def initial_keys(dcid: bytes) -> tuple[bytes, bytes, bytes]:
    """(key, iv, header protection key) of the client's Initials."""
    secret = hkdf_expand_label(hkdf_extract(SALT, dcid), "client in", 32)
    return hkdf_expand_label(secret, "quic key", 16), hkdf_expand_label(secret, "quic iv", 12), hkdf_expand_label(secret, "quic hp", 16)


def _xtime(x: int) -> int:
    return (x << 1 ^ 0x1B) & 0xFF if x & 0x80 else x << 1


def _make_box() -> list[int]:
    """The AES substitution: inverse in GF(256), then an affine map."""
    exp, log, x = [0] * 255, [0] * 256, 1
    for k in range(255):
        exp[k], log[x] = x, k
        x ^= _xtime(x)
    box = []
    for v in range(256):
        y = exp[-log[v] % 255] if v else 0
        box.append(y ^ (y << 1 | y >> 7) & 255 ^ (y << 2 | y >> 6) & 255 ^ (y << 3 | y >> 5) & 255 ^ (y << 4 | y >> 4) & 255 ^ 0x63)
    return box


_BOX = _make_box()


def _round_keys(key: bytes) -> list[list[int]]:
    words, rcon = [list(key[k : k + 4]) for k in range(0, 16, 4)], 1
    for k in range(4, 44):
        w = list(words[-1])
        if k % 4 == 0:
            w = [_BOX[x] for x in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = _xtime(rcon)
        words.append([a ^ b for a, b in zip(words[k - 4], w, strict=True)])
    return [sum(words[k : k + 4], []) for k in range(0, 44, 4)]


def aes_block(keys: list[list[int]], block: bytes) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, 11):
        s = [_BOX[s[(c * 4 + row + 4 * row) % 16]] for c in range(4) for row in range(4)]
        if r < 10:
            mixed = []
            for c in range(0, 16, 4):
                col = s[c : c + 4]
                every = col[0] ^ col[1] ^ col[2] ^ col[3]
                mixed += [col[k] ^ every ^ _xtime(col[k] ^ col[(k + 1) % 4]) for k in range(4)]
            s = mixed
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def _gf_multiply(x: int, y: int) -> int:
    z = 0
    for k in range(127, -1, -1):
        if x >> k & 1:
            z ^= y
        y = y >> 1 ^ (0xE1 << 120 if y & 1 else 0)
    return z


def gcm_open(key: bytes, iv: bytes, sealed: bytes, head: bytes) -> bytes | None:
    """Plain text of an AES-128-GCM message, or None if its tag is wrong."""
    keys, body, tag = _round_keys(key), sealed[:-16], sealed[-16:]
    h, y = int.from_bytes(aes_block(keys, bytes(16)), "big"), 0
    for part in (head, body):
        for k in range(0, len(part), 16):
            y = _gf_multiply(y ^ int.from_bytes(part[k : k + 16].ljust(16, b"\0"), "big"), h)
    y = _gf_multiply(y ^ (len(head) * 8 << 64 | len(body) * 8), h)
    first = aes_block(keys, iv + b"\0\0\0\1")
    if (y ^ int.from_bytes(first, "big")).to_bytes(16, "big") != tag:
        return None
    stream = b"".join(aes_block(keys, iv + (2 + k).to_bytes(4, "big")) for k in range(-(-len(body) // 16)))
    return bytes(a ^ b for a, b in zip(body, stream, strict=False))


def crypto_frames(b: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(b):
        kind = b[at]
        at += 1
        if kind in (0, 1):
            continue
        if kind in (2, 3):
            _, at = varint(b, at)
            _, at = varint(b, at)
            ranges, at = varint(b, at)
            for _ in range(1 + 2 * ranges + (3 if kind == 3 else 0)):
                _, at = varint(b, at)
        elif kind == 6:
            offset, at = varint(b, at)
            size, at = varint(b, at)
            out.append((offset, b[at : at + size]))
            at += size
        else:
            break
    return out


def open_initial(b: bytes, dcid: bytes, pn_at: int, size: int) -> list[tuple[int, bytes]]:
    """CRYPTO fragments of a client's Initial; none if it can't be opened."""
    key, iv, hp = initial_keys(dcid)
    if pn_at + 20 > len(b):
        return []
    mask = aes_block(_round_keys(hp), b[pn_at + 4 : pn_at + 20])
    first = b[0] ^ mask[0] & 0x0F
    n = (first & 3) + 1
    number = bytes(x ^ m for x, m in zip(b[pn_at : pn_at + n], mask[1:], strict=False))
    head = bytes([first]) + b[1:pn_at] + number
    nonce = bytes(x ^ y for x, y in zip(iv, number.rjust(12, b"\0"), strict=True))
    plain = gcm_open(key, nonce, b[pn_at + n : pn_at + size], head)
    return crypto_frames(plain) if plain is not None else []


def client_hello(fragments: list[tuple[int, bytes]]) -> dict | None:
    """What the ClientHello says that CRYPTO fragments make up, in at most 64 KiB; None if they don't begin one."""
    buf, end = bytearray(1 << 16), 0
    for offset, data in sorted(fragments):
        if offset < len(buf):
            data = data[: len(buf) - offset]
            buf[offset : offset + len(data)] = data
            end = max(end, offset + len(data))
    if end < 4 or buf[0] != 1:
        return None
    out = tls.empty()
    tls.handshakes(bytes(buf[:end]), out)
    return out


def parsed(b: bytes):
    """As a layer. Only version 1 Initials are opened (by the client's keys)."""
    if not is_long_header(b):
        return None, None, 0, None
    version, kind = int.from_bytes(b[1:5], "big"), b[0] >> 4 & 3
    try:
        dcid, at = tls._vector(b, 5, 1)
        scid, at = tls._vector(b, at, 1)
        out = {"version": version, "packet_type": kind, "packet_type_str": TYPES[kind], "version_str": "v1" if version == V1 else "v2", "dcid": dcid, "scid": scid, "token": b"", "sni": None, "alpn": [], "cipher_suites": [], "crypto_fragments": []}
        if kind == 0 and at < len(b):
            size, at = varint(b, at)
            out["token"], at = b[at : at + size], at + size
            size, at = varint(b, at)
            fragments = open_initial(b, dcid, at, size) if version == V1 else []
            out["crypto_fragments"] = [{"offset": o, "data": d} for o, d in fragments]
            if fragments and (said := client_hello(fragments)):
                out |= {"sni": said["sni"], "alpn": said["alpn"], "cipher_suites": said["cipher_suites"]}
    except IndexError:
        return None, None, 0, None
    return out, None, len(b), None
