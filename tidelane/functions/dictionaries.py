"""Fixed values of protocols: names by number, ports, methods, dictionaries of hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK_TYPES = {0: "loopback", 1: "ethernet", 101: "raw_ip", 108: "loopback", 113: "linux_sll", 239: "nflog"}
DNS_OPCODES = {0: "QUERY", 1: "IQUERY", 2: "STATUS", 4: "NOTIFY", 5: "UPDATE"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 255: "ANY"}
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_RECORDS = {20: "change_cipher_spec", 21: "alert", 22: "handshake", 23: "application_data", 24: "heartbeat"}
TLS_GROUPS = {23: "secp256r1", 24: "secp384r1", 25: "secp521r1", 29: "x25519", 30: "x448", 256: "ffdhe2048", 257: "ffdhe3072"}
TLS_EXTENSIONS = {0: "server_name", 1: "max_fragment_length", 5: "status_request", 10: "supported_groups", 11: "ec_point_formats", 13: "signature_algorithms", 16: "alpn", 18: "signed_certificate_timestamp", 21: "padding", 22: "encrypt_then_mac", 23: "extended_master_secret", 35: "session_ticket", 41: "pre_shared_key", 42: "early_data", 43: "supported_versions", 44: "cookie", 45: "psk_key_exchange_modes", 50: "signature_algorithms_cert", 51: "key_share", 65281: "renegotiation_info"}
TLS_CIPHERS = {
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA", 0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA", 0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA", 0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
}
DHCP_MESSAGES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
QUIC_VERSIONS = {1: "v1", 0x6B3343CF: "v2"}
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE")
SIP_METHODS = ("INVITE", "ACK", "BYE", "CANCEL", "REGISTER", "OPTIONS", "PRACK", "SUBSCRIBE", "NOTIFY", "PUBLISH", "INFO", "REFER", "MESSAGE", "UPDATE")
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6", 132: "SCTP"}

PORTS = {
    "http": (80, 8080, 8000, 8888, 8008), "ssh": (22,), "mqtt": (1883, 8883, 1884), "sip": (5060, 5061), "quic": (443, 80, 8443), "rdp": (3389,), "vnc": tuple(range(5900, 6000)),
    "dns": (53, 5353, 5355), "smtp": (25, 465, 587, 2525), "ftp": (21, 990), "dhcp": (67, 68), "tls": (443, 465, 993, 995, 5061),
}

HIGH, MEDIUM, LOW = 3, 2, 1
#: Hosts of messaging services: what the host name has in it, the service, the confidence. The first that fits counts.
MESSAGING_HOSTS = (
    ("telegram.org", "telegram", HIGH), ("t.me", "telegram", HIGH), ("telegra.ph", "telegram", MEDIUM), ("tdesktop.com", "telegram", MEDIUM),
    ("whatsapp.net", "whatsapp", HIGH), ("whatsapp.com", "whatsapp", HIGH), ("wa.me", "whatsapp", MEDIUM),
    ("signal.org", "signal", HIGH), ("whispersystems.org", "signal", HIGH),
    ("edge-mqtt.facebook.com", "messenger", HIGH), ("mqtt-mini.facebook.com", "messenger", HIGH), ("messenger.com", "messenger", MEDIUM),
    ("weixin.qq.com", "wechat", HIGH), ("wx.qq.com", "wechat", HIGH),
    ("line.me", "line", HIGH), ("line-apps.com", "line", HIGH),
    ("viber.com", "viber", HIGH),
    ("skype.com", "skype", HIGH), ("teams.microsoft.com", "skype", HIGH), ("teams.live.com", "skype", MEDIUM),
    ("discord.com", "discord", HIGH), ("discord.gg", "discord", MEDIUM), ("discordapp.com", "discord", HIGH),
    ("slack.com", "slack", HIGH), ("slack-msgs.com", "slack", MEDIUM),
    ("wire.com", "wire", HIGH),
)
#: First and last addresses of a messaging service's data centres.
DATA_CENTRES = (("91.108.0.0", "91.108.255.255"), ("91.105.192.0", "91.105.255.255"), ("149.154.160.0", "149.154.175.255"), ("185.76.151.0", "185.76.151.255"), ("95.161.76.0", "95.161.77.255"))


def named(x: Column, names: dict[int, str], other: Column | None = None) -> Column:
    """The name of a number; otherwise ``other``, or the number as text."""
    pairs = [F.lit(v) for item in names.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x.cast("int")), x.cast("string") if other is None else other)


def messaging_host(host: Column) -> tuple[Column, Column]:
    """(service, confidence) by the dictionary; null and 0 if none fits."""
    low = F.lower(host)
    fits = [(low.contains(pattern), name, conf) for pattern, name, conf in MESSAGING_HOSTS]
    return F.coalesce(*[F.when(f, name) for f, name, _ in fits]), F.coalesce(*[F.when(f, F.lit(c)) for f, _, c in fits], F.lit(0))


def in_data_centre(ip: Column) -> Column:
    from .text import ip_number

    number, found = ip_number(ip), F.lit(False)
    for lo, hi in DATA_CENTRES:
        a, b = (sum(int(x) << 8 * (3 - k) for k, x in enumerate(end.split("."))) for end in (lo, hi))
        found = found | number.between(a, b)
    return F.coalesce(found, F.lit(False))
