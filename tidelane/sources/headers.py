"""Addresses, ports and protocol of raw frames as columns, so that a filter drops packets before Python parses any.

Only plain frames are told: Ethernet (with up to one VLAN tag) or raw IP, carrying IPv4, or IPv6 without extension headers, with TCP, UDP or ICMP that no
tunnel can be in. Of all others the columns are null and ``plain`` is false: these are left to the parser.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _number(data: Column, at: Column | int, size: int) -> Column:
    """The big-endian number at a place (from 0) of the frame."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("bigint")


def _in_hex(node: filters.Node) -> filters.Node:
    """The condition with IPv6 addresses as ``with_headers`` writes them. One that isn't in its usual form equals none."""
    if node.kind == "host" and ":" in str(node.value):
        try:
            address = ipaddress.ip_address(str(node.value))
        except ValueError:
            return node
        return replace(node, value=":" + address.packed.hex()) if str(address) == node.value else node
    return replace(node, parts=tuple(map(_in_hex, node.parts)))


def _network(data: Column, link: Column) -> dict[str, Column]:
    """Where the network header begins, and its ethertype."""
    raw, nibble = link.isin(101, 12, 14), F.shiftright(_number(data, 0, 1), 4)
    outer = _number(data, 12, 2)
    tagged = (link == 1) & outer.isin(0x8100, 0x88A8)
    by_version = F.when(nibble == 4, 0x0800).when(nibble == 6, 0x86DD)
    return {"net": F.when(raw, 0).when(tagged, 18).otherwise(14), "kind": F.when(raw, by_version).when(tagged, _number(data, 16, 2)).when(link == 1, outer), "data": data, "size": F.length(data)}


def _internet(n: Column) -> dict[str, Column]:
    """Addresses, protocol, where the transport header begins, and where the packet ends."""
    data, net = n["data"], n["net"]
    version = F.shiftright(_number(data, net, 1), 4)
    v4 = (n["kind"] == 0x0800) & (n["size"] >= net + 20) & (version == 4)
    v6 = (n["kind"] == 0x86DD) & (n["size"] >= net + 40) & (version == 6)

    def address(at: int, wide: int) -> Column:
        dotted = F.concat_ws(".", *[_number(data, net + (at + k), 1).cast("string") for k in range(4)])
        return F.when(v4, dotted).when(v6, F.concat(F.lit(":"), F.lower(F.hex(F.substring(data, net + (wide + 1), F.lit(16))))))

    return {
        "data": data, "size": n["size"], "ip": F.coalesce(v4 | v6, F.lit(False)), "src_ip": address(12, 8), "dst_ip": address(16, 24), "protocol": F.when(v4, _number(data, net + 9, 1)).when(v6, _number(data, net + 6, 1)),
        "whole": F.when(v4, _number(data, net + 6, 2).bitwiseAND(0x1FFF) == 0).otherwise(F.lit(True)), "at": net + F.when(v4, F.greatest(_number(data, net, 1).bitwiseAND(15) * 4, F.lit(20))).otherwise(40),
        "end": net + F.when(v4, _number(data, net + 2, 2)).when(v6, _number(data, net + 4, 2) + 40), "arp": F.when((n["kind"] == 0x0806) & (n["size"] >= net + 28), 1),
    }


def _transport(i: Column) -> dict[str, Column]:
    """The columns, and whether they tell all that a filter can ask."""
    data, at, protocol = i["data"], i["at"], i["protocol"]
    room = F.least(i["size"], i["end"]) - at
    ported = i["ip"] & i["whole"] & ((protocol == 6) & (room >= 20) | (protocol == 17) & (room >= 8))
    other = i["ip"] & i["whole"] & protocol.isin(1, 58) & (room >= 4)
    ports = {name: F.coalesce(F.when(ported, _number(data, at + k, 2)), F.lit(0)) for name, k in (("src_port", 0), ("dst_port", 2))}
    tunnel = (protocol == 17) & ((_number(data, at, 2) == 4789) | (_number(data, at + 2, 2) == 4789))
    plain = F.coalesce(ported & ~tunnel | other, F.lit(False)) | i["arp"].isNotNull()
    return {"plain": plain, "src_ip": i["src_ip"], "dst_ip": i["dst_ip"], "protocol": protocol, "arp": i["arp"]} | ports


def told(then: Callable[[Column], Column], data: str = "data", link: str = "link_type") -> Column:
    """``then`` of a struct with plain, src_ip, dst_ip (IPv6: a colon and 32 hexadecimal digits), src_port, dst_port, protocol and arp of a raw frame."""
    return _let(_network(F.col(data), F.col(link)), lambda n: _let(_internet(n), lambda i: _let(_transport(i), then)))


def plainly_kept(raw: DataFrame, *conditions: filters.Node | None) -> DataFrame:
    """Raw packets without the plain ones that those terms of the conditions drop which headers decide; what is left is to be filtered again once it is
    parsed."""
    nodes = [_in_hex(head) for c in conditions if (head := filters.split(c)[0]) is not None]
    if not nodes:
        return raw
    names = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "arp"]

    def keep(t: Column) -> Column:
        out = F.lit(True)
        for node in nodes:
            out = out & filters.compiled(node, names, lambda c: t[c])
        return ~t["plain"] | out

    return raw.filter(told(keep))
