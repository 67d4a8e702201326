"""The packet filter language, compiled to columns.

    expr := term ('or' term)* ; term := factor ('and' factor)* ; factor := 'not' factor | '(' expr ')' | atom
    atom := tcp | udp | icmp | icmpv6 | ip | ipv6 | arp | tls | http | dns | quic | dhcp | dhcpv6 | vlan | gre | vxlan | mpls
          | [src|dst] host ADDRESS | [src|dst] port NUMBER | src ADDRESS | dst ADDRESS | ADDRESS

Text is taken in lower case. Every leaf is true or false, never null, so ``not`` of an absent layer is true. A filter splits into what headers alone
decide and what needs parsed layers (``split``), so that the first part can stand below the parser in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "icmpv6": 58}
LAYERS = ("ip", "ipv6", "arp", "tls", "http", "dns", "quic", "dhcp", "dhcpv6", "vlan", "gre", "vxlan", "mpls")
#: Layers that only a parser sees; the others are told by headers.
PARSED = ("tls", "http", "dns", "quic", "vlan", "mpls")
#: The layers that a whole flow can be asked for.
FLOW_LAYERS = ("tls", "http", "dns", "quic")
DEFAULT_FILTER = "not arp and not icmp and not icmpv6 and not dhcp and not dhcpv6"
_TOKEN = re.compile(r"\s*(\(|\)|[0-9a-z_.:]+)")
_ADDRESS = re.compile(r"\d+\.\d+\.\d+\.\d+|[0-9a-f]*:[0-9a-f:.]*")


@dataclass(frozen=True)
class Node:
    """kind: and, or, not, proto, layer, host, port; value and side ('', 'src', 'dst') of a leaf; parts of the rest."""

    kind: str
    value: str | int | None = None
    side: str = ""
    parts: tuple[Node, ...] = ()


def parse(text: str) -> Node | None:
    """The tree of a filter; None for an empty one. ValueError for what isn't in the language."""
    text = text.lower().strip()
    tokens, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            if text[at:].strip():
                raise ValueError(f"unexpected {text[at:]!r} in filter")
            break
        tokens.append(found[1])
        at = found.end()
    if not tokens:
        return None
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the filter ends too early")
        place += 1
        return tokens[place - 1]

    def chain(word: str, inner) -> Node:
        parts = [inner()]
        while peek() == word:
            take()
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Node(word, parts=tuple(parts))

    def number() -> int:
        word = take()
        if not word.isdigit():
            raise ValueError(f"port needs a number, not {word!r}")
        return int(word)

    def address() -> str:
        word = take()
        if not _ADDRESS.fullmatch(word):
            raise ValueError(f"{word!r} is no address")
        return word

    def factor() -> Node:
        word = take()
        if word == "not":
            return Node("not", parts=(factor(),))
        if word == "(":
            inner = expr()
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            take()
            return inner
        side = word if word in ("src", "dst") else ""
        if side:
            word = take() if peek() in ("host", "port") else "host"
        if word == "host":
            return Node("host", address(), side)
        if word == "port":
            return Node("port", number(), side)
        if word in PROTOCOLS:
            return Node("proto", PROTOCOLS[word])
        if word in LAYERS:
            return Node("layer", word)
        if _ADDRESS.fullmatch(word):
            return Node("host", word)
        raise ValueError(f"unknown {word!r} in filter")

    def expr() -> Node:
        return chain("or", lambda: chain("and", factor))

    tree = expr()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in filter")
    return tree


def _ends(node: Node, src: Column, dst: Column) -> Column:
    source, target = src == F.lit(node.value), dst == F.lit(node.value)
    return {"src": source, "dst": target, "": source | target}[node.side]


def compiled(node: Node | None, columns: list[str], of: Callable[[str], Column] = F.col) -> Column:
    """The condition on packet rows. A layer is there if its column isn't null; without such a column, if protocol and ports say so. ``of`` gives the
    columns by name."""
    if node is None:
        return F.lit(True)
    if node.kind == "not":
        return ~compiled(node.parts[0], columns, of)
    if node.kind in ("and", "or"):
        out = compiled(node.parts[0], columns, of)
        for part in node.parts[1:]:
            right = compiled(part, columns, of)
            out = (out & right) if node.kind == "and" else (out | right)
        return out
    if node.kind == "proto":
        leaf = of("protocol") == node.value
    elif node.kind == "host":
        leaf = _ends(node, of("src_ip"), of("dst_ip"))
    elif node.kind == "port":
        leaf = of("protocol").isin(6, 17) & _ends(node, of("src_port"), of("dst_port"))
    else:
        leaf = _layer(str(node.value), columns, of)
    return F.coalesce(leaf, F.lit(False))


def _layer(name: str, columns: list[str], of: Callable[[str], Column]) -> Column:
    column = {"ipv6": "ip6"}.get(name, name)
    if column in columns:
        return of(column).isNotNull()
    udp, tcp = of("protocol") == 17, of("protocol") == 6

    def on(*ports: int) -> Column:
        return of("src_port").isin(*ports) | of("dst_port").isin(*ports)

    rules = {
        "ip": of("src_ip").isNotNull() & ~of("src_ip").contains(":"), "ipv6": of("src_ip").contains(":"), "dns": udp & on(53), "dhcp": udp & on(67, 68), "dhcpv6": udp & on(546, 547),
        "vxlan": udp & (of("dst_port") == 4789), "gre": of("protocol") == 47, "tls": tcp & on(443),
    }
    return rules.get(name, F.lit(False))


def packet_filter(text: str | None, columns: list[str], default: str | None = DEFAULT_FILTER) -> Column:
    """The condition of a filter text, together with the default one (None: without). An empty text keeps everything."""
    out = compiled(parse(default), columns) if default else F.lit(True)
    return out & compiled(parse(text), columns) if text and text.strip() else out


def split(node: Node | None) -> tuple[Node | None, Node | None]:
    """(headers alone, needs parsing): conjuncts by what they need. Both together are the filter."""

    def parsed(n: Node) -> bool:
        return n.kind == "layer" and n.value in PARSED or any(parsed(p) for p in n.parts)

    def joined(parts: list[Node]) -> Node | None:
        return None if not parts else parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    if node is None:
        return None, None
    parts = list(node.parts) if node.kind == "and" else [node]
    return joined([p for p in parts if not parsed(p)]), joined([p for p in parts if parsed(p)])


def flow_filter(node: Node | None, columns: list[str]) -> Column:
    """The condition on whole flows, which holds where the filter asks for layers at all: then leaves other than layers are true, and of layers only
    those in FLOW_LAYERS can be. A ``not`` counts on a single leaf; of anything compound it is passed over."""

    def asks(n: Node) -> bool:
        return n.kind == "layer" and n.value not in ("ip", "ipv6", "arp") or any(asks(p) for p in n.parts)

    def holds(n: Node, turned: bool = False) -> Column:
        if n.kind == "not":
            return holds(n.parts[0], not turned)
        if n.kind in ("and", "or"):
            out = holds(n.parts[0])
            for part in n.parts[1:]:
                out = (out & holds(part)) if n.kind == "and" else (out | holds(part))
            return out
        if not asks(n):
            return F.lit(True)
        there = F.coalesce(F.col(str(n.value)).isNotNull(), F.lit(False)) if n.value in FLOW_LAYERS and n.value in columns else F.lit(False)
        return ~there if turned else there

    return F.lit(True) if node is None or not asks(node) else holds(node)
