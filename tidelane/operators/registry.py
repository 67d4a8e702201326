"""Feature kinds by name, and users' own features and protocols.

``KINDS`` maps each kind to a function from parsed packets to rows; ``extract`` and ``extract_all`` run them on captures. Users add column features (built
from aggregates, in dependency order) and incremental features (a class with ``initialize``, ``update`` and ``get_value``, folded in order).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import captures, layers
from . import classifiers, features, flows, l7, line_protocols, sinks
from .folds import folded


class FeatureType(Enum):
    SEQUENCE = "sequence"
    STATISTICAL = "statistical"
    CATEGORICAL = "categorical"
    BINARY = "binary"
    CUSTOM = "custom"
    INCREMENTAL = "incremental"


@dataclass(frozen=True)
class FeatureSpec:
    """A kind of extraction: its name, what else it is called, its output's format, and packets -> rows."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    aliases: tuple[str, ...] = ()
    output: str = "jsonl"
    layers: tuple[str, ...] = ()
    n_limit: str = "none"  # none, rechunk or truncate


def _ip4(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":"))


def _sequences(packets: DataFrame) -> DataFrame:
    kept = _ip4(packets)
    return flows.plain_sequences(kept).join(flows.bursts(flows.oriented(kept, "address")), "flow")


def _payloads(packets: DataFrame) -> DataFrame:
    df = flows.oriented(_ip4(packets), "address")
    rel = F.greatest(F.col("ts_us") - F.first("ts_us").over(flows.so_far()), F.lit(0))
    row = F.struct("pkt_no", F.col("dir").alias("direction"), rel.alias("ts_rel_us"), "ip_len", F.col("app_len").alias("pay_len"), F.least("app_len", F.lit(256)).alias("cap_bytes"), F.lower(F.hex(F.substring("payload", 1, 256))).alias("payload_hex"))
    return df.select("flow", row.alias("r")).groupBy("flow").agg(F.array_sort(F.collect_list("r")).alias("packets"))


def _flow_records(packets: DataFrame) -> DataFrame:
    df = flows.oriented(_ip4(packets))
    parts = [part.select("flow", F.struct(*[c for c in part.columns if c != "flow"]).alias(name)) for name, part in (("netflow_v5", features.netflow_v5(df)), ("ipfix", features.ipfix(df)), ("argus", features.argus(df)))]
    return parts[0].join(parts[1], "flow").join(parts[2], "flow")


def _lines(kind: str) -> Callable[[DataFrame], DataFrame]:
    ports = {"smtp": [25, 465, 587, 2525], "ftp": [21, 990]}[kind]
    fold = {"smtp": line_protocols.smtp, "ftp": line_protocols.ftp}[kind]

    def run(packets: DataFrame) -> DataFrame:
        mine = packets.filter((F.col("protocol") == 6) & (F.length("payload") > 0) & (F.col("src_port").isin(ports) | F.col("dst_port").isin(ports)))
        keyed = flows.canonical(mine).withColumn("client_to_server", F.col("dst_port").isin(ports))
        return fold(line_protocols.lines_of(keyed))

    return run


def _l7(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda packets: l7.metadata(_ip4(packets), kind)


KINDS: dict[str, FeatureSpec] = {
    s.name: s
    for s in (
        FeatureSpec("cic", lambda p: features.cic(flows.oriented(_ip4(p), "exact")), output="csv", n_limit="rechunk"),
        FeatureSpec("cicext", lambda p: features.cic_extended(flows.oriented(_ip4(p), "exact")), ("cic_ext",), "csv", n_limit="rechunk"),
        FeatureSpec("seq", _sequences, ("sequence",), n_limit="rechunk"),
        FeatureSpec("payload", _payloads, n_limit="rechunk"),
        *(FeatureSpec(kind, _l7(kind), ("rfb",) if kind == "vnc" else ()) for kind in l7.KINDS),
        *(FeatureSpec(kind, _lines(kind)) for kind in ("smtp", "ftp")),
        FeatureSpec("vpn", classifiers.vpn_flows, output="log"),
        FeatureSpec("im", classifiers.im_flows, output="log"),
        FeatureSpec("flow", _flow_records, output="json", n_limit="truncate"),
    )
}
SPLIT = "pcap_split"
ALIASES = {alias: spec.name for spec in KINDS.values() for alias in (spec.name, *spec.aliases)} | {SPLIT: SPLIT, "split": SPLIT}
#: What a batch has if nothing else is asked for.
DEFAULT_BATCH = ("cic", "cicext", "seq", "payload", "tls", "dns")


def list_features() -> list[FeatureSpec]:
    return list(KINDS.values())


def resolve_feature(name: str) -> str:
    if name.lower() not in ALIASES:
        raise ValueError(f"unknown feature {name!r}; known are {', '.join(sorted(ALIASES))}")
    return ALIASES[name.lower()]


@dataclass
class ExtractStats:
    """What a run did; counts are taken when the result is written."""

    feature: str
    flows: int = 0
    packets: int = 0
    elapsed_sec: float = 0.0
    output: str | None = None
    message: str = "ok"


def features_of(packets: DataFrame, name: str, n_packets: int = 0) -> DataFrame:
    """Rows of one kind from parsed packets; ``n_packets`` limits a flow as the kind does."""
    spec = KINDS[resolve_feature(name)]
    if n_packets and spec.n_limit != "none":
        packets = flows.limited(packets, n_packets, spec.n_limit == "rechunk")
    return spec.run(packets)


def _write(rows: DataFrame, kind: str, out: str, document: bool) -> int:
    """Writes rows as their kind is written; how many there were is counted on the way."""
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == SPLIT:
        rows.write.mode("overwrite").parquet(out)
    elif KINDS[kind].output == "csv":
        sinks.as_text(rows).write.mode("overwrite").option("header", True).csv(out)
    elif KINDS[kind].output == "log":
        sinks.log_lines(rows, kind).write.mode("overwrite").text(out)
    elif kind == "flow" and document:
        sinks.as_document(rows, **_totals()).coalesce(1).write.mode("overwrite").text(out)
    else:
        rows.write.mode("overwrite").json(out)
        if kind == "flow":
            rows.sparkSession.read.schema(rows.schema).json(out).agg(*[c.alias(k) for k, c in _totals().items()]).write.mode("overwrite").json(f"{out}.meta")
    return seen.get["n"]


def _totals() -> dict[str, Column]:
    return {"total_flows": F.count(F.lit(1)), "total_packets": F.sum("netflow_v5.d_pkts"), "total_bytes": F.sum("netflow_v5.d_octets")}


def _run(raw: DataFrame, parsed: DataFrame, packets: int, kind: str, out: str, n_packets: int, document: bool) -> ExtractStats:
    began = time.time()
    rows = sinks.split_captures(raw, parsed) if kind == SPLIT else features_of(parsed, kind, n_packets)
    return ExtractStats(kind, _write(rows, kind, out, document), packets, time.time() - began, out)


def extract(spark: SparkSession, capture: str, name: str, output: str | None = None, n_packets: int = 0, pattern: str | None = None, document: bool = False) -> ExtractStats:
    """Runs one kind on a capture or a folder of them and writes it; for ``pcap_split`` a table of captures. ``flow`` is written as lines, with totals beside
    them in ``<output>.meta``; with ``document``, as one JSON document, which has all flows in one place."""
    kind = resolve_feature(name)
    stats = extract_all(spark, capture, (kind,), n_packets=n_packets, pattern=pattern, outputs={kind: output} if output else None, document=document, strict=True)
    return stats[kind]


def extract_all(
    spark: SparkSession, capture: str, names: tuple[str, ...] = DEFAULT_BATCH, folder: str | None = None, n_packets: int = 0, pattern: str | None = None, outputs: dict[str, str] | None = None, document: bool = False, strict: bool = False
) -> dict[str, ExtractStats]:
    """Runs several kinds on packets that are parsed once; a kind that fails is reported in its message and doesn't stop the rest (``strict``: it does)."""
    kinds = [resolve_feature(n) for n in names]
    raw = captures.raw_packets(spark, capture, pattern)
    parsed = layers.packets(raw, []).persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        packets = parsed.count()
        for kind in kinds:
            to = (outputs or {}).get(kind) or sinks.default_output(capture, kind, folder)
            try:
                out[kind] = _run(raw, parsed, packets, kind, to, n_packets, document)
            except Exception as e:  # noqa: BLE001  the message is the result
                if strict:
                    raise
                out[kind] = ExtractStats(kind, message=f"{type(e).__name__}: {e}"[:500])
    finally:
        parsed.unpersist()
    return out


# ---- users' own features ----


@dataclass
class Feature:
    """A column over ``groupBy('flow')``: ``build(columns so far)`` gives an aggregate, or for one with dependencies an expression over their columns."""

    name: str
    build: Callable[[], Column]
    type: FeatureType = FeatureType.CUSTOM
    dependencies: tuple[str, ...] = ()


@dataclass
class Registry:
    """Features by name. A name that is taken raises ValueError; a cycle of dependencies too."""

    features: dict[str, Feature] = field(default_factory=dict)

    def register(self, name: str, type: FeatureType = FeatureType.CUSTOM, dependencies: tuple[str, ...] = ()):
        def add(build: Callable[[], Column]):
            if name in self.features:
                raise ValueError(f"feature {name!r} is registered already")
            self.features[name] = Feature(name, build, type, tuple(dependencies))
            return build

        return add

    def unregister(self, name: str) -> None:
        self.features.pop(name, None)

    def clear(self) -> None:
        self.features.clear()

    def names(self, type: FeatureType | None = None) -> list[str]:
        return [f.name for f in self.features.values() if type is None or f.type is type]

    def order(self, names: list[str]) -> list[str]:
        done, out = set(), []

        def visit(name: str, above: tuple[str, ...] = ()) -> None:
            if name in above:
                raise ValueError(f"features depend on each other: {' -> '.join((*above, name))}")
            if name not in done:
                for other in self.features[name].dependencies:
                    visit(other, (*above, name))
                done.add(name)
                out.append(name)

        for name in names:
            visit(name)
        return out

    def get_info(self, name: str) -> Feature:
        """A feature's type, dependencies and builder; KeyError if there is none of that name."""
        return self.features[name]

    def extract_selected(self, packets: DataFrame, names: list[str]) -> DataFrame:
        return self.extract(packets, names)

    def extract(self, packets: DataFrame, names: list[str] | None = None) -> DataFrame:
        """flow and the features asked for (all by default), from oriented packets."""
        wanted = list(self.features) if names is None else names
        order = self.order(wanted)
        plain = [n for n in order if not self.features[n].dependencies]
        df = packets.groupBy("flow").agg(*[self.features[n].build().alias(n) for n in plain]) if plain else packets.select("flow").distinct()
        for n in order:
            if self.features[n].dependencies:
                df = df.withColumn(n, self.features[n].build())
        return df.select("flow", *wanted)


def incremental(packets: DataFrame, name: str, processor: Callable[[], object], kind: pa.DataType, columns: list[str]) -> DataFrame:
    """A feature that sees packets one after another: flow, and the value under ``name``. An error in an update is passed over, as the rest still counts."""

    class State:
        def __init__(self):
            self.processor = processor()
            self.processor.initialize()

        def feed(self, row: dict) -> None:
            try:
                self.processor.update(row)
            except Exception:  # noqa: BLE001  users' code
                pass

        def result(self) -> dict:
            return {name: self.processor.get_value()}

    return folded(packets, State, [(name, kind)], columns)
