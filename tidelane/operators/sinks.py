"""Writing flows and packets: JSON, CSV, Parquet, text, a single document, one capture for each flow."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..sources.captures import write_capture
from .flows import canonical
from .folds import folded

#: What a kind's default output is called after the capture's name.
SUFFIXES = {
    "cic": "_cic.csv", "cicext": "_cicext.csv", "seq": "_seq.log", "payload": "_payload.log", "tls": "_tls.log", "dns": "_dns.log", "smtp": "_smtp.log", "dhcp": "_dhcp.log", "ftp": "_ftp.log", "http": "_http.log", "ssh": "_ssh.log", "mqtt": "_mqtt.log",
    "sip": "_sip.log", "quic": "_quic.log", "rdp": "_rdp.log", "vnc": "_vnc.log", "pcap_split": "_flows", "vpn": "_vpn.log", "im": "_im.log", "flow": "_flow.json",
}


def default_output(capture: str, kind: str, folder: str | None = None) -> str:
    path = PurePosixPath(capture)
    return str(PurePosixPath(folder or path.parent) / (path.stem + SUFFIXES[kind]))


def flattened(df: DataFrame, levels: int = 3) -> DataFrame:
    """Struct fields as columns of their own, named with dots, to a depth of ``levels``."""

    def columns(schema: StructType, prefix: str, at: Column | None, depth: int) -> list[Column]:
        out = []
        for field in schema.fields:
            col = F.col(f"`{field.name}`") if at is None else at.getField(field.name)
            name = f"{prefix}{field.name}"
            if isinstance(field.dataType, StructType) and depth > 0:
                out += columns(field.dataType, f"{name}.", col, depth - 1)
            else:
                out.append(col.alias(name))
        return out

    return df.select(*columns(df.schema, "", None, levels))


def as_text(df: DataFrame) -> DataFrame:
    """Columns that CSV can't hold, as JSON."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def to_dicts(df: DataFrame, flatten: bool = False) -> Iterator[dict]:
    """Rows as nested dicts, one partition at a time on the driver; ``flatten``: with dotted names."""
    return (row.asDict(recursive=True) for row in (flattened(df) if flatten else df).toLocalIterator())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON; blank lines are passed over."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def with_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Flows with the statistics and sequences of these names as columns ``feature.<name>.<statistic>`` or ``feature.<name>``, after all others."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    more = []
    for name in names:
        if isinstance(kinds[name], StructType):
            more += [F.col(f"`{name}`").getField(x).alias(f"feature.{name}.{x}") for x in kinds[name].names]
        else:
            more.append(F.col(f"`{name}`").alias(f"feature.{name}"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *more)


def save_array(df: DataFrame, path: str, indent: int = 2) -> None:
    """Rows as one JSON array in a file of the driver's, read one partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(to_dicts(df)):
            text = json.dumps(row, indent=indent, default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x))
            f.write((",\n" if k else "\n") + " " * indent + text.replace("\n", "\n" + " " * indent))
        f.write("\n]\n" if df.columns else "]")


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes by the path's ending: .json (lines), .csv, .parquet. ValueError for another."""
    kind = PurePosixPath(path).suffix
    if kind == ".json":
        df.write.mode(mode).json(path)
    elif kind == ".csv":
        as_text(flattened(df)).write.mode(mode).option("header", True).csv(path)
    elif kind == ".parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"can't tell a format from {path!r}: use .json, .csv or .parquet")


def as_document(flows: DataFrame, **meta: Column) -> DataFrame:
    """One JSON document with ``meta`` (aggregates over the flows, by name) and all flows: one row, column ``value``. It has all flows in one place, as
    such a file must."""
    whole = flows.agg(*[c.alias(f"m_{k}") for k, c in meta.items()], F.collect_list(F.struct(*flows.columns)).alias("flows"))
    return whole.select(F.to_json(F.struct(F.struct(*[F.col(f"m_{k}").alias(k) for k in meta]).alias("meta"), F.col("flows"))).alias("value"))


def log_lines(df: DataFrame, kind: str) -> DataFrame:
    """Classified flows as text, one line each: column ``value``."""
    name = {"vpn": "vpn", "im": "app"}[kind]
    level = F.try_element_at(F.create_map(F.lit(1), F.lit("LOW"), F.lit(2), F.lit("MED"), F.lit(3), F.lit("HIGH")), F.col("confidence").cast("int"))
    return df.select(F.format_string("[%s] %s:%d -> %s:%d proto=%d confidence=%s packets=%d", F.upper(name), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", level, "packets").alias("value"))


class _Capture:
    """All raw packets of a flow, in file order, as a capture of their own."""

    fields = [("name", pa.string()), ("packets", pa.int64()), ("content", pa.binary())]

    def __init__(self):
        self.rows, self.name, self.link = [], None, 1

    def feed(self, row: dict) -> None:
        if self.name is None:
            stem = PurePosixPath(row["file"] or "capture").stem
            self.name, self.link = f"{stem}_{row['src_ip']}_{row['src_port']}_{row['dst_ip']}_{row['dst_port']}_{row['protocol']}.pcap", row["link_type"]
        self.rows.append((row["ts_us"], row["wirelen"], row["data"]))

    def result(self) -> dict:
        return {"name": self.name, "packets": len(self.rows), "content": write_capture(self.rows, self.link)}


def split_captures(raw: DataFrame, packets: DataFrame) -> DataFrame:
    """One capture for each IPv4 TCP or UDP flow: flow, name, packets, content. Other packets are left out."""
    keyed = canonical(packets.filter(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":"))).select("flow", "file", "pkt_no", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")
    joined = raw.join(keyed, ["file", "pkt_no"])
    return folded(joined, _Capture, _Capture.fields, ["file", "ts_us", "wirelen", "data", "link_type", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"])
