"""What Python workers hold: pieces of batches, and one worker for steps that follow each other."""

import re

import pyarrow as pa
import pytest

from tidelane.functions.batches import ROWS, joined, pieces
from tidelane.operators import l7
from tidelane.plans import catalogue
from tidelane.sources import build, layers

DATA = "/root/testdata/sf0.001"


def python_steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", plan))


@pytest.mark.parametrize("name", ["quic_frames", "ssh_frames", "vnc_frames", "vpn_frames"])
def test_one_worker_makes_frames_and_another_folds(spark, name):
    assert python_steps(catalogue.QUERIES[name](spark, DATA)) == 2


def test_long_batches_become_pieces():
    schema = pa.schema([("n", pa.int64()), ("b", pa.binary())])
    batch = pa.RecordBatch.from_pylist([{"n": n, "b": b"x"} for n in range(2 * ROWS + 1)], schema)
    assert [len(rows) for rows in pieces([batch])] == [ROWS, ROWS, 1]
    assert [b.num_rows for b in joined(batch.to_pylist(), schema)] == [ROWS, ROWS, 1]
    assert [b.num_rows for b in joined(({"n": n, "b": bytes(3 << 20)} for n in range(4)), schema)] == [3, 1]
    assert [b.num_rows for b in joined([], schema)] == [0] and joined([], schema).__next__().schema == schema


def test_frames_and_layers_in_pieces():
    row = {"src_ip": "10.0.0.1", "src_port": 4, "dst_ip": "10.0.0.2", "dst_port": 5, "protocol": 6, "payload": b"abc", "tcp_flags": 24, "tcp_seq": 1, "tcp_win": 2}
    kinds = [pa.string() if c.endswith("_ip") else pa.binary() if c == "payload" else pa.int64() for c in build.COLUMNS]
    batch = pa.RecordBatch.from_pylist([row | {"pkt_no": n, "ts_us": n} for n in range(3 * ROWS)], pa.schema(list(zip(build.COLUMNS, kinds, strict=True))))
    parse, schema = layers.parsing(["tcp"])
    out = list(parse(build.framing("f")([batch])))
    assert [b.num_rows for b in out] == [ROWS] * 3 and out[0].schema == schema
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["pkt_no"] for r in rows] == list(range(3 * ROWS)) and {(r["file"], r["src_ip"], r["dst_port"], r["payload"], r["tcp"]["win"]) for r in rows} == {("f", "10.0.0.1", 5, b"abc", 2)}


@pytest.mark.parametrize("kind", sorted(k for k, f in l7.KINDS.items() if f.signature is not None))
def test_signatures_as_columns_are_those_of_python(spark, kind):
    """Any first byte, and beginnings of every protocol, at ports that no kind has."""
    begins = [bytes([n]) + rest for n in range(256) for rest in (b"\x03\x03\0\x05hello", b"\x03\0\n\r\xff\xe0", b"")] + [b"\x03\0\n\x0a\x02\xe0", b"\x03\0\0\x13\x0e\xe0", b"SSH-2.0", b"GET / HTTP", b"xGET / H", b"HTTP/1.1", b"PRI * HTTP/2.0", b"INVITE sip", b"SIP/2.0 200", b"RFB 003.008\n", b"RFB 00a.008\n", "RFB ٠٠٣.008".encode()]
    rows = [(n, bytearray(b), "10.0.0.1", "10.0.0.2", 50000 + n, 50001, 17 if kind in ("quic", "dhcp") else 6, n) for n, b in enumerate(begins)]
    df = spark.createDataFrame(rows, "pkt_no bigint, payload binary, src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol int, ts_us bigint")
    seen = []
    l7_folded, l7.folded = l7.folded, lambda packets, *_: seen.append(packets)
    try:
        l7.metadata(df, kind)
    finally:
        l7.folded = l7_folded
    pattern = l7.KINDS[kind].signature.pattern
    assert sorted(r["pkt_no"] for r in seen[0].collect()) == [n for n, b in enumerate(begins) if re.match(pattern, b, re.S)]
