"""Flow operators on streams of packets. Columns as in batch, with ``ts`` as event time (timestamp)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flows import canonical

#: Seconds after which a flow without packets ends, and after which any flow does.
TCP_IDLE, UDP_IDLE, LONGEST = 120, 60, 600


def session_flows(packets: DataFrame, idle_s: int = UDP_IDLE, late: str = "30 seconds") -> DataFrame:
    """Flows cut by idle time: counts and bytes for each session; packets later than the watermark are dropped."""
    keyed = canonical(packets).withWatermark("ts", late)
    return keyed.groupBy(F.session_window("ts", f"{idle_s} seconds"), "flow").agg(F.count(F.lit(1)).alias("packets"), F.sum("wirelen").alias("bytes"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("session_window")


def windowed_rates(packets: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "30 seconds") -> DataFrame:
    """Packets and bytes by protocol in tumbling or sliding windows."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return packets.withWatermark("ts", late).groupBy(frame, "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("wirelen").alias("bytes")).select(F.col("window.start").alias("start"), "protocol", "packets", "bytes")


AGED_SCHEMA = "flow string, packets long, up_packets long, bytes long, start_us long, end_us long, closed_by string"
_STATE = "first string, packets long, up long, bytes long, start_us long, end_us long, protocol int"


def _age(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done: list[tuple] = []

    def close(s: tuple, why: str) -> None:
        done.append((key[0], s[1], s[2], s[3], s[4], s[5], why))

    if state.hasTimedOut:
        close(state.get, "idle")
        state.remove()
    else:
        s = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_us", "pkt_no"])
        for r in rows.itertuples():
            idle = (TCP_IDLE if r.protocol == 6 else UDP_IDLE) * 1_000_000
            if s is not None and (r.ts_us - s[5] > idle or r.ts_us - s[4] > LONGEST * 1_000_000):
                close(s, "idle" if r.ts_us - s[5] > idle else "age")
                s = None
            end = f"{r.src_ip}:{r.src_port}"
            s = (end, 0, 0, 0, r.ts_us, r.ts_us, r.protocol) if s is None else s
            s = (s[0], s[1] + 1, s[2] + (end == s[0]), s[3] + r.wirelen, s[4], max(s[5], r.ts_us), s[6])
        state.update(tuple(x.item() if hasattr(x, "item") else x for x in s))
        idle = (TCP_IDLE if s[6] == 6 else UDP_IDLE) * 1000
        state.setTimeoutTimestamp(max(int(s[5]) // 1000 + idle, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(done, columns=["flow", "packets", "up_packets", "bytes", "start_us", "end_us", "closed_by"])


def aged_flows(packets: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Flows as they end: by idle time (TCP and UDP have their own) or by age. State is one row for each open flow, whatever its length."""
    keyed = canonical(packets).withWatermark("ts", late).select("flow", "ts", "ts_us", "pkt_no", "src_ip", "src_port", "protocol", "wirelen")
    return keyed.groupBy("flow").applyInPandasWithState(_age, AGED_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
