"""Ordered folds over the packets of each flow, for state machines that built-in functions can't express.

Packets are dealt out by flow and sorted within partitions, then streamed through Python once: a worker holds one flow's state at a time, never its
packets, so the length of a flow doesn't matter. Packets come and results go in pieces, so neither does the length of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions.batches import joined, pieces


def folded(packets: DataFrame, make: Callable[[], object], fields: list[tuple[str, pa.DataType]], columns: list[str]) -> DataFrame:
    """One row for each flow whose fold has a result.

    ``make()`` gives an object with ``feed(row: dict)``, called in the order of pkt_no with ``columns``, and ``result() -> dict | None``.
    """
    schema = pa.schema([("flow", pa.string()), *fields])
    to_arrow_schema(packets.select("flow").schema)  # fails early where there is no flow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            now, state = None, None
            for rows in pieces(batches):
                for row in rows:
                    if state is None or row["flow"] != now:
                        if state is not None and (found := state.result()) is not None:
                            yield {"flow": now} | found
                        now, state = row["flow"], make()
                    state.feed(row)
            if state is not None and (found := state.result()) is not None:
                yield {"flow": now} | found

        yield from joined(results(), schema)

    used = ["flow", "pkt_no", *[c for c in columns if c not in ("flow", "pkt_no")]]
    return packets.select(*used).repartition("flow").sortWithinPartitions("flow", "pkt_no").mapInArrow(run, from_arrow_schema(schema))
