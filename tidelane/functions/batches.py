"""Arrow batches in pieces, so that a worker has few Python objects at a time however many rows and batches a task has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are Python objects at a time, and bytes of them that a piece has before it is handed on.
ROWS, BYTES = 1000, 1 << 23


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows as dicts, ``ROWS`` at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS).to_pylist()


def joined(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows: a batch ends with ``ROWS`` rows or with the row whose binary values take it to ``BYTES``. One batch at least."""
    binary = [f.name for f in schema if pa.types.is_binary(f.type)]
    held, size, any_yet = [], 0, False
    for row in rows:
        held.append(row)
        size += sum(len(row[c] or b"") for c in binary)
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield pa.RecordBatch.from_pylist(held, schema)
