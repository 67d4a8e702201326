"""Packing documents into windows of at most 1024 tokens by non-negative least squares.

Each document is cut into whole windows and a rest. The lengths of all rests make a histogram of at most 1023 numbers, which is all that the
driver sees. Combinations of up to three lengths that fill a window are enumerated, non-negative least squares finds how often each is to be
used so that the histogram is met, and the counts are rounded down. What is left is packed greedily, longest first, one piece after another;
where the window is full the piece is cut and goes on in the next. Pieces get their places by rank among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table, text_of
from .tokens import crc, encoder

WINDOW, END_ID = 1024, 0
#: Rests are rounded up to this many tokens when combinations are sought.
GRID = 4


def combinations(units: int, there: np.ndarray, parts: int = 3) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with up to ``parts`` of the lengths that are ``there``."""
    have = set(np.flatnonzero(there).tolist())
    out: list[tuple[int, ...]] = [(units,)] if units in have else []
    if parts >= 2:
        out += [(a, units - a) for a in sorted(have) if 2 * a >= units and units - a in have]
    if parts >= 3:
        out += [(a, b, units - a - b) for a in sorted(have) for b in sorted(have) if a >= b and b >= units - a - b > 0 and units - a - b in have]
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b| (active set)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(most):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        best = int(slope.argmax()) if n else 0
        if not n or slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12]
            if not len(gone):
                gone = at[low][:1]
            x[gone] = 0
            passive[gone] = False
            if best in gone and len(gone) == 1:
                return x
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID) -> list[tuple[int, int, int, int, int, bool]]:
    """Places for all pieces: (length, first rank, count, sequence or place in the stream, slot, whether in the stream).

    Ranks of a length from ``first rank`` on go to successive sequences, or one after another into the stream of what is left.
    """
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    units = window // grid
    unit_of = -(-np.arange(window + 1) // grid)
    in_unit = np.bincount(unit_of, counts, units + 1)
    in_unit[units] -= counts[window]  # whole windows stand alone
    combos = combinations(units, in_unit > 0)
    a = np.zeros((units + 1, len(combos)))
    for k, c in enumerate(combos):
        for u in c:
            a[u, k] += 1
    scale = max(1.0, in_unit.sum())
    repeats = np.floor(nnls(a, in_unit / scale) * scale + 1e-6).astype(np.int64) if combos else np.zeros(0, np.int64)
    used, left = np.zeros(window + 1, np.int64), in_unit.astype(np.int64)
    places: list[tuple[int, int, int, int, int, bool]] = []
    sequence = 0
    if counts[window]:
        places.append((window, 0, int(counts[window]), 0, 0, False))
        sequence, used[window] = int(counts[window]), counts[window]
    for k in np.argsort(-repeats, kind="stable"):
        combo = combos[k]
        n = min([int(repeats[k]), *(int(left[u]) // combo.count(u) for u in set(combo))])
        if n <= 0:
            continue
        for slot, u in enumerate(combo):
            left[u] -= n
            to, need = sequence, n
            for length in range(min(u * grid, window - (u == units)), (u - 1) * grid, -1):
                take = min(need, int(counts[length] - used[length]))
                if take > 0:
                    places.append((length, int(used[length]), take, to, slot, False))
                    used[length] += take
                    to, need = to + take, need - take
        sequence += n
    at = sequence * window
    for length in range(window - 1, 0, -1):
        if rest := int(counts[length] - used[length]):
            places.append((length, int(used[length]), rest, at, 0, True))
            at += rest * length
    return places


def _encode(tokenizer: str, spaced: bool, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, spaced).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            size, rows = 0, []
            for row, number, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                ids = encode(text.as_py()) + end
                rows.append((row, number, len(ids) // 4, [crc(ids[k : k + 4 * window]) for k in range(0, len(ids), 4 * window)], ids))
                size += len(ids)
                if size > 1 << 24:
                    yield _rows(rows)
                    size, rows = 0, []
            yield _rows(rows)

    return run


TOKEN_SCHEMA = "row_id bigint, doc_id bigint, doc_tokens bigint, crcs array<bigint>, ids binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row_id", "doc_id", "doc_tokens", "crcs", "ids"])


def tokens_of(docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of all documents, stored in the shared folder: row_id, doc_id, doc_tokens, crcs of each window's ids, ids (little-endian u32)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return saved(rows.mapInArrow(_encode(tokenizer, spaced, end_id, window), TOKEN_SCHEMA), "packing-ids", "zstd")


def _crc_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, length = (batch.column(k).to_pylist() for k in (1, 2))
        sums = [crc(ids.as_py()[4 * s : 4 * (s + n)]) for s, n, ids in zip(start, length, batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["row_id", "start", "ids_crc32"])


def pack(tokens: DataFrame, window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """One row for each piece: row_id, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokens`` comes from ``tokens_of``. A null or empty text is the end id alone. Rows with the same id, or a null one, are packed each on its own.
    Each id lies in one piece; offsets are gapless from 0. Only the last sequence can be short of more than ``grid`` - 1 tokens a piece.
    An empty table gives no rows.
    """
    spark = tokens.sparkSession
    whole = F.floor((F.col("doc_tokens") + window - 1) / window).cast("int")
    pieces = tokens.select("row_id", "doc_id", "doc_tokens", "crcs", F.explode(F.sequence(F.lit(0), whole - 1)).alias("no"))
    pieces = saved(
        pieces.select(
            "row_id", "doc_id", "doc_tokens", (F.col("no") * window).cast("bigint").alias("start"), F.least(F.lit(window), F.col("doc_tokens") - F.col("no") * window).cast("bigint").alias("length"),
            F.element_at("crcs", F.col("no") + 1).alias("ids_crc32"), F.shiftrightunsigned(F.xxhash64("row_id", "no"), 4).alias("ord"),
        ),
        "packing-pieces",
    )
    # At most `window` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(histogram, window, grid)
    # Both tables are bounded by the window, whatever the input.
    counted = F.broadcast(spark.createDataFrame(sorted(histogram.items()), "length bigint, n bigint"))
    slots = F.broadcast(spark.createDataFrame(places, "length bigint, first bigint, n bigint, at bigint, slot int, stream boolean").withColumnRenamed("length", "slot_length"))

    ranges = pieces.join(counted, "length").withColumn("range_no", F.shiftright(F.shiftright("ord", 30) * F.ceil(F.sqrt("n")).cast("bigint"), 30)).drop("n")
    up_to = Window.partitionBy("length").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("length", "range_no").agg(F.count(F.lit(1)).alias("in_range")).select("length", "range_no", F.coalesce(F.sum("in_range").over(up_to), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("length", "range_no").orderBy("ord", "row_id", "start")
    ranked = ranges.join(starts, ["length", "range_no"]).withColumn("rank", F.col("range_start") + F.row_number().over(within) - 1)
    placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    to = F.col("rank") - F.col("first")
    place = F.when(F.col("stream"), F.col("at") + to * F.col("length"))
    placed = saved(placed.select("row_id", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "slot", place.alias("place"), (F.col("at") + to).alias("sequence")), "packing-places")

    kept = ["row_id", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "slot"]
    room = window - F.col("place") % window
    fits = placed.filter("place is null or length <= %d - place %% %d" % (window, window))
    fits = fits.withColumn("sequence_id", F.when(F.col("place").isNull(), F.col("sequence")).otherwise(F.floor(F.col("place") / window))).withColumn("slot", F.coalesce(F.col("place") % window, F.col("slot").cast("bigint"))).select(*kept)
    cut = placed.filter("length > %d - place %% %d" % (window, window))
    halves = cut.select(
        "row_id", "doc_id", "doc_tokens",
        F.explode(
            F.array(
                F.struct(F.col("start"), room.alias("length"), F.floor(F.col("place") / window).alias("sequence_id"), (F.col("place") % window).alias("slot")),
                F.struct((F.col("start") + room).alias("start"), (F.col("length") - room).alias("length"), (F.floor(F.col("place") / window) + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("slot")),
            )
        ).alias("h"),
    ).select("row_id", "doc_id", "doc_tokens", "h.*")
    sums = halves.select("row_id", "start", "length").join(tokens.select("row_id", "ids"), "row_id").select("row_id", "start", "length", "ids").mapInArrow(_crc_of, "row_id bigint, start bigint, ids_crc32 bigint")
    out = fits.unionByName(halves.join(sums, ["row_id", "start"]).select(*kept))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


def sequences(pieces: DataFrame, tokens: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, length (without padding), ids (binary, padded to the window unless the length is a power of two)."""
    body = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    parts = pieces.join(tokens.select("row_id", "ids"), "row_id").select("sequence_id", "offset", "length", body.alias("body"))
    whole = parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "body"))).alias("parts"))  # at most `window` tokens
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["body"]))
    power = F.expr("length & (length - 1)") == 0
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(window) - F.col("length")).cast("int")))
    return whole.select("sequence_id", "length", F.when(power, joined).otherwise(F.concat(joined, pad)).alias("ids"))


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(tokens_of(docs, tokenizer)).drop("row_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
