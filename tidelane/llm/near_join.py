"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (64-bit hashes; a shorter text is one shingle). Equal word sequences form one text first, however many copies
it has. MinHash bands propose candidates: texts with a band's values in common are a bucket. Units of comparison hold every proposed pair: the
components that buckets connect or, for a component of more texts than a block where that takes fewer copies of its texts, its buckets, each pair then
counting in the first bucket that it shares. Within a unit, or between two blocks of a large one, MinHash values are compared 32 at a time, and a pair
is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold falls below the tolerance. What remains is verified
exactly on the shingle sets. Units return one row for each text: how many links it has and whom it was joined with, so no pairs are ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, removed, saved, spread_join, table, text_of
from .components import components
from .tokens import forget
from .vectors import Words, chunks, mixed64

SHINGLE, THRESHOLD = 5, (4, 5)
#: MinHash bands and rows in each; values compared at once; probability below which a pair is dropped.
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 32, 1e-5
HASHES = BANDS * ROWS
#: Texts in a block; pairs in a tile from which it is verified as a whole; elements up to which that is done.
BLOCK, TILE, DENSE, TILE_SIZE = 512, 64, 24, 2_000_000

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ORDER = [np.uint64(x) for x in _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_BAND = mixed64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, with repeats; how many each text has (none without words); and the words' hashes."""
    h = words.hashes()
    count = np.where(words.count >= SHINGLE, words.count - SHINGLE + 1, (words.count > 0).astype(np.int64))
    first = np.repeat(words.first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    left = np.repeat(words.first + words.count, count) - first  # words from there to the text's end
    total = np.zeros(len(first), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        part = padded[first + k] * _ORDER[k]
        total += part if k == 0 else np.where(left > k, part, np.uint64(0))
    return mixed64(total), count, h


def minhashes(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row of MinHash values for each text that has shingles."""
    have = count > 0
    starts = (np.cumsum(count) - count)[have]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(x * _MULT[k] + _ADD[k], starts) if len(starts) else 0
    return np.ascontiguousarray(out.T)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        lo = 0
        for raws in chunks(t.as_py() for t in batch.column(2)):
            words = Words(raws)
            hashes, count, h = shingles(words)
            sig = minhashes(hashes, count)
            bands = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
            key = np.repeat(_BAND[None], len(sig), 0)
            for r in range(ROWS):
                key = mixed64(key ^ bands[:, :, r])
            place = (np.arange(len(words.doc)) - words.first[words.doc]).astype(np.uint64)
            ids = [np.zeros(len(raws), np.uint64), np.zeros(len(raws), np.uint64)]
            have = words.count > 0
            for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                if have.any():
                    ids[k][have] = np.add.reduceat(mixed64(h ^ mixed64(place + np.uint64(salt))), words.first[have])
            offsets = np.concatenate([[0], np.cumsum(np.where(have, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(raws)), batch.column(1).slice(lo, len(raws)), pa.array(ids[0].view(np.int64)), pa.array(ids[1].view(np.int64)), lists], ["row_id", "doc_id", "w1", "w2", "bands"])
            lo += len(raws)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    names = ["row_id", "copies", "units", "sig", "shingles"]
    for batch in batches:
        lo = 0
        for raws in chunks(t.as_py() for t in batch.column(3)):
            hashes, count, _ = shingles(Words(raws))
            sig = minhashes(hashes, count)
            ends = np.cumsum(count)
            sets = [np.unique(hashes[e - c : e]).tobytes() for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(raws)) for k in range(3)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())], names)
            lo += len(raws)


def least_matches(tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs to stay): with fewer, P(similarity >= threshold | matches) is below the tolerance."""
    t = THRESHOLD[0] / THRESHOLD[1]
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in [*range(STEP, HASHES, STEP), HASHES]:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= t].sum() >= tolerance * weight.sum():
                out.append((n, m))
                break
    return out


_NEEDED = least_matches()


def alike(a: np.ndarray, b: np.ndarray, common: int) -> bool:
    return THRESHOLD[1] * common >= THRESHOLD[0] * (len(a) + len(b) - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    return int((c[1:] == c[:-1]).sum())


def _candidates(sig: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) that no comparison of MinHash values rules out, for some i at a time. ``cross``: only pairs of unequal sides."""
    n = len(sig)
    (first, need), *later = _NEEDED
    for lo in range(0, n, TILE):
        hi = min(lo + TILE, n)
        match = np.zeros((hi - lo, n - lo), np.uint16)
        for k in range(first):
            match += sig[lo:hi, k][:, None] == sig[lo:, k][None]
        may = match >= need
        may &= np.arange(lo, hi)[:, None] < np.arange(lo, n)[None]
        if cross:
            may &= side[lo:hi][:, None] != side[lo:][None]
        i, j = np.nonzero(may)
        total = match[i, j].astype(np.int64)
        i, j, done = i + lo, j + lo, first
        for upto, need_then in later:
            total = total + (sig[i, done:upto] == sig[j, done:upto]).sum(1)
            stay = total >= need_then
            i, j, total, done = i[stay], j[stay], total[stay], upto
        yield i, j


def links_among(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None, cross: bool = False, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of texts at or above the threshold: those that pruning leaves, verified exactly. ``band``: only those that share this band and none before."""
    side = np.zeros(len(sig), np.int8) if side is None else side
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _candidates(sig, side, cross):
        if band >= 0:
            upto = (band + 1) * ROWS
            shared = (sig[i, :upto] == sig[j, :upto]).reshape(-1, band + 1, ROWS).all(2)
            here = shared[:, -1] & ~shared[:, :-1].any(1)
            i, j = i[here], j[here]
        tile = j // TILE
        for one in np.unique(tile):
            at = tile == one
            a, b = i[at], j[at]
            rows, cols = np.unique(a), np.unique(b)
            if len(a) >= DENSE and sum(len(sets[k]) for k in (*rows, *cols)) <= TILE_SIZE:
                known = np.unique(np.concatenate([sets[k] for k in rows]))
                m = [np.zeros((len(s), len(known)), np.float32) for s in (rows, cols)]
                for which, x in zip((rows, cols), m, strict=True):
                    for k, text in enumerate(which):
                        where = np.searchsorted(known, sets[text])
                        where[where == len(known)] = 0
                        x[k, where[known[where] == sets[text]]] = 1
                common = (m[0] @ m[1].T)[np.searchsorted(rows, a), np.searchsorted(cols, b)].astype(np.int64)
            else:
                common = np.array([_common(sets[p], sets[q]) for p, q in zip(a, b, strict=True)], np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            good = THRESHOLD[1] * common >= THRESHOLD[0] * (size[a] + size[b] - common)
            left.append(a[good])
            right.append(b[good])
    return np.concatenate(left), np.concatenate(right)


OUT_SCHEMA = "row_id bigint, parent bigint, links bigint, linked_docs bigint"


def _compared(rows: list[tuple], band: int, i: int, j: int) -> list[tuple[int, int, int, int]]:
    """Of one unit's or two blocks' texts that have links: row_id, another of the same group (the smallest here), links, documents linked."""
    if len(rows) < 2:
        return []
    row, copies = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    side = np.array([r[2] for r in rows])
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), HASHES)
    a, b = links_among(sig, [np.frombuffer(r[4], np.uint64) for r in rows], side, i != j, band)
    if not len(a):
        return []
    links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
    docs = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(int(row[k]), int(row[root(k)]), int(links[k]), int(docs[k])) for k in np.flatnonzero(links)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit and pair of blocks; each run of them is one comparison."""
    forget()
    held, key, found = [], None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_id", "parent", "links", "linked_docs"])

    for batch in batches:
        head = [batch.column(k).to_pylist() for k in range(7)]
        for k in range(batch.num_rows):
            now = (head[0][k], head[1][k], head[2][k], head[3][k])
            if now != key:
                found += _compared(held, *key[1:]) if key else []
                held, key = [], now
            held.append((head[4][k], head[5][k], head[6][k], batch.column(7)[k].as_py(), batch.column(8)[k].as_py()))
        if len(found) > 10_000:
            yield out()
            found = []
    found += _compared(held, *key[1:]) if key else []
    yield out()


def units_of(comps: DataFrame, buckets: DataFrame) -> DataFrame:
    """Of each text in a component the units where it is compared: row_id, units (unit, band or -1 for a whole component, blocks of the unit)."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    sizes = saved(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    n, largest, texts = sizes.agg(F.count(F.lit(1)), F.max("size"), F.sum("size")).first()
    if not n or largest <= BLOCK:
        return comps.select("row_id", F.array(F.struct(F.col("comp").alias("unit"), F.lit(-1).alias("band"), F.lit(1).cast("bigint").alias("blocks"))).alias("units"))
    # Copies of texts that comparing by buckets would take.
    firsts = buckets.filter("row_id = least").select("row_id", "n").join(comps, "row_id").groupBy("comp").agg(F.sum(F.col("n") * blocks("n")).alias("by_bucket"))
    plans = saved(sizes.join(firsts, "comp").select("comp", "size", ((F.col("size") > BLOCK) & (F.col("by_bucket") < F.col("size") * blocks("size"))).alias("apart")), "near-sizes")
    planned = saved(spread_join(comps, plans, ["comp"], "size", texts, (n, largest)), "near-plans")
    whole = planned.filter(~F.col("apart")).select("row_id", F.array(F.struct(F.col("comp").alias("unit"), F.lit(-1).alias("band"), blocks("size").alias("blocks"))).alias("units"))
    apart = buckets.join(planned.filter("apart").select("row_id"), "row_id", "left_semi").select("row_id", F.struct(F.col("key").alias("unit"), "band", blocks("n").alias("blocks")).alias("u"))
    return whole.unionByName(apart.groupBy("row_id").agg(F.collect_list("u").alias("units")))  # at most one for each band


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each document: row_id, doc_id, class_id, n_links, n_linked_docs, n_copies, kept.

    Documents whose similarity is 0.8 or more are linked, and class_id is the smallest id of those that links and equal words connect. n_links counts the
    other texts that a text is linked with, n_linked_docs their documents, n_copies the documents with the same words. One document of each class is
    ``kept``: the smallest id, then row. A null text counts as empty; texts without words are copies of one another, without links. Null ids come
    first when one is kept, and a class of them alone has a null class_id. Rows with the same id are documents of their own, and
    classes whose smallest id is the same share its name. An empty
    table gives no rows. Other columns are not read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = saved(docs.select(row.alias("row_id"), F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")), "near-texts", "zstd")
    sketch = saved(texts.mapInArrow(_sketch, "row_id bigint, doc_id bigint, w1 bigint, w2 bigint, bands array<bigint>"), "near-sketch")
    distinct = saved(sketch.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "row_id")).alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")).select("w1", "w2", F.col("rep.row_id").alias("rep"), F.col("rep.doc_id").alias("rep_doc"), "least_id", "copies"), "near-distinct")

    keys = saved(sketch.join(distinct.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select("row_id", F.posexplode("bands").alias("band", "key")), "near-keys")
    shared = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("least")).filter("n > 1"), "near-shared")
    buckets = saved(spread_join(keys, shared, ["key"], "n", keys.count()), "near-buckets")
    removed(docs.sparkSession, keys, shared)
    comps = components(buckets.filter("row_id <> least").select(F.col("row_id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("row_id"), F.col("root").alias("comp"))
    units = units_of(comps, buckets)

    members = units.join(distinct.select(F.col("rep").alias("row_id"), "copies"), "row_id")
    unit = "array<struct<unit:bigint,band:int,blocks:bigint>>"
    sets = texts.join(members, "row_id").select("row_id", "copies", "units", "text").mapInArrow(_sets, f"row_id bigint, copies bigint, units {unit}, sig binary, shingles binary")
    blocks = sets.select("row_id", "copies", "sig", "shingles", F.explode("units").alias("u")).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("u.blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("u.blocks") - 1)))
    blocks = blocks.select("u.unit", "u.band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row_id", "copies", "block", "sig", "shingles")
    found = saved(blocks.repartition("unit", "band", "i", "j").sortWithinPartitions("unit", "band", "i", "j").mapInArrow(_compare, OUT_SCHEMA), "near-links")

    links = found.groupBy("row_id").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"))
    groups = components(found.select(F.col("row_id").alias("a"), F.col("parent").alias("b")))
    joined = distinct.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("row_id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = joined.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min(F.struct("rep_doc", "rep")).alias("first"))
    known = saved(joined.join(classes, "root").select("w1", "w2", "copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"), F.col("first.rep").alias("first")), "near-classes")
    return spread_join(sketch.select("row_id", "doc_id", "w1", "w2"), known, ["w1", "w2"], "copies").select("row_id", "doc_id", "class_id", "n_links", "n_linked_docs", F.col("copies").alias("n_copies"), (F.col("row_id") == F.col("first")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns only."""
    row = fresh(docs.columns, "row_id")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    stay = near_join(numbered, row_col=row).filter("kept").select(F.col("row_id").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_linked_docs", "n_copies", "kept")
