"""Token ids in grammar-compressed shards (Re-Pair).

A shard holds the ids of successive documents. Id pairs are replaced by nonterminals, round after round, until no pair occurs often enough to pay for
its rule; the shard stores the rules, each rule's expansion length, and the remaining symbols with an index by document. With the expansion lengths any slice
of a document is decoded without expanding what stands before it. Pairs never cross documents.

Shard layout, little-endian: ``b"RPAIR1\\0\\0"``; u32 documents, u32 rules, u64 symbols, u32 first nonterminal; i64 ids of documents; u8 whether that id is
null; u64 first symbol of each document, with the end; u32 ids of each document; u32 pairs of the rules; u32 expansion lengths; u32 symbols.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table, text_of
from .tokens import crc, encoder
from .vectors import mixed64

MAGIC = b"RPAIR1\0\0"
_HEAD = struct.Struct("<IIQI")
#: Between documents while rules are sought; never stored.
_GAP = np.uint32(0xFFFFFFFF)
#: Ids in a shard (a document is never divided); uses from which a pair pays for its rule, which takes three numbers, as each use spares one.
SHARD_IDS, LEAST_USES = 1 << 20, 4
_NO_RANK = np.int32(0x7FFFFFFF)
END_ID = 1
#: Words that a worker keeps at most; more than elsewhere, as nothing else here needs memory.
MEMO = 1_200_000


def _sorted_pairs(seq: np.ndarray, at: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs at some places, sorted, and the place of each. ``symbol``: bits of a symbol."""
    codes, place = seq[at].astype(np.uint64), len(seq).bit_length()
    codes <<= np.uint64(symbol)
    codes |= seq[at + 1]
    if 2 * symbol + place > 64:
        order = np.argsort(codes, kind="stable")
        return codes[order], at[order]
    codes <<= np.uint64(place)  # code and place in one number sort fastest
    codes |= at.view(np.uint64)
    codes.sort()
    places = (codes & np.uint64((1 << place) - 1)).view(np.int64)
    codes >>= np.uint64(place)
    return codes, places


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of stretches that begin at ``starts``."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _second_of_run(here: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Every other place (by number in ``here``) of stretches of successive places with the same pair, from the second on."""
    like = np.flatnonzero((mine[1:] == mine[:-1]) & (here[1:] == here[:-1] + 1))
    if not len(like):
        return like
    opens = np.flatnonzero(np.append(True, like[1:] != like[:-1] + 1))
    since = np.arange(len(like)) - np.repeat(opens, np.diff(np.append(opens, len(like))))
    return like[since % 2 == 0] + 1


def compress(seq: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(remaining symbols, rules as pairs) of ids with gaps; nonterminals are numbered from ``first``.

    A round replaces every pair of ``LEAST_USES`` or more uses, each where it is more frequent than the pairs that overlap it (ties: by a hash, so that
    no long chain of ties is replaced one by one; of a run of one symbol, every other pair). Where neither symbol is new and the pair wasn't frequent
    in the round before, it can't be frequent now, so each round looks only at the other places.
    """
    seq, rules, top = seq.copy(), [np.empty((0, 2), np.uint32)], first
    gap = seq == _GAP
    at = np.flatnonzero(~(gap[:-1] | gap[1:]))
    ranks = np.full(len(seq) + 2, _NO_RANK)  # at i + 1: of the pair at i
    while len(at):
        bits = (top - 1).bit_length()
        codes, places = _sorted_pairs(seq, at, bits)
        begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        uses = np.diff(np.append(begins, len(codes)))
        often = np.flatnonzero(uses >= LEAST_USES)
        if not len(often):
            break
        begins, uses = begins[often], uses[often]
        pairs = codes[begins]
        order = np.argsort(((len(seq) - uses).astype(np.uint64) << np.uint64(32)) | (mixed64(pairs) >> np.uint64(32)), kind="stable")
        rank = np.empty(len(uses), np.int32)
        rank[order] = np.arange(len(uses), dtype=np.int32)
        here = places[_places(begins, uses)] + 1
        ranks[here] = np.repeat(rank, uses)
        here = np.sort(here) if 32 * len(here) < len(seq) else np.flatnonzero(ranks[: len(seq) + 1] != _NO_RANK)
        mine = ranks[here]
        wins = (mine <= ranks[here - 1]) & (mine <= ranks[here + 1])
        wins[_second_of_run(here, mine)] = False
        ranks[here] = _NO_RANK
        wins = np.flatnonzero(wins)
        take, which = here[wins] - 1, mine[wins]
        pays = np.bincount(which, minlength=len(uses)) >= LEAST_USES
        if not pays.all():
            good = np.flatnonzero(pays[which])
            take, which = take[good], which[good]
        if not len(take):
            break
        made = pairs[order][pays]
        rules.append(np.stack([made >> np.uint64(bits), made & np.uint64((1 << bits) - 1)], 1).astype(np.uint32))
        seq[take] = (top + (np.cumsum(pays) - 1)[which]).astype(np.uint32)
        top += len(rules[-1])
        seq, at = _closed_up(seq, take + 1, np.concatenate([here - 1, take - 1]))
        at = at[(seq[at] != _GAP) & (seq[at + 1] != _GAP)]
    return seq, np.concatenate(rules)


def _closed_up(seq: np.ndarray, gone: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence without some places (sorted), and where other places are in it, in order, but the last; those that are gone or before the first don't count."""
    keep = np.ones(len(seq), bool)
    keep[gone] = False
    if 32 * len(places) < len(seq):
        places = np.unique(places)
        places = places[np.searchsorted(places, 0) :]
        places = places[keep[places]]
        places -= np.searchsorted(gone, places)
        seq = seq[keep]
        return seq, places[: np.searchsorted(places, len(seq) - 1)]
    marked = np.zeros(len(seq) + 1, bool)
    marked[places] = True  # -1 is the one beyond the end
    kept = np.flatnonzero(keep)
    return seq[kept], np.flatnonzero(marked[kept[:-1]])


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard of documents' ids (little-endian unsigned 32-bit integers)."""
    parts = [np.frombuffer(x, "<u4") for x in ids]
    first = max([65536, *(int(p.max()) + 1 for p in parts if len(p))])
    gap = np.array([_GAP])
    seq, rules = compress(np.concatenate([y for p in parts for y in (p, gap)] or [gap]), first)
    ends = np.flatnonzero(seq == _GAP)[: len(parts)]
    starts = np.concatenate([[0], ends - np.arange(len(ends))]).astype("<u8")
    seq = seq[seq != _GAP]
    lengths = _lengths(rules, first)
    head = _HEAD.pack(len(parts), len(rules), len(seq), first)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join([MAGIC, head, numbers.tobytes(), null.tobytes(), starts.tobytes(), np.array([len(p) for p in parts], "<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes()])


def _lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion lengths. A rule's symbols have lower numbers than its own, so lengths are known from the lowest up, some levels at a time."""
    out = np.zeros(first + len(rules), np.int64)
    out[:first] = 1
    open_ = np.arange(len(rules))
    while len(open_):
        a, b = out[rules[open_, 0]], out[rules[open_, 1]]
        known = (a > 0) & (b > 0)
        out[first + open_[known]] = (a + b)[known]
        open_ = open_[~known]
    return out[first:].astype(np.uint32)


class Shard:
    """Reads a shard."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, rules, symbols, self.first = _HEAD.unpack_from(blob, 8)
        at = 8 + _HEAD.size

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.numbers, self.null, self.starts, self.counts = array("<i8", n), array("u1", n), array("<u8", n + 1), array("<u4", n)
        self.rules, self.lengths, self.seq = array("<u4", 2 * rules).reshape(-1, 2), array("<u4", rules), array("<u4", symbols)
        if at != len(blob):
            raise ValueError("a shard of another length than it says")

    def doc_id(self, k: int) -> int | None:
        return None if self.null[k] else int(self.numbers[k])

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, one after another."""
        lengths = np.ones(len(self.seq), np.int64)
        rule = self.seq >= self.first
        lengths[rule] = self.lengths[self.seq[rule] - np.uint32(self.first)]
        ends = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        flat = np.empty(ends[-1], np.uint32)  # all rules' expansions, in order
        todo, at = np.arange(len(self.rules)), ends[:-1]
        while len(todo):
            pair = self.rules[todo]
            left = np.where(pair[:, 0] >= self.first, self.lengths[np.maximum(pair[:, 0], self.first) - np.uint32(self.first)], 1)
            symbols, at = pair.ravel(), np.stack([at, at + left], 1).ravel()
            ends_here = symbols < self.first
            flat[at[ends_here]] = symbols[ends_here]
            todo, at = symbols[~ends_here] - np.uint32(self.first), at[~ends_here]
        flat = np.concatenate([flat, self.seq[~rule]])
        source = np.empty(len(self.seq), np.int64)
        source[rule] = ends[self.seq[rule] - np.uint32(self.first)]
        source[~rule] = ends[-1] + np.arange(int((~rule).sum()))
        begins = np.cumsum(lengths) - lengths
        return flat[np.repeat(source - begins, lengths) + np.arange(int(lengths.sum()))]

    def slice(self, k: int, lo: int, hi: int) -> list[int]:
        """Ids lo to hi of document k; symbols before lo are passed over by their lengths."""
        out: list[int] = []
        at = 0
        stack = self.seq[int(self.starts[k]) : int(self.starts[k + 1])][::-1].tolist()
        while stack and at < hi:
            x = stack.pop()
            length = int(self.lengths[x - self.first]) if x >= self.first else 1
            if at + length <= lo:
                at += length
            elif x < self.first:
                out.append(x)
                at += 1
            else:
                a, b = self.rules[x - self.first].tolist()
                stack += [b, a]
        return out


SHARD_SCHEMA = "part int, seq int, n_ids bigint, blob binary"
DOC_SCHEMA = "part int, seq int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def _write_shards(tokenizer: str, spaced: bool, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, spaced, MEMO).encode, int(end_id).to_bytes(4, "little")
        part, seq, numbers, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size // 4], pa.int64()), pa.array([write_shard(numbers, ids)], pa.binary())], ["part", "seq", "n_ids", "blob"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(encode(text.as_py()) + end)
                numbers.append(number)
                size += len(ids[-1])
                if size >= 4 * shard_ids:
                    yield shard()
                    seq, numbers, ids, size = seq + 1, [], [], 0
        if numbers:
            yield shard()

    return run


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = Shard(blob.as_py())
            ids, n = shard.all_ids(), len(shard.counts)
            ends = np.cumsum(shard.counts, dtype=np.int64)
            raw, starts = ids.astype("<u4").tobytes(), ends - shard.counts
            sums = [crc(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array([shard.doc_id(k) for k in range(n)], pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.counts.astype(np.int64)), pa.array(sums, pa.int64())],
                ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts, in ascending order of ids, and stores them as shards in the shared folder; returns the stored shards.

    A null text counts as empty, and an empty text has the end id alone. Null ids come first; rows with the same id go by text. An empty table
    has no shards. Other columns are not read. Columns: part, seq (the shards' order), n_ids, blob.
    """
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(_write_shards(tokenizer, spaced, end_id, shard_ids), SHARD_SCHEMA), "token-shards", "zstd")


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row for each document in the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("shard_start"))
    decoded = shards.select("part", "seq", "blob").mapInArrow(_read_shards, DOC_SCHEMA)
    return decoded.join(offsets, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
