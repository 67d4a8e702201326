"""Scoring with a Brown class-based bigram model.

The most frequent words, as many as the square root of the vocabulary, ``CLUSTERED`` at least and ``EXCHANGED`` at most, are assigned to classes by
exchange clustering: each in turn moves to the class where the likelihood of the training bigrams is greatest, until none moves; all others stand
together as one class meanwhile. Then each of these is assigned, by the classes before and after it wherever it stands, to the class where that
likelihood is greatest, so every training word has a class. A word that training didn't have belongs to the class with most words of its ending (a
hash of its last two bytes), and the end of a text is a class. A token's probability is that of its class after the class before it, interpolated with
the class's own, times that of the word in its class, with half a count added for each known word of a class and for the unknown ones of each ending
that belongs to it.

Words are handled by 64-bit hashes. Workers get the counts of words that make up at least a ``LOCAL``-th of all tokens, of which there can't be more
than that many; the counts and classes of all others come by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, removed, saved, table, text_of
from .vectors import Words, chunks

#: Words that are exchanged at least and the classes, kinds of endings, weight of a class's own probability, bound of the local table.
CLUSTERED, CLASSES, ENDINGS, OWN, LOCAL = 800, 64, 96, 20.0, 1_000_000
#: Words that the driver exchanges at most: it holds their bigram counts, at most 4,098 x 4,098 numbers, whatever the corpus. All others are assigned.
EXCHANGED = 4096
#: Tokens that are counted at once.
COUNTED = 1 << 21


def _endings(words: Words) -> np.ndarray:
    """The kind, from 0, of each word's last two bytes."""
    last = words.buf[words.end - 1].astype(np.uint32)
    before = np.where(words.end - words.start > 1, words.buf[np.maximum(words.end - 2, 0)], 0).astype(np.uint32)
    return ((last * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % np.uint32(ENDINGS)


def _texts(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) of some rows at a time, A-Z in lower case."""
    lo = 0
    for raws in chunks(t.as_py() for t in column):
        yield lo, Words([r.lower() for r in raws])
        lo += len(raws)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ends, size = [], [], 0

    def out() -> pa.RecordBatch:
        h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(ends)[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "ending", "n"])

    for batch in batches:
        for _, words in _texts(batch.column(0)):
            held.append(words.hashes())
            ends.append(_endings(words).astype(np.uint8))
            size += len(held[-1])
            if size >= COUNTED:
                yield out()
                held, ends, size = [], [], 0
    if size:
        yield out()


def _units(words: Words, top: np.ndarray) -> np.ndarray:
    """Exchanged words by their place in ``top`` (sorted hashes), all others as the place after it."""
    h = words.hashes()
    if not len(top):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(top, h)
    at[at == len(top)] = 0
    return np.where(top[at] == h, at, len(top))


def _with_ends(words: Words, units: np.ndarray, end: int) -> np.ndarray:
    """Units of all texts in order, each text followed by its end."""
    out = np.full(len(units) + len(words.count), end, np.int64)
    out[np.arange(len(units)) + words.doc] = units
    return out


def _pairs(top: np.ndarray):
    size = len(top) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for _, words in _texts(batch.column(0)):
                seq = _with_ends(words, _units(words, top), size - 1)
                before = np.concatenate([[size - 1], seq[:-1]])  # a text begins after an end
                held.append(before * size + seq)
                tokens += len(seq)
                if tokens >= COUNTED:
                    yield out()
                    held, tokens = [], 0
        if held:
            yield out()

    return run


def _neighbours(top: np.ndarray, which: np.ndarray, whole: bool):
    """Of words outside ``top``: (h, cell, null, n), where cell is the class after it, those before it after all of these, or 2 * classes for the word
    itself. Neighbours outside ``top`` are left out. If ``whole``, those are (h, null, next, n) where a different such word follows, and bigrams without
    such words (null, before * classes + after, null, n)."""
    classes = int(which.max()) + 1
    rest = which[len(top)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, np.zeros(classes * classes, np.int64)

        def out() -> pa.RecordBatch:
            h, cell, follows = (np.concatenate(x) for x in zip(*held, strict=True))
            both, at = np.unique(np.concatenate([h, follows]), return_inverse=True)
            left, right = at[: len(h)], at[len(h) :]
            wide = 2 * classes + 1
            code, n = np.unique(np.where(cell >= 0, left * wide + cell, -1 - (left * len(both) + right)), return_counts=True)
            pair = code < 0
            of_pair = np.where(pair, -1 - code, 0)
            word = both[np.where(pair, of_pair // len(both), code // wide)].view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((code % wide).astype(np.int32), mask=pair), pa.array(both[of_pair % len(both)].view(np.int64), mask=~pair), pa.array(n.astype(np.int64))], ["h", "cell", "next", "n"]
            )

        for batch in batches:
            for _, words in _texts(batch.column(0)):
                seq = which[_with_ends(words, _units(words, top), len(top) + 1)]
                h = np.zeros(len(seq), np.uint64)
                h[np.arange(len(words.doc)) + words.doc] = words.hashes()
                before, after = np.concatenate([[classes - 1], seq[:-1]]), np.append(seq[1:], classes - 1)
                h_after = np.append(h[1:], np.uint64(0))
                rare = seq == rest
                twice = rare & (after == rest) & (h_after == h)
                two = rare & (after == rest) & ~twice
                kinds = [(rare & (after != rest), after), (rare & (before != rest), classes + before), (twice, np.full(len(seq), 2 * classes))]
                if whole:
                    kinds.append((two, np.full(len(seq), -1)))
                    neither = ~rare & (before != rest)
                    total += np.bincount(before[neither] * classes + seq[neither], minlength=classes * classes)
                for of, cell in kinds:
                    held.append((h[of], cell[of], h_after[of] if of is two else h[of]))
                    size += len(held[-1][0])
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int64()), pa.array(total[at])], ["h", "cell", "next", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES) -> np.ndarray:
    """Classes of units from their bigram counts. The first ``movable`` units are dealt over ``classes`` classes, and moved until the likelihood stands
    still; every other unit is a class of its own."""
    size = len(pairs)
    pairs = pairs.astype(float, copy=False)
    classes = max(1, min(classes, movable))
    # Dealt at random, from a fixed seed: dealt in turn, words of alternating kinds would stand in a balance that no single move improves.
    which = np.concatenate([np.random.default_rng(17).integers(0, classes, movable), classes + np.arange(size - movable)])
    n = classes + size - movable
    one = np.zeros((size, n))
    one[np.arange(size), which] = 1
    table = one.T @ pairs @ one
    order = np.argsort(-pairs[:movable].sum(1), kind="stable")
    rounding = max(1e-9, 1e-14 * float(_xlogx(pairs.sum())))
    moved = movable
    while moved:  # a move adds to the likelihood, so this ends
        moved = 0
        for w in order.tolist():
            out, into, own = np.bincount(which, pairs[w], n), np.bincount(which, pairs[:, w], n), pairs[w, w]
            now = which[w]
            out[now] -= own
            into[now] -= own
            table[now] -= out
            table[:, now] -= into
            table[now, now] -= own
            left, right = table.sum(1) + into, table.sum(0) + out  # the word's neighbours keep their totals wherever it goes
            c = np.arange(classes)
            gain = (_xlogx(table[:classes] + out) - _xlogx(table[:classes])).sum(1) + (_xlogx(table[:, :classes].T + into) - _xlogx(table[:, :classes].T)).sum(1)
            same = table[c, c]
            gain += _xlogx(same + out[c] + into[c] + own) + _xlogx(same) - _xlogx(same + out[c]) - _xlogx(same + into[c])
            l, r = out.sum() + own, into.sum() + own
            gain -= _xlogx(left[:classes] + l) - _xlogx(left[:classes]) + _xlogx(right[:classes] + r) - _xlogx(right[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[now] + rounding:
                best = int(now)
            moved += best != now
            which[w] = best
            table[best] += out
            table[:, best] += into
            table[best, best] += own
    return which


def best_class(table: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class, but the last two, where each word adds most to the likelihood when it leaves the class before the last; by the counts (a row for each
    word) of classes after and before it, and of itself after itself."""
    k = len(table) - 2
    t = table[:k, :k]
    gain = np.zeros((len(out), k))
    for counts, side in ((out, table[:k]), (into, table[:, :k].T)):
        word, j = np.nonzero(counts)
        word, j = word[j != k], j[j != k]
        for lo in range(0, len(word), 1 << 16):
            w, c = word[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            now = side[:, c].T
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[starts]] += np.add.reduceat(_xlogx(now + counts[w, c][:, None]) - _xlogx(now), starts, axis=0)
    same = np.diag(t)
    gain += _xlogx(same + out[:, :k] + into[:, :k] + own[:, None]) + _xlogx(same) - _xlogx(same + out[:, :k]) - _xlogx(same + into[:, :k])
    for counts, others, side in ((out, into, table), (into, out, table.T)):
        rest = side[:k, k] - others[:, :k]  # without the word, which is in that class as yet
        gain += _xlogx(rest + counts[:, [k]]) - _xlogx(rest)
        all_ = side[:k].sum(1)
        gain -= _xlogx(all_ + counts.sum(1, keepdims=True) + own[:, None]) - _xlogx(all_)
    return gain.argmax(1)


def _assign(table: np.ndarray, top: np.ndarray, which: np.ndarray):
    n = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            uses = batch.column(1).to_numpy()
            found = np.zeros(len(h), np.int32)
            for lo in range(0, len(h), 1 << 14):
                part = batch.column(3).slice(lo, 1 << 14)
                x = part.flatten()
                cells = np.zeros((len(part), 2 * n + 1))
                cells[np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy()), x.field("cell").to_numpy()] = x.field("n").to_numpy()
                out, into, own = cells[:, :n], cells[:, n : 2 * n], cells[:, 2 * n]
                for side in (out, into):  # all other neighbours are words that are to be assigned
                    side[:, n - 2] = uses[lo : lo + len(part)] - own - side.sum(1)
                known = np.searchsorted(top, h[lo : lo + len(part)])
                known[known == len(top)] = 0
                exchanged = top[known] == h[lo : lo + len(part)]
                rest = ~exchanged
                found[lo : lo + len(part)][exchanged] = which[known[exchanged]]
                found[lo : lo + len(part)][rest] = best_class(table, out[rest], into[rest], own[rest])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["h", "n", "ending", "class"])

    return run


class Brown:
    """What scoring needs of a trained model. All tables are bounded by the parameters."""

    def __init__(self, tokens: int, distinct: int, texts: int, local: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, sums: np.ndarray, ending_class: np.ndarray):
        """``local``: sorted hashes, counts, classes; ``table``: class bigrams, the end last; ``sums``: tokens and words by class; classes of endings."""
        self.tokens, self.distinct, self.texts = tokens, distinct, texts
        n = len(table)
        # Units are endings (of unknown words), the end, classes.
        self.first_ending, self.end_unit = 0, ENDINGS
        self.which = np.concatenate([ending_class, [n - 1], np.arange(n - 1)])
        own = (table.sum(0) + 1) / (table.sum() + n)
        self.step = np.log10((table + OWN * own) / (table.sum(1, keepdims=True) + OWN))
        self.hashes, counts, classes = local
        self.base_of_all = float(np.log10(tokens + 0.5 * (distinct + 1)))
        self.log_half = np.log10(counts + 0.5)
        self.unit = ENDINGS + 1 + classes.astype(np.int64)
        self.class_log = np.log10(np.maximum(sums[:, 0] + 0.5 * (sums[:, 1] + np.bincount(ending_class, minlength=n - 1)), 0.5))
        self.ending_log = self.class_log[ending_class]
        self.word = self.log_half - self.class_log[classes]
        self.end_base = float(np.log10(texts + 0.5)) - self.base_of_all


def _score(model: Brown):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = model.which[model.end_unit]
        for batch in batches:
            for lo, words in _texts(batch.column(3)):
                n, h, ending = len(words.count), words.hashes(), _endings(words).astype(np.int64)
                at = np.searchsorted(model.hashes, h)
                at[at == len(model.hashes)] = 0
                here = model.hashes[at] == h if len(model.hashes) else np.zeros(len(h), bool)
                base = np.where(here, model.log_half[at], 0.0) - model.base_of_all if len(model.hashes) else np.full(len(h), -model.base_of_all)
                word = np.where(here, model.word[at], 0.0) if len(model.hashes) else np.zeros(len(h))
                # -1 is the class of a word that isn't in the local table: its count and class come by a join.
                classes = np.where(here, model.which[model.unit[at]], -1) if len(model.hashes) else np.full(len(h), -1)
                seq = _with_ends(words, classes, end)
                before, after = np.concatenate([[end], seq[:-1]]), np.append(seq[1:], end)
                both = (before >= 0) & (seq >= 0)
                step = np.bincount(np.repeat(np.arange(n), words.count + 1), np.where(both, model.step[before, seq], 0.0), n)
                score = step + np.bincount(words.doc, word, n)
                base = np.bincount(words.doc, base, n) + model.end_base
                known = np.bincount(words.doc, here, n).astype(np.int64) + (model.texts > 0)
                away = np.flatnonzero(~here)
                place = away + words.doc[away]
                offsets = pa.array(np.searchsorted(words.doc[away], np.arange(n + 1)).astype(np.int32))
                entries = pa.StructArray.from_arrays([pa.array(h[away].view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (ending[away], before[place], after[place]))], ["h", "ending", "before", "after"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, n) for k in range(3)), pa.array(words.count + 1), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets, entries)],
                    ["row_id", "doc_id", "held_out", "n_tokens", "known", "base", "score", "away"],
                )

    return run


def _score_away(model: Brown):
    """The rest of the score: words that came by a join, in their order, and the steps to and from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            before, after, ending, n = (x.field(f).to_numpy() for f in ("before", "after", "ending", "n"))
            of = np.where(n > 0, x.field("class").to_numpy(), model.which[model.first_ending + ending])
            before = np.where(before >= 0, before, np.concatenate([of[:1], of[:-1]]))
            value = model.step[before, of] + np.where(after >= 0, model.step[of, after], 0.0) + np.log10(n + 0.5) - model.class_log[of]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.bincount(doc, v, len(lists))) for v in (value, np.log10(n + 0.5))), pa.array(np.bincount(doc, n > 0, len(lists)).astype(np.int64))], ["row_id", "more", "logs", "found"]
            )

    return run


def train(docs: DataFrame, may_learn: Column, text_col: str = "text") -> tuple[Brown, DataFrame]:
    """The model, and the counts and classes of all training words by hash (in the shared folder)."""
    texts = docs.filter(may_learn).select(text_of(text_col).alias("text"))
    counts = saved(texts.mapInArrow(_count, "h bigint, ending int, n bigint").groupBy("h").agg(F.sum("n").alias("n"), F.max("ending").alias("ending")), "brown-words")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_texts = texts.count()
    tokens = words + n_texts
    least = max(1.0, tokens / LOCAL)
    frequent = counts.filter(F.col("n") >= least).select("h", "n").toArrow()
    h, n = frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    top = np.sort(h[np.lexsort((h, -n))[: min(EXCHANGED, max(CLUSTERED, math.isqrt(distinct)))]])
    size = len(top) + 2
    rows = texts.mapInArrow(_pairs(top), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size)
    pairs[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    pairs = pairs.reshape(size, size)
    which = exchange(pairs, len(top))
    k = int(which[len(top)])
    one = np.zeros((size, k + 2))
    one[np.arange(size), which] = 1
    table = one.T @ pairs @ one
    kinds = "h bigint, cell int, next bigint, n bigint"
    near = texts.mapInArrow(_neighbours(top, which, False), kinds).repartition("h").groupBy("h", "cell").agg(F.sum("n").alias("n")).groupBy("h").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    vocabulary = saved(counts.join(near, "h", "left").select("h", "n", "ending", "cells").mapInArrow(_assign(table, top, which), "h bigint, n bigint, ending int, class int"), "brown-classes")
    removed(docs.sparkSession, counts)
    local = vocabulary.filter(F.col("n") >= least).select("h", "n", "class").toArrow()
    h, n, c = (local.column(x).to_numpy() for x in ("h", "n", "class"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, n, c = h[order], n[order], c[order]
    # Class bigrams: of words that workers have and ends, then with one of the other words, then of two.
    near = saved(texts.mapInArrow(_neighbours(h, np.concatenate([c.astype(np.int64), [k, k + 1]]), True), kinds), "brown-neighbours")
    classes = vocabulary.select("h", "class")
    place = np.append(np.arange(k + 1), k)  # the end takes the place of the words that were to be assigned
    final = np.zeros((k + 1, k + 1))
    for r in near.filter("h IS NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        final[place[r["cell"] // (k + 2)], place[r["cell"] % (k + 2)]] += r["n"]
    for r in near.filter("h IS NOT NULL AND cell IS NOT NULL").select("h", "cell", "n").join(classes, "h").groupBy("class", "cell").agg(F.sum("n").alias("n")).collect():
        other = r["class"] if r["cell"] == 2 * (k + 2) else place[r["cell"] % (k + 2)]
        pair = (r["class"], other)
        final[pair if r["cell"] < k + 2 or r["cell"] == 2 * (k + 2) else pair[::-1]] += r["n"]
    two = near.filter("next IS NOT NULL").select("h", "next", "n").join(classes, "h").select(F.col("class").alias("first"), F.col("next").alias("h"), "n")
    for r in two.join(classes, "h").groupBy("first", "class").agg(F.sum("n").alias("n")).collect():
        final[r["first"], r["class"]] += r["n"]
    removed(docs.sparkSession, near)
    sums, ending_words = np.zeros((k, 2)), np.zeros((ENDINGS, k))
    for r in vocabulary.groupBy("class", "ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        sums[r["class"]] += r["n"], r["words"]
        ending_words[r["ending"], r["class"]] += r["words"]
    ending_class = np.where(ending_words.any(1), ending_words.argmax(1), sums[:, 1].argmax())
    return Brown(tokens, distinct + (n_texts > 0), n_texts, (h, n, c), final, sums, ending_class), vocabulary


def score(docs: DataFrame, model: Brown, vocabulary: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the score, for each token).

    A null text counts as empty, and an empty text is its end alone. Repeated rows are scored each on its own. If nothing could be learned, every
    word is unknown. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    near = saved(rows.mapInArrow(_score(model), f"row_id bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, away array<struct<h:bigint,ending:int,before:int,after:int>>"), "brown-scores")
    away = near.select("row_id", F.posexplode("away").alias("pos", "x")).select("row_id", "pos", "x.*")
    entry = F.struct("pos", "ending", "before", "after", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    entries = away.join(vocabulary.select("h", "n", "class"), "h", "left").groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    sums = entries.mapInArrow(_score_away(model), "row_id bigint, more double, logs double, found bigint")
    logs = F.coalesce("logs", F.lit(0.0))
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return near.drop("away").join(sums, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 1, F.lit(False))
    model, vocabulary = train(docs, ~held_out)
    return score(docs, model, vocabulary, held_out)
