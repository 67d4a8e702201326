"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is described by how its byte classes follow each other and how its words repeat, and encoded
by a small network; gated attention weighs the passages, and the weighted mean is scored. Encoder, attention and classifier are trained together from
the documents' labels alone (numpy, Adam).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_order, remainder, table
from .vectors import Words, chunks, mixed64

PASSAGE, HIDDEN, ATTENTION = 64, 32, 16
#: Labelled documents in the training sample at most; epochs, documents in a step, rate, decay.
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 4000, 30, 64, 3e-3, 1e-4

#: Byte classes: lower, upper, digit, blank, line end, stop, comma, other marks, symbols, brackets and quotes, first and later bytes of other characters.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".", ",", "!?;:-", "#$%&*+/<=>@\\^_`|~", "()[]{}\"'")
KINDS = 12
_KIND = np.full(256, 8, np.int64)
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[0xC0:] = 10
_KIND[0x80:0xC0] = 11
FEATURES = KINDS * KINDS + 7


def passages(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document of each) of the passages of some texts, in order; a text without words is one passage."""
    words = Words(raws)
    n_docs, n_words = len(raws), len(words.start)
    per_doc = np.maximum(1, -(-words.count // PASSAGE))
    first = np.cumsum(per_doc) - per_doc  # of each document's passages
    doc = np.repeat(np.arange(n_docs), per_doc)
    n = len(doc)
    within = np.arange(n_words) - words.first[words.doc]
    of_word = first[words.doc] + within // PASSAGE
    # A passage reaches from its first word to the next passage's; a document's first begins with the document.
    begin = np.empty(n, np.int64)
    begin[first] = words.doc_start
    opening = (within % PASSAGE == 0) & (within > 0)
    begin[of_word[opening]] = words.start[opening]
    length = np.diff(np.append(begin, len(words.buf)))
    kind = _KIND[words.buf]
    code = np.repeat(np.arange(n), length)[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
    own = np.ones(len(code), bool)
    own[words.doc_end[:-1] - 1] = False  # no pair reaches into the next text
    code = code[own]
    x = np.zeros((n, FEATURES), np.float32)
    pairs = np.bincount(code, minlength=n * KINDS * KINDS).reshape(n, -1)
    x[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(length, 1)[:, None])
    h = words.hashes()
    count = np.bincount(of_word, minlength=n)
    safe = np.maximum(count, 1)
    size = (words.end - words.start).astype(float)
    mean = np.bincount(of_word, size, n) / safe
    x[:, -7] = mean / 10
    x[:, -6] = np.sqrt(np.maximum(np.bincount(of_word, size * size, n) / safe - mean * mean, 0)) / 10
    x[:, -5] = count / PASSAGE
    if n_words:
        same = np.zeros(n_words, bool)
        same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
        x[:, -4] = np.bincount(of_word, same, n) / safe
        x[:, -3] = np.bincount(of_word[_firsts(h ^ mixed64(of_word.astype(np.uint64)))], minlength=n) / safe
        three = h.copy()
        three[1:] += np.where(within[1:] >= 1, mixed64(h[:-1]), np.uint64(0))
        three[2:] += np.where(within[2:] >= 2, mixed64(mixed64(h[:-2])), np.uint64(0))
        fresh = _firsts(three ^ mixed64(words.doc.astype(np.uint64)))
        x[:, -2] = np.bincount(of_word[fresh], minlength=n) / safe
    x[:, -1] = np.log1p(count)
    return x, doc


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Where each code occurs first."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Weights by name. Bags are given as passages' features with, for each, the number of its bag (in order, none empty)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def new(mean: np.ndarray, scale: np.ndarray, bias: float, rng: np.random.Generator) -> Model:
        def dense(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        return Model({"mean": mean, "scale": scale, "w1": dense(len(mean), HIDDEN), "b1": np.zeros(HIDDEN), "v": dense(HIDDEN, ATTENTION), "u": dense(HIDDEN, ATTENTION), "a": rng.normal(0, 0.1, ATTENTION), "c": rng.normal(0, 0.1, HIDDEN), "b": np.array(bias)})

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.w
        x = (x - w["mean"]) * w["scale"]
        h = np.tanh(x @ w["w1"] + w["b1"])
        t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (t * g) @ w["a"]
        starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag - bag[0]])
        attention = e / np.add.reduceat(e, starts)[bag - bag[0]]
        z = np.add.reduceat(attention[:, None] * h, starts)
        return z @ w["c"] + w["b"], (x, h, t, g, attention, z, starts)

    def step(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        w = self.w
        logit, (x, h, t, g, attention, z, starts) = self.forward(x, bag)
        d = (_sigmoid(logit) - y) / len(y)
        dz = d[:, None] * w["c"]
        each = dz[bag]
        da = (each * h).sum(1)
        de = attention * (da - np.add.reduceat(attention * da, starts)[bag])
        dtg = de[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (attention[:, None] * each + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        return {"c": z.T @ d, "b": d.sum(), "a": (t * g).T @ de, "v": h.T @ dt, "u": h.T @ dg, "w1": x.T @ dh, "b1": dh.sum(0)}

    def scores(self, texts) -> np.ndarray:
        out = []
        for raws in chunks(texts):
            x, doc = passages(raws)
            out.append(_sigmoid(self.forward(x, doc)[0]))
        return np.concatenate(out) if out else np.zeros(0)


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
    """Trains on bags of passages' features."""
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=float) for b in bags) / n
    spread = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / n)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model.new(mean, 1 / np.maximum(spread, 1e-2), np.log(share / (1 - share)), rng)
    if len(np.unique(y)) < 2:
        model.w["c"] = np.zeros(HIDDEN)  # nothing to tell apart
        return model
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    steps, total = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = order[lo : lo + BATCH]
            bag = np.repeat(np.arange(len(rows)), [len(bags[r]) for r in rows])
            steps += 1
            rate = RATE * (1 - (steps - 1) / total)
            for k, g in model.step(np.concatenate([bags[r] for r in rows]), bag, y[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = model.w[k] * (1 - rate * DECAY) - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [passages([(text.as_py() or "").encode("utf-8", "surrogatepass")])[0].astype("<f2").tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from all passages of at most ``sample`` labelled documents, those of the smallest hashes of the id.

    Without labels every score is 0.5; with labels of one kind, near it. Labels other than 0 and 1 and labels without a document are passed over; a
    document with two labels counts with both, and of documents with the same id one counts.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("labelled_id"), F.col("quality").cast("int").alias("quality"))
    chosen = F.broadcast(usable.distinct().orderBy(id_order(F.col("labelled_id")), "labelled_id", "quality").limit(sample))  # at most `sample` rows
    joined = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(chosen, F.col("own_id") == F.col("labelled_id"))
    one = joined.groupBy("labelled_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("quality", "one.text")
    rows = sorted(one.mapInArrow(_features, "quality int, bag binary").collect(), key=lambda r: (r["quality"], bytes(r["bag"])))
    if rows:
        return fit([np.frombuffer(r["bag"], "<f2").reshape(-1, FEATURES) for r in rows], np.array([r["quality"] for r in rows], float))
    rng = np.random.default_rng(0)
    model = Model.new(np.zeros(FEATURES), np.ones(FEATURES), 0.0, rng)
    model.w["c"] = np.zeros(HIDDEN)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for each row. Null and empty texts are one passage without words; repeated rows are scored
    alike; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return inner.mapInArrow(run, f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(F.coalesce(remainder(3) != 1, F.lit(False))))
    return score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
