"""URL filter: rules by host and path; where none fits, host word segmentation and naive Bayes.

Host labels are split into words by Viterbi search under a unigram model of the words of the pages themselves. Multinomial naive Bayes over the words
of host and path is learned from all pages that a rule judges, and judges the others; a fixed list of words is its prior, as if each had been met
some times more in pages to block. Every word counts, however rare. The tables that workers get are bounded: words with at least a ``MOST``-th of all
counts are in them, of which there can't be more than ``MOST``, and for segmentation those of at most ``SHORT`` letters; the counts of all others come
by a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words of hosts to block, and others that names of such hosts are made of.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "escort", "gamble", "gambling", "jackpot", "loans", "lottery", "nude", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
NEIGHBOURS = ("blog", "buy", "cam", "cheap", "club", "example", "farm", "free", "hot", "live", "news", "online", "play", "shop", "site", "track", "web", "win", "www")
MOST = 50_000
#: Words of so few letters are always in the workers' table: there are at most 26 + 26^2 + 26^3.
SHORT = 3
#: The longest word, and the count that a fixed word has at least, as a share of all.
LONGEST, FIXED_SHARE = 24, 1e-5
#: Uses in pages to block that each word to block has beforehand.
SEED_USES = 5
#: Characters of a host whose parts are sought at once.
STRETCH = 4096

_FIXED = frozenset((*SEEDS, *NEIGHBOURS))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Adds rule and rule_verdict: the longest rule whose host is the url's or one above it, and with whose path the url's begins; else null."""
    fits = [F.when((F.col(host) == h) | F.col(host).endswith("." + h), F.col(path).startswith(p)) for h, p, _ in rules]
    longest = sorted(zip(fits, rules, strict=True), key=lambda x: -len(x[1][0] + x[1][1]))
    rule = F.coalesce(*[F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("rule_verdict"))) for fit, (h, p, v) in longest])
    return pages.withColumn("found_rule", rule).select("*", "found_rule.rule", "found_rule.rule_verdict").drop("found_rule")


class Unigrams:
    """Splits concatenated names into the likeliest words. An unknown piece costs more with each character."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: the sum of all counts, if ``counts`` has only some of the words; the others' are given to ``add`` before a name has them."""
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.floor = max(1.0, FIXED_SHARE * self.total)
        self.unknown = math.log(1 / (10 * self.total))
        self.log: dict[str, float] = {}
        self.add({w: counts.get(w, 0) for w in (*SEEDS, *NEIGHBOURS)})
        self.add(counts)

    def add(self, counts: dict[str, int]) -> None:
        fixed = len(SEEDS) + len(NEIGHBOURS)
        for w, n in counts.items():
            if len(w) <= LONGEST:
                n = max(float(n), self.floor) if w in _FIXED else float(n)
                self.log[w] = math.log(n / (self.total + self.floor * fixed))

    def split(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(max((best[lo][0] + self.log.get(name[lo:end], self.unknown - 2.0 * (end - lo)), -lo) for lo in range(max(0, end - LONGEST), end)))
        words, end = [], len(name)
        while end:
            lo = -best[end][1]
            words.append(name[lo:end])
            end = lo
        return words[::-1]


def pieces(host: str) -> list[str]:
    """What of a host is segmented or counts as #."""
    return re.findall(r"[^\W\d_]+|\d+", host)


def host_words(host: str, split) -> list[str]:
    """Words of the host's labels (segmented); digits count as #."""
    return [w for label in pieces(host) for w in (("#",) if label[0].isdigit() else split(label))]


def path_words(path: str) -> list[str]:
    """Words of the path, marked by a slash; digits count as #."""
    return ["/" + ("#" if w[0].isdigit() else w.lower()) for w in re.findall(r"[^\W\d_]+|\d+", path)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            held.update((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_NOT_LETTERS).split())
            if len(held) > 200_000:
                yield out(held)
                held = Counter()
    yield out(held)


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n: counts of all words of all pages' whole text, without tags; ASCII letters, lower case. Those of words that are too long for a name's
    are summed up under a null word. (In the shared folder.)"""
    text = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^>]*>", " ")
    counts = pages.select(text.alias("t")).mapInArrow(_count_words, "word string, n bigint")
    return saved(counts.groupBy(F.when(F.length("word") <= LONGEST, F.col("word")).alias("word")).agg(F.sum("n").alias("n")), "url-unigrams")


def _candidates(local: dict[str, int]):
    """Of each host its parts that could be words whose counts workers don't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column(0).to_pylist():
                for name in set(pieces(host)):
                    for at in range(0, len(name), STRETCH):  # a part begins in one stretch and may reach into the next
                        n = name[at : at + STRETCH + LONGEST]
                        parts = {n[lo:end] for lo in range(min(STRETCH, len(n))) for end in range(lo + SHORT + 1, min(lo + LONGEST, len(n)) + 1)}
                        parts = sorted(p for p in parts if p not in local and p.isascii() and p.isalpha())
                        yield pa.RecordBatch.from_arrays([pa.array([host] * len(parts), pa.string()), pa.array(parts, pa.string())], ["host", "word"])

    return run


def _split_hosts(local: dict[str, int], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams = Unigrams(local, total)
        for batch in batches:
            out = []
            for host, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = {x["word"]: x["n"] for x in found or ()}
                unigrams.add(more)
                out.append(host_words(host, unigrams.split))
                for w in more:
                    if w not in _FIXED:
                        del unigrams.log[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["host", "host_words"])

    return run


def segmented(hosts: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """host, host_words of different hosts, by the counts of all words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.filter(F.col("word").isNotNull())
    at_hand = (F.col("n") >= max(1, total / most)) | (F.length("word") <= SHORT) | F.col("word").isin(*sorted(_FIXED))
    local = {r["word"]: r["n"] for r in known.filter(at_hand).collect()}
    parts = hosts.mapInArrow(_candidates(local), "host string, word string").distinct()
    found = parts.join(known.filter(~at_hand), "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return hosts.join(found, "host", "left").select("host", "found").mapInArrow(_split_hosts(local, total), "host string, host_words array<string>")


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [h + path_words(p) for h, p in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.list_(pa.string()))], [*batch.schema.names[:4], "words"])


class Bayes:
    """Multinomial naive Bayes from {blocked: count} of all words, the number of different words, and {blocked: documents}."""

    def __init__(self, totals: dict[bool, int], vocabulary: int, documents: dict[bool, int]):
        smooth = {c: math.log(totals.get(c, 0) + vocabulary + 1) for c in (False, True)}
        self.each = smooth[False] - smooth[True]
        self.prior = math.log(documents.get(True, 0) + 1) - math.log(documents.get(False, 0) + 1)

    def weight(self, blocked: int, allowed: int) -> float:
        """What a word with these counts adds to the log odds to block."""
        return math.log(blocked + 1) - math.log(allowed + 1) + self.each


def _score(model: Bayes, local: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(4).to_pylist()
            base = [model.prior + sum(local.get(w, 0.0) for w in ws) for ws in words]
            away = [[w for w in ws if w not in local] for ws in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base, pa.float64()), pa.array(away, pa.list_(pa.string()))], [*batch.schema.names[:5], "base", "away"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, most: int = MOST) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, score (log odds to block), words.

    A null url and one without ``://`` have an empty host and path, which no rule fits, and are judged by the prior alone. Repeated pages are judged
    alike, each in its row. If no rule fits any page, only the words to block speak. An empty table gives no rows. Null html counts as empty. Other
    columns are not read. ``most`` bounds the tables of words that workers get, not what counts.
    """
    parsed = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = parsed.schema["page_id"].dataType.simpleString()
    hosts = segmented(parsed.select("host").distinct(), unigrams(pages, html_col), most)
    worded = parsed.join(hosts, "host").select("row_id", "page_id", "host", "path", "host_words").mapInArrow(_with_words, f"row_id bigint, page_id {kind}, host string, path string, words array<string>")
    rows = saved(worded, "url-words")
    learned = with_rules(rows, rules).filter("rule is not null").select("words", (F.col("rule_verdict") == "block").alias("block"))
    prior = pages.sparkSession.createDataFrame([(w, SEED_USES, 0) for w in SEEDS], "word string, blocked bigint, allowed bigint")
    met = learned.select(F.explode("words").alias("word"), "block").groupBy("word").agg(F.count_if("block").alias("blocked"), F.count_if(~F.col("block")).alias("allowed"))
    counts = saved(met.unionByName(prior).groupBy("word").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")), "url-counts")
    blocked, allowed, vocabulary = counts.agg(F.sum("blocked"), F.sum("allowed"), F.count(F.lit(1))).first()
    model = Bayes({True: blocked, False: allowed}, vocabulary, {r["block"]: r["count"] for r in learned.groupBy("block").count().collect()})
    at_hand = F.col("blocked") + F.col("allowed") >= max(1, (blocked + allowed) / most)
    local = {r["word"]: model.weight(r["blocked"], r["allowed"]) for r in counts.filter(at_hand).collect()}
    near = rows.mapInArrow(_score(model, local), f"row_id bigint, page_id {kind}, host string, path string, words array<string>, base double, away array<string>")
    weight = F.log(F.col("blocked") + 1.0) - F.log(F.col("allowed") + 1.0) + F.lit(model.each)
    away = near.select("row_id", F.posexplode("away").alias("pos", "word")).join(counts.filter(~at_hand), "word").select("row_id", F.struct("pos", weight.alias("weight")).alias("x"))
    # In the order of the words, so that sums don't depend on partitioning.
    sums = away.groupBy("row_id").agg(F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x["weight"]).alias("more"))
    scored = near.join(sums, "row_id", "left").withColumn("score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return with_rules(scored, rules).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "words")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
