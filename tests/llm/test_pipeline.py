import collections
import hashlib
import re

import corpus_pipeline
from cases import ROWS, table
from test_llm_operators import brute_near, brute_targets, check_pieces

from tidelane.llm.common import saved

DATA = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    read, lang, exact, near, mix, packed = stages(spark, docs)
    for df in (lang, exact, near, mix):
        assert df.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in lang.collect()}
    assert all(any(c.isalpha() for c in rows[k].text) for k in kept) and len(kept) >= 0.99 * len(rows)
    best = {}
    for k in kept:
        key = "".join(rows[k].text.split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None})
        mine = (-len(rows[k].text), k)
        best[key] = min(best.get(key, mine), mine)
    assert {r.doc_id for r in exact.collect()} == {k for _, k in best.values()}
    items = [(r.doc_id, r.text) for r in exact.collect()]
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in brute_near(items).values()}
    counts = collections.Counter(r.doc_id for r in mix.collect())
    assert counts == brute_mix(near.collect())
    pieces = packed.collect()
    whole = collections.Counter(r.doc_id for r in pieces if r.start == 0)
    assert whole == counts
    once = [r for r in pieces if counts[r.doc_id] == 1]
    seqs = {r.sequence_id for r in once}
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and seqs


def brute_mix(rows):
    """How often each document is taken: finish times one after another, cut where the total is passed."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append((int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), r.doc_id))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sums = [sum(size[d] for _, d in by[s]) for s in sources]
    targets = brute_targets(sums, [(5, 2, 1)[k % 3] for k in range(len(sources))])
    queue = []
    for no, source in enumerate(sources):
        upto = 0
        for order, d in sorted(by[source]):
            upto += size[d]
            queue += [((copy * sums[no] + upto) / targets[no], no, order, d, copy) for copy in range(3) if size[d]]
    out, so_far = collections.Counter(), 0
    for _, _, _, d, _ in sorted(queue):
        so_far += size[d]
        if so_far > sum(sums):
            break
        out[d] += 1
    return out


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    again = stages(spark, spark.read.parquet(f"{DATA}/documents.parquet"))[-1]  # a rerun takes the same documents as often
    pieces = lambda df: collections.Counter((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert pieces(out) == pieces(again)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_awkward_tables(spark):
    assert all(df.count() == 0 for df in stages(spark, table(spark, [])))
    every = stages(spark, table(spark, ROWS))
    assert [df.columns for df in every[1:-1]] == [every[0].columns] * 4 and every[1].count() < len(ROWS)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_join", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None and check_pieces
