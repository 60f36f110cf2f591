"""Term blocks and the pruned top-k against scoring every document."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.operators import blocks as B
from seekspark.operators.index import CorpusIndex
from seekspark.operators.textsearch import conditions, relaxed_and_search


def corpus(seed, n=400, vocabulary=120):
    """Words of very unequal frequency: some stand in nearly every document, most in a few."""
    rng = np.random.default_rng(seed)
    names = ["".join(chr(97 + (i * 7 + j * 3) % 26) for j in range(3)) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(vocabulary)]
    p = 1 / np.arange(1, vocabulary + 1) ** 1.1
    p /= p.sum()
    return {i: [names[w] for w in rng.choice(vocabulary, rng.integers(0, 40), p=p)] for i in range(n)}, names


def index_of(spark, docs):
    return CorpusIndex.build(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string"))


def plain_parts(docs):
    df = Counter(w for t in docs.values() for w in set(t))
    avgdl = sum(map(len, docs.values())) / len(docs)
    return {i: {w: (math.log(len(docs) / (df[w] + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                for w, tf in Counter(t).items()} for i, t in docs.items()}


@pytest.fixture(scope="module")
def made(spark):
    docs, names = corpus(1)
    index = index_of(spark, docs)
    return docs, names, index, B.TermBlocks.build(index, block=8, shard_docs=50)


def test_blocks_hold_every_posting_in_order(made):
    docs, _, _, store = made
    want = plain_parts(docs)
    rows = store.blocks.collect()
    got = {(d, r.term): p for r in rows for d, p in zip(r.docs, r.parts)}
    assert len(got) == sum(len(r.docs) for r in rows) == sum(map(len, want.values()))
    assert all(abs(got[d, w] - p) < 1e-9 for d, parts in want.items() for w, p in parts.items())
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.block):
        assert r.size == len(r.docs) <= 8 and r.top == r.parts[0] == max(r.parts)
        lists[r.term, r.shard] += r.parts
    assert all(p == sorted(p, reverse=True) for p in lists.values())
    assert max(shard for _, shard in lists) > 0      # the most common words are cut into shards
    stats = {r.term: (r.df, r.top) for r in store.stats.collect()}
    assert stats == {t: (sum(len(r.docs) for r in rows if r.term == t), max(r.top for r in rows if r.term == t)) for t in stats}


@pytest.mark.parametrize("parts", [True, False])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_k_equals_scoring_all(spark, made, parts, k):
    """Long and short questions, of common words only, of unknown words, with weight 0 and with ties."""
    docs, names, _, store = made
    rng = np.random.default_rng(4)
    asked = [(q, w, float(rng.choice([0.0, 0.5, 1.0, 3.0]))) for q in range(40)
             for w in rng.choice(names[:6] if q % 4 == 0 else names, rng.integers(1, 6 if q % 4 == 0 else 25), replace=False)]
    asked += [(50, "nowhere", 1.0), (51, "nowhere", 1.0), (51, names[0], 1.0)]
    weights = spark.createDataFrame(asked, "query_id long, term string, w double")
    want, every = set(), plain_parts(docs)
    for q in {a[0] for a in asked}:
        score = Counter()
        for _, w, x in (a for a in asked if a[0] == q):
            for d, p in every.items():
                if w in p:
                    score[d] += x * (p[w] if parts else 1.0)
        want |= {(q, d, round(s, 6)) for d, s in sorted(score.items(), key=lambda i: (-round(i[1], 9), i[0]))[:k]}
    for plain in (0, 10 ** 9):
        out = B.top_by_parts(weights, store, k, parts=parts, plain_pairs=plain).collect()
        assert {(r.query_id, r.doc_id, round(r.score, 6)) for r in out} == want and len(out) == len(want)


def test_common_words_are_not_paired(spark):
    """A word of nearly all documents beside rare ones: its documents never meet the question."""
    docs = {i: ["common", "usual"] + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"] for i in range(3000)}
    store = B.TermBlocks.build(index_of(spark, docs))
    weights = spark.createDataFrame([(q, w, 1.0) for q in range(5) for w in ("common", "usual", f"rare{chr(97 + q)}a", f"rarea{chr(97 + q)}")],
                                    "query_id long, term string, w double")
    counts = {}
    out = B.top_by_parts(weights, store, 2, plain_pairs=0, counts=counts).collect()
    assert len(out) == 10 and counts["all"] > 30_000 and counts["paired"] < 100


def test_blocks_below_the_kth_score_are_skipped(spark):
    """Only common words asked: the blocks of largest parts decide, the others are not read out."""
    rng = np.random.default_rng(9)
    docs = {i: ["alpha"] * int(rng.integers(1, 30)) + ["beta"] * int(rng.integers(1, 30)) for i in range(4000)}
    store = B.TermBlocks.build(index_of(spark, docs), block=32)
    weights = spark.createDataFrame([(1, "alpha", 1.0), (1, "beta", 0.01)], "query_id long, term string, w double")
    counts = {}
    got = B.top_by_parts(weights, store, 5, plain_pairs=0, counts=counts).collect()
    every = plain_parts(docs)
    want = sorted(((-round(p["alpha"] + 0.01 * p["beta"], 9), d) for d, p in every.items()))[:5]
    assert sorted((-round(r.score, 9), r.doc_id) for r in got) == want
    assert counts["paired"] < counts["all"]


def test_few_terms_reach_the_scan_as_a_filter(spark, made, tmpdir_path):
    _, names, index, _ = made
    path = os.path.join(tmpdir_path, "index")
    index.write(path)
    back = CorpusIndex.read(spark, path)
    assert back.blocks.blocks.count() == index.blocks.blocks.count()
    lists = back.blocks.of_terms(spark.createDataFrame([(names[3],), (names[70],)], "term string"), 2)
    assert "PushedFilters: [In(term" in lists._jdf.queryExecution().toString()
    conds = conditions(spark.createDataFrame([(1, [names[0], names[3], names[70]])], "query_id long, words array<string>"))
    a, b = (relaxed_and_search(conds, i.blocks).collect() for i in (index, back))
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_empty_corpus_and_empty_questions(spark, made):
    store = B.TermBlocks.build(index_of(spark, {1: []}))
    weights = spark.createDataFrame([(1, "word", 1.0)], "query_id long, term string, w double")
    assert B.top_by_parts(weights, store, 3, plain_pairs=0).count() == 0
    assert B.top_by_parts(weights.filter(F.lit(False)), made[3], 3, plain_pairs=0).count() == 0
