"""What a task holds, and how much work meets, as the input grows."""

import os

import numpy as np
from pyspark.sql import functions as F

from seekspark.operators import blocks as B
from seekspark.operators.index import CorpusIndex
from seekspark.plans import features
from seekspark.sources import tables as S


def _store(spark, n=600):
    """Words of very unequal frequency."""
    rng = np.random.default_rng(2)
    word = lambda i: "w" + "".join(chr(97 + (i // 26 ** j) % 26) for j in range(3))
    docs = [(i, " ".join(word(int(x)) for x in np.minimum(rng.zipf(1.3, 30), 5000))) for i in range(n)]
    return docs, B.TermBlocks.build(CorpusIndex.build(spark.createDataFrame(docs, "doc_id long, text string")), block=8, shard_docs=50)


def _asked(spark, docs):
    rows = [(i, w, 1.0 / len(set(t.split()))) for i, t in docs[:60] for w in set(t.split())]
    return spark.createDataFrame(rows, "query_id long, term string, w double")


def test_text_is_dealt_out_by_its_size(spark, monkeypatch):
    """F3 to F7, F10, F12, F13: parts of a given size of text, not merged into larger ones as the input grows."""
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(S, "SPREAD_BYTES", 10_000)
    dealt = S.spread(df, "doc_id")
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and dealt.rdd.getNumPartitions() == 20
    assert sorted(r.doc_id for r in dealt.collect()) == list(range(200))
    assert S.spread(df.limit(0), "doc_id").count() == 0


def test_wanted_score_spares_pairs(spark):
    """F1: with a least score a question meets only documents of its rarest words; nothing wanted is lost."""
    docs, store = _store(spark)
    weights, plain, spared = _asked(spark, docs), {}, {}
    every = B.top_by_parts(weights, store, 3, parts=False, plain_pairs=0, counts=plain).filter("score > 0.6").collect()
    some = B.top_by_parts(weights, store, 3, parts=False, plain_pairs=0, counts=spared, least=0.6).filter("score > 0.6").collect()
    key = lambda rows: {(r.query_id, r.doc_id, round(r.score, 9)) for r in rows}
    assert key(some) == key(every) and len(some) >= 60 and spared["paired"] < 0.5 * plain["all"]


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """F15 to F21: blocks are dealt out by the pairs they make."""
    docs, store = _store(spark)
    weights = _asked(spark, docs)
    want = B.top_by_parts(weights, store, 5).collect()
    monkeypatch.setattr(B, "TASK_PAIRS", 500)
    assert B._in_tasks(store.blocks, 5000).rdd.getNumPartitions() == 10 and B._in_tasks(store.blocks, None) is store.blocks
    for plain in (0, 10 ** 9):
        got = B.top_by_parts(weights, store, 5, plain_pairs=plain).collect()
        assert {(r.query_id, r.doc_id, round(r.score, 8)) for r in got} == {(r.query_id, r.doc_id, round(r.score, 8)) for r in want}


def test_equal_tokens_are_stemmed_once(spark, tmpdir_path, monkeypatch):
    """F8: the stemmer sees each token once, the counts are those of all."""
    spark.createDataFrame([(i, "alpha beta alpha gamma") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    seen, own = [], features.with_stem
    monkeypatch.setattr(features, "with_stem", lambda df, *a: seen.append(df.count()) or own(df, *a))
    out = features.q_cyrillic_stems(spark, tmpdir_path)
    assert out.agg(F.sum("n")).first()[0] == 200 and seen == [3]


def test_documents_that_cannot_reach_the_bound_are_dropped_early(spark, monkeypatch, tmpdir_path):
    """with few pairs on disk at once and few words looked up at a time the answers stay those of scoring all, and
    the tables of a group are gone when it is answered."""
    docs, store = _store(spark)
    weights = _asked(spark, docs)
    key = lambda rows: {(r.query_id, r.doc_id, round(r.score, 8)) for r in rows}
    want = {least: key(B.top_by_parts(weights, store, 3, parts=False, plain_pairs=10 ** 9, least=least).collect()) for least in (None, 0.45)}
    rows, own, folders = [], B._complete, []
    monkeypatch.setattr(B, "TASK_PAIRS", 50)
    monkeypatch.setattr(B, "GROUP_PAIRS", 8000)
    monkeypatch.setattr(B, "_complete", lambda sums, *a: rows.append((sums.count(), len(a) > 4)) or own(sums, *a))
    monkeypatch.setattr(B, "scratch_path", lambda s, name: folders.append(f"{tmpdir_path}/{name}") or folders[-1])
    for least in (None, 0.45):
        rows.clear()
        got = key(B.top_by_parts(weights, store, 3, parts=False, plain_pairs=0, least=least).collect())
        assert {x for x in got if x[2] > (least or 0) + 1e-6} == {x for x in want[least] if x[2] > (least or 0) + 1e-6}
        narrowed = [n for n, early in rows if early]
        assert narrowed and sum(n for n, early in rows if not early) < sum(narrowed)
    assert len(folders) > 2 and not any(os.path.exists(f) for f in folders)
