import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspark.llm import queries, resampling as R
from tests.conftest import SF001
from tests.llm import cases


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_features(text, longest):
    words = plain_words(text)
    return [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest, buckets, percent, min_words, seed):
    def counts(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, longest))
    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = plain_features(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(w) % buckets] for w in f)
        rows.append((i, len(plain_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[3]))
    drawn = may[:len(may) * percent // 100]
    return sorted([(*r, i) for i, r in enumerate(drawn, 1)] + [(*r, None) for r in may[len(drawn):]]
                  + [(*r, None) for r in rows if r[1] < min_words], key=str)


def test_words():
    @settings(max_examples=300, deadline=None, database=None)
    @given(st.one_of(st.text(max_size=40), st.text(alphabet="aZ09 \x00\x1c\x7f\x80é`@[{/:", max_size=20)))
    def run(t):
        t = t.encode("utf8", "ignore").decode()
        assert R.words_of(t) == plain_words(t)
    run()


@pytest.mark.parametrize("longest", [1, 2])
@pytest.mark.parametrize("head_words", [R.HEAD_WORDS, 40, 1])
def test_head_and_tail_give_the_same_buckets(spark, longest, head_words, monkeypatch):
    """Any head, full, small or empty, over all cases; against plain loops."""
    monkeypatch.setattr(R, "HEAD_WORDS", head_words)
    monkeypatch.setattr(R, "COUNTED", 50)
    monkeypatch.setattr(R, "GROUP_CHARS", 300)
    target = ["strange lights dance above the water", None, "word7 part3 seven wizards", ""]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    docs = cases.docs(spark).withColumnRenamed("words", "weight").withColumnRenamed("spans", "a.b").withColumnRenamed("hash", "score")
    for percent, min_words in ((40, 6), (10, 20), (100, 0)):
        got = R.resample(docs, items, longest=longest, buckets=97, percent=percent, min_words=min_words, seed=7).collect()
        want = plain(cases.TEXTS, target, longest, 97, percent, min_words, 7)
        assert [r[:5] for r in sorted(map(tuple, got), key=str)] == [r[:5] for r in want]
        # rows that repeat are alike but for their ranks
        assert sorted((str(r[:5]), r[5] or 0) for r in map(tuple, got)) == sorted((str(r[:5]), r[5] or 0) for r in want)


def test_head_is_bounded(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    known = R.head(docs, longest=2)
    every = Counter(w for r in docs.select("text").collect() for w in plain_words(r.text))
    assert len(known.words) <= R.HEAD_WORDS and len(known.pairs) <= R.HEAD_WORDS
    assert set(known.words) == {w for w, n in every.items() if n * R.HEAD_WORDS >= sum(every.values()) and len(w) <= R.HEAD_BYTES}
    assert R.Head([], [], 10).features([[b"a", b"b"], [], [b"a"]], 2)[1].tolist() == [0, 0, 2, 0]


def test_many_ranges_and_ties(spark):
    rows = [(i % 50, 30, 30, (i * 7919) % 13) for i in range(4000)]
    out = R.draw(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long"), 10, 20).collect()
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in out if r["rank"])
    assert len(out) == 4000 and [r[0] for r in ranked] == list(range(1, 401))
    assert [r[1:] for r in ranked] == sorted((-r.score, r.doc_id) for r in out)[:400]


def test_empty_tables(spark):
    docs, none = cases.docs(spark), spark.createDataFrame([], "text string")
    assert R.resample(cases.empty(spark), none).count() == 0
    assert R.resample(docs, none).count() == len(cases.TEXTS)
    assert R.gains(np.zeros(5, np.int64), np.zeros(5, np.int64)).tolist() == [0] * 5


def test_query_against_sql_and_loops(spark):
    out = queries.op11_target_resampling(spark, SF001)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(con.execute(queries.ORACLE["op11_target_resampling"]).fetchall(), key=str)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = plain(docs, items, 1, R.BUCKETS, R.PERCENT, R.MIN_WORDS, R.SEED)
    assert got == sorted([(r[0], *r[2:]) for r in want], key=str)
