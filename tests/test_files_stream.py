import os

from pyspark.sql import functions as F

from seekspark.sources import files as FS
from tests.conftest import SF001


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_labelled_reader(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "mix.txt"), "##\nhttp://u#A\n#\nвопрос один?\n##\nhttp://v\n#\nдва")
    rows = FS.read_labelled_queries(spark, tmpdir_path).orderBy("query_id").collect()
    assert [(r.real_url, r.query) for r in rows] == [("http://u#A", "вопрос один?"), ("http://v", "два")]


def test_generated_reader(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "w.txt"), '##\nhttp://a\n#\n1. "Кто?"\n2. \'Где?\'\n3. Как\nx\n')
    rows = [r.query for r in FS.read_generated_queries(spark, tmpdir_path).collect()]
    assert rows == ["Кто?", "Где?", "Как"]


def test_config_reader(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.txt")
    _write(p, "mix_1 mix_2 // d\nNone BM25 Foo // r\nNone // r2\n0 0.5 // t\n1.0\n20 50\ninv_5 bad // m\n")
    cfg = FS.read_config(spark, p)
    assert cfg["ranker"] == ["None", "BM25"] and cfg["threshold"] == [0.0, 0.5] and cfg["metrics"] == ["inv_5"]
    assert FS.config_grid(spark, cfg).count() == 2 * 1 * 2 * 1 * 2


def test_stage_log_parser(spark):
    lines = spark.createDataFrame([("in_top_5: 0.1",), ("кворум 27 0.01.",), ("векторная_бд 0.18.",)], "value string")
    rows = {r.stage: (r.n, r.seconds) for r in FS.parse_stage_log(lines).collect()}
    assert rows == {"кворум": (27, 0.01), "векторная_бд": (None, 0.18)}


def test_read_dump(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "AA")
    os.makedirs(d)
    _write(os.path.join(d, "wiki_00"), '<doc id="1" url="http://x">\nA\n</doc>\n<doc id="2" url="http://y">\nB\n</doc>\n')
    arts = FS.read_dump(spark, tmpdir_path).collect()
    assert len(arts) == 2 and all(a.article.startswith("<doc id=") for a in arts)


def test_stream_ingestion_equals_batch(spark, tmpdir_path):
    from seekspark.streaming.ingest import ingest_pages, start_page_ingestion
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    inp = os.path.join(tmpdir_path, "in")
    pages.filter("page_id < 25").write.parquet(os.path.join(inp, "a"))
    pages.filter("page_id >= 25").write.parquet(os.path.join(inp, "b"))
    store = os.path.join(tmpdir_path, "store")
    q = start_page_ingestion(spark, inp + "/*", store, os.path.join(tmpdir_path, "progress"))
    q.awaitTermination(300)
    batch_store = os.path.join(tmpdir_path, "batch")
    ingest_pages(pages, batch_store)
    s = spark.read.parquet(store).select("url", "proc_article")
    b = spark.read.parquet(batch_store).select("url", "proc_article")
    assert s.count() == b.count() and s.exceptAll(b).count() == 0
    ids = sorted(r[0] for r in spark.read.parquet(store).select("doc_id").collect())
    assert ids == list(range(len(ids)))
    # replaying the same pages appends nothing
    assert ingest_pages(pages, store) == 0


def test_stream_answers_equal_batch(spark, tmpdir_path):
    from seekspark.plans import stores
    from seekspark.plans.queries import _doc_vectors
    from seekspark.plans.search import search
    from seekspark.sources import tables as S
    from seekspark.streaming.answer import start_answering
    idx = stores.corpus_index(spark, SF001)
    vecs = _doc_vectors(spark, SF001)
    qs = S.questions(spark, SF001).filter("query_id < 6")
    inp = os.path.join(tmpdir_path, "q")
    qs.union(qs).write.json(inp)           # every question twice
    out = os.path.join(tmpdir_path, "ans")
    start_answering(spark, inp, idx, vecs, out, os.path.join(tmpdir_path, "progress")).awaitTermination(300)
    got = spark.read.parquet(out).drop("batch")
    want = search(qs, idx, vecs)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_ingestion_does_not_depend_on_arrival(spark, tmpdir_path):
    """One url twice, one page twice, one id with two contents: in one batch or in several, the same sections."""
    from seekspark.streaming.ingest import PAGES_SCHEMA, ingest_pages
    base = spark.read.parquet(f"{SF001}/pages.parquet").limit(3).collect()
    rows = [tuple(r) for r in base] + [(900, base[0].url, base[0].html), (base[1].page_id, base[1].url, base[2].html)]
    rows = [(r[0], r[1], r[2]) for r in rows]
    one, many = os.path.join(tmpdir_path, "one"), os.path.join(tmpdir_path, "many")
    ingest_pages(spark.createDataFrame(rows + rows[:2], PAGES_SCHEMA), one)
    for batch in (rows[3:], rows[:1] + rows[3:4], rows[:3], rows):
        ingest_pages(spark.createDataFrame(batch, PAGES_SCHEMA), many)
    cols = ["page_id", "page_key", "section_no", "url", "article"]
    a, b = (spark.read.parquet(p).select(*cols) for p in (one, many))
    assert a.count() == b.count() == 5 and a.exceptAll(b).count() == 0


def test_ingestion_does_not_take_an_error_for_an_empty_store(spark, tmpdir_path):
    import pytest
    from seekspark.streaming.ingest import PAGES_SCHEMA, ingest_pages
    pages = spark.read.parquet(f"{SF001}/pages.parquet").limit(2).select("page_id", "url", "html")
    store = os.path.join(tmpdir_path, "broken")
    os.makedirs(store)
    _write(os.path.join(store, "part-0.parquet"), "not parquet")
    with pytest.raises(Exception):
        ingest_pages(spark.createDataFrame(pages.collect(), PAGES_SCHEMA), store)


def test_answers_reach_every_question_and_survive_a_replay(spark, tmpdir_path):
    from seekspark.plans import stores
    from seekspark.plans.queries import _doc_vectors
    from seekspark.plans.search import search
    from seekspark.sources import tables as S
    from seekspark.streaming.answer import answer_batch
    idx, vecs = stores.corpus_index(spark, SF001), _doc_vectors(spark, SF001)
    one = S.questions(spark, SF001).filter("query_id = 1")
    twice = one.unionByName(one.withColumn("query_id", F.lit(2).cast("long")))
    out = os.path.join(tmpdir_path, "batch=7")
    for _ in range(2):
        answer_batch(twice, idx, vecs, out)
    want = search(one, idx, vecs).select("doc_id", "rank").collect()
    got = spark.read.parquet(out)
    for n in (1, 2):
        assert sorted(map(tuple, got.filter(F.col("query_id") == n).select("doc_id", "rank").collect())) == sorted(map(tuple, want))


def test_short_passages_are_found(spark, tmpdir_path):
    from seekspark.plans.queries import passage_truth
    docs = [(1, "xx alpha beta yy"), (2, "alphabeta"), (3, "gamma delta epsilon zeta"), (4, "preDelta epsilon zetas, gamma"),
            (5, "one")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, "
                          "source string, n_chars long").write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    items = [(10, "alpha beta"), (11, "elta epsilon zeta"), (12, "one"), (13, "no such words here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(tmpdir_path, "benchmark.parquet"))
    got = sorted((r.query_id, r.doc_id) for r in passage_truth(spark, tmpdir_path).collect())
    assert got == sorted((i, d) for i, p in items for d, t in docs if p in t)
