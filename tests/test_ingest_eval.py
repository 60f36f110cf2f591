from pyspark.sql import functions as F

from seekspark.operators import evaluate as E
from seekspark.operators.ingest import dense_ids, sections, split_articles
from seekspark.operators.rerank import cascade, rank_by


def _sections(spark, emit_last):
    docs = spark.createDataFrame([(1, "u", "T", ["p1", "H1.", "a", "b", "H2.", "H3.", "c"])],
                                 "page_id long, url string, title string, lines array<string>")
    heads = spark.createDataFrame([(1, ["H1.", "H2.", "H3."])], "page_id long, headings array<string>")
    return sections(docs, heads, emit_last=emit_last).orderBy("section_no").collect()


def test_sections_golden(spark):
    got = _sections(spark, True)
    assert [(r.url, r.article) for r in got] == [("u", "T.  p1"), ("u#H1", "T. H1. a b"), ("u#H3", "T. H3. c")]
    assert [r.url for r in _sections(spark, False)] == ["u", "u#H1"]


def test_dense_ids_contiguous(spark):
    df = spark.range(0, 1000, 3).select(F.col("id").alias("k"))
    ids = dense_ids(df, ["k"], start=10, id_col="doc_id").orderBy("k").collect()
    assert [r.doc_id for r in ids] == list(range(10, 10 + len(ids)))


def test_split_articles(spark):
    d = spark.createDataFrame([("f", 'pre<doc id="1" url="http://a">\nA\n</doc><doc id="2">\nB\n</doc>')],
                              "file string, value string")
    arts = [r.article for r in split_articles(d).orderBy("article_no").collect()]
    assert arts == ["<doc id=pre", '<doc id="1" url="http://a">\nA\n</doc>', '<doc id="2">\nB\n</doc>']


def test_metrics_golden(spark):
    df = spark.createDataFrame([(-1,), (0,), (4,), (5,)], "p int")
    inv = [round(r[0], 6) for r in df.select(E.metric("inv_5", "p")).collect()]
    top = [r[0] for r in df.select(E.metric("in_top_5", "p")).collect()]
    assert inv == [0.0, 1.0, round(5 / 9, 6), 0.5] and top == [0.0, 1.0, 1.0, 0.0]


def test_light_match(spark):
    res = spark.createDataFrame([(1, 7, "u", 1)], "query_id long, doc_id long, page string, rank int")
    truth = spark.createDataFrame([(1, 8, "u")], "query_id long, doc_id long, page string")
    r = E.match_positions(res, truth).first()
    assert (r.pos_strong, r.pos_light) == (-1, 0)


def test_roc_golden(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "score double, label int")
    pts = [(r.fpr, r.tpr) for r in E.roc_curve(df).orderBy(F.col("score").asc_nulls_first()).collect()]
    assert pts == [(1.0, 1.0), (0.5, 1.0), (0.5, 0.5), (0.0, 0.5), (0.0, 0.0)]
    assert abs(E.roc_auc(E.roc_curve(df)).first()[0] - 0.75) < 1e-12


def test_cascade_sizes(spark):
    rows = [(1, d, float(100 - d)) for d in range(50)] + [(2, d, float(100 - d)) for d in range(5)]
    c = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    ranked = rank_by(c, "score")

    def second(x):
        return x.withColumn("score2", F.col("doc_id").cast("double"))
    out = cascade(ranked, "rank", second, 0.1)
    n = {r.query_id: r["count"] for r in out.groupBy("query_id").count().collect()}
    assert n == {1: 6, 2: 5}
    top = out.filter("query_id = 1 AND final_rank = 1").first()
    assert top.doc_id == 5


def test_negative_pairs_shape(spark):
    pairs = spark.createDataFrame([(f, r, f"q{f}{r}", 100 * f + r) for f in range(9) for r in range(3)],
                                  "file int, row_no int, query string, doc_id long")
    out = E.negative_pairs(pairs)
    assert out.filter("relevant = 1").count() == 27 and out.filter("relevant = 0").count() == 27
    neg = out.filter("relevant = 0 AND doc_id = 0").first()
    assert neg.query.startswith("q5") and neg.query != "q52"


def test_whole_articles_and_lookup(spark):
    from seekspark.operators.ingest import long_enough, lookup_text, whole_articles
    rows = [(1, '<doc id="1" url="http://a">\nTitle here\n\nFirst line\nsecond the line\n</doc>\n'), (2, "no blank line"), (3, None)]
    arts = spark.createDataFrame(rows, "article_no long, article string")
    got = {r.article_no: (r.url, r.title, r.article, r.proc_article) for r in whole_articles(arts, ["the"]).collect()}
    assert got[1] == ("http://a", "Title here", "First linesecond the line", "first linesecond line")
    assert got[2][:3] == ("", "", "no blank line")
    assert [r.article_no for r in long_enough(arts, "article", 20).collect()] == [1]
    meta = spark.createDataFrame([(7, "u", "A", "p", "s")], "doc_id long, url string, article string, proc_article string, "
                                                            "stem_article string")
    ids = meta.select("doc_id")
    assert lookup_text(ids, meta).first().text == "p" and lookup_text(ids, meta, stemmed=True).first().text == "s"


def test_stores_that_differ(spark):
    from seekspark.operators.ingest import store_consistency
    v, m = (spark.createDataFrame([(i,) for i in ids], "doc_id long") for ids in ((1, 2, 3, 5), (2, 3, 4)))
    assert tuple(store_consistency(v, m).first()) == (4, 3, 2, 2, 1)
