"""The grid of settings against one search for each configuration."""

import pytest
from pyspark.sql import functions as F

from seekspark.operators.evaluate import score_and_time
from seekspark.plans import evaluation, stores
from seekspark.plans import queries as Q
from seekspark.plans.grid import BUILT_IN, NONE, rank_grid
from seekspark.plans.search import SearchOptions, prepare, search
from tests.conftest import SF001

CONFIGS = [(0, NONE, NONE, 0.0, 1.0, 5), (1, "BM25", NONE, 0.3, 1.0, 20), (2, "Quorum", "BM25", 0.0, 0.1, 20),
           (3, NONE, "Quorum", 0.3, 0.5, 5), (4, "BM25", "BM25", 0.99, 0.1, 5)]


@pytest.fixture(scope="module")
def asked(spark):
    q = evaluation.styled_questions(spark.read.parquet(f"{SF001}/benchmark.parquet").filter("item_id < 6"))
    return q.select((F.col("item_id") * 4 + F.when(F.col("file") == "whole", 0).when(F.col("file") == "thinned", 1)
                     .when(F.col("file") == "vague", 2).otherwise(3)).alias("query_id"), "query")


def _grid(spark, asked, rows, **kw):
    configs = spark.createDataFrame(rows, "config_id int, ranker string, ranker2 string, threshold double, part double, k int")
    out = rank_grid(prepare(asked), stores.corpus_index(spark, SF001), Q._doc_vectors(spark, SF001), configs, **kw)
    return {(r.config_id, r.query_id, r.doc_id): (r["rank"], round(r.score, 6)) for r in out.collect()}


def test_grid_is_the_search_of_each_configuration(spark, asked):
    got = _grid(spark, asked, CONFIGS)
    for i, ranker, ranker2, threshold, part, k in CONFIGS:
        opt = SearchOptions(k=k, threshold=threshold, ranker=BUILT_IN.get(ranker), ranker2=BUILT_IN.get(ranker2), part=part)
        one = search(asked, stores.corpus_index(spark, SF001), Q._doc_vectors(spark, SF001), opt)
        want = {(i, r.query_id, r.doc_id): (r["rank"], round(r.score, 6)) for r in one.collect()}
        assert {x: v for x, v in got.items() if x[0] == i} == want, i
    assert {i for i, *_ in got} >= {0, 1, 2, 3}


def test_a_scorer_of_ones_own(spark, asked):
    def longest_first(cands, asked, index, cells):
        return cands.join(index.lengths, "doc_id").withColumn("score", F.col("dl").cast("double")).drop("dl")
    got = _grid(spark, asked, [(0, "CrossEncoder", NONE, 0.0, 1.0, 20)], scorers={"CrossEncoder": longest_first})
    by_query = {}
    for (_, q, d), (rank, score) in got.items():
        by_query.setdefault(q, []).append((rank, score))
    assert by_query and all([s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by_query.values())
    with pytest.raises(ValueError):
        _grid(spark, asked, [(0, "BiEncoder", NONE, 0.0, 1.0, 20)])


def test_labelled_questions_go_through_files(spark):
    q = evaluation.labelled_questions(spark, SF001).collect()
    n = spark.read.parquet(f"{SF001}/benchmark.parquet").count()
    assert sorted({r.query_id for r in q}) == list(range(4 * n)) and {r.file for r in q} == set(evaluation.STYLES)
    assert any(r.doc_id is None for r in q) and all((r.doc_id is None) == (r.page == "nowhere") for r in q)


def test_score_and_time(spark):
    positions = spark.createDataFrame([(1, 1, 0, 0), (1, 2, -1, 5), (2, 1, 5, 5)], "config_id int, query_id int, pos_strong int, pos_light int")
    spent = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, 2, 7.0), (3, 1, 9.0)], "config_id int, query_id int, seconds double")
    rows = {r.config_id: tuple(r)[1:] for r in score_and_time(positions, spent).collect()}
    assert rows == {1: (2, 0.5, 0.75, 5.0, 2.0, 2), 2: (1, 0.5, 0.5, None, None, 0)}
