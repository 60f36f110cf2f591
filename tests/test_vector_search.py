import numpy as np
from pyspark.sql import functions as F

from seekspark.operators import vector as V
from seekspark.operators.textsearch import conditions, fuse, normalize_text_scores
from tests.conftest import SF001


def test_similarity_golden(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "d double")
    assert [round(r[0], 6) for r in df.select(V.similarity("d")).collect()] == [1.0, 0.5, 0.2]


def test_vector_topk_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    q = emb.filter(F.col("label") == 3).select(F.col("vec_id").alias("query_id"), "embedding")
    got = V.vector_topk(emb, q, 5, id_col="vec_id").collect()
    pdf = emb.toPandas()
    X = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    for qid, qv in q.toPandas().itertuples(index=False):
        d2 = ((X - np.asarray(qv, dtype=np.float64)) ** 2).sum(1)
        want = [ids[i] for i in np.lexsort((ids, np.round(d2, 9)))[:5]]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.rank)]
        assert mine == want


def test_tiles_blocks_and_null_vectors_change_nothing(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding")
    emb = emb.unionByName(spark.createDataFrame([(10 ** 6, None)], emb.schema))
    q = emb.filter("vec_id < 25 OR vec_id = 1000000").select(F.col("vec_id").alias("query_id"), "embedding")
    cols = ["query_id", "vec_id", "rank"]
    want = V.vector_topk(emb, q, 6, id_col="vec_id").select(*cols)
    assert want.count() == 25 * 6
    monkeypatch.setattr(V, "BLOCK_CELLS", 100)
    got = V.vector_topk(emb, q, 6, id_col="vec_id", max_query_rows=7).select(*cols)
    assert got.count() == 25 * 6 and got.exceptAll(want).count() == 0


def test_partition_yields_at_most_k_for_each_query(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").repartition(3)
    q = emb.limit(4).select(F.col("vec_id").alias("query_id"), "embedding").collect()
    fn = V._partial_topk_fn(np.array([r.query_id for r in q]), np.array([r.embedding for r in q], dtype=float), 5,
                            "vec_id", "embedding", None)
    out = emb.select("vec_id", "embedding").mapInPandas(fn, "query_id long, vec_id long, d2 double, d2_key double")
    assert out.count() <= 3 * 4 * 5


def test_plug_points_build_their_model_once_a_task(spark):
    from seekspark.operators.rerank import score_with

    def make_scorer():
        calls = []

        def scorer(queries, docs):
            calls.append(len(docs))
            return [len(q) + 10 * len(d) for q, d in zip(queries, docs)]
        return scorer
    pairs = spark.createDataFrame([(1, "ab", "xyz"), (2, "", "q")], "doc_id long, query string, text string")
    assert sorted((r.doc_id, r.score) for r in score_with(pairs, make_scorer).collect()) == [(1, 32.0), (2, 10.0)]
    vecs = V.encode_with(pairs, "text", lambda: lambda texts: [[len(t), 0.0] for t in texts], 2).collect()
    assert sorted((r.doc_id, r.embedding) for r in vecs) == [(1, [1.0, 0.0]), (2, [1.0, 0.0])]


def test_sharded_topk_takes_k_div_shards(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").withColumn("shard", F.pmod("vec_id", F.lit(3)).cast("int"))
    q = emb.limit(2).select(F.col("vec_id").alias("query_id"), "embedding")
    out = V.sharded_topk(emb, q, 7, 3, id_col="vec_id")
    per = out.groupBy("query_id", "shard").count().collect()
    assert all(r["count"] == 2 for r in per) and len(per) == 6


def test_conditions_counts(spark):
    w = spark.createDataFrame([(3, ["a", "b", "c"]), (2, ["a", "b"]), (1, ["a"]), (0, [])],
                              "query_id long, words array<string>")
    got = {r.query_id: r["count"] for r in conditions(w).groupBy("query_id").count().collect()}
    assert got == {3: 6, 2: 3, 1: 1}
    lv = conditions(w).filter("query_id = 3").orderBy("level", "start").collect()
    assert [(r.level, r.start, sorted(r.terms)) for r in lv] == [
        (0, 0, ["a", "b", "c"]), (1, 0, ["a", "b"]), (1, 1, ["b", "c"]), (2, 0, ["a"]), (2, 1, ["b"]), (2, 2, ["c"])]


def test_text_score_norm_and_fusion(spark):
    h = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (1, 12, 3.0)], "query_id long, doc_id long, score double")
    n = {r.doc_id: round(r.text_score, 6) for r in normalize_text_scores(h).collect()}
    assert n == {10: 0.04, 11: 0.44, 12: 0.84}
    v = spark.createDataFrame([(1, 12, 0.5), (1, 13, 0.9)], "query_id long, doc_id long, similarity double")
    f = {r.doc_id: (round(r.fused, 6), r.fused_rank) for r in fuse(v, normalize_text_scores(h), 3).collect()}
    assert f == {12: (1.34, 1), 13: (0.9, 2), 11: (0.44, 3)}
