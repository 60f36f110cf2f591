"""Vector search by cells against measuring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.operators.cells import cells_topk
from seekspark.operators.vector import vector_topk
from tests.conftest import SF001


def _clustered(spark, seed=3, n=1500, copies=500):
    """Thirty far clusters, and one vector that a third of all rows repeat."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (30, 6))
    x = centres[rng.integers(0, 30, n)] + rng.normal(0, 0.3, (n, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, centres[0].tolist()) for i in range(copies)] + [(10 ** 6, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("pivots, block, query_rows", [(30, 100, 64), (1, 50, 10_000), (7, 10_000, 64)])
def test_same_as_all_pairs(spark, pivots, block, query_rows):
    emb = _clustered(spark)
    q = emb.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    q = q.unionByName(spark.createDataFrame([(-1, [99.0] * 6), (-2, None)], q.schema))
    counts = {}
    got = cells_topk(emb, q, 9, id_col="vec_id", pivots=pivots, block_rows=block, query_rows=query_rows, counts=counts)
    want = vector_topk(emb, q, 9, id_col="vec_id")
    cols = ["query_id", "vec_id", "rank"]
    assert got.count() == want.count() > 0 and got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    if pivots == 30:
        assert counts["measured"] < 0.6 * counts["all"]


def test_on_the_embeddings_and_beyond_the_corpus(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    cols = ["query_id", "vec_id", "rank"]
    got = cells_topk(emb, q, 12, id_col="vec_id", pivots=16, block_rows=40)
    want = vector_topk(emb, q, 12, id_col="vec_id")
    assert got.count() == want.count() and got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    few = emb.limit(3)
    assert cells_topk(few, q.limit(5), 12, id_col="vec_id").count() == 15          # fewer vectors than asked for
    assert cells_topk(emb.limit(0), q.limit(5), 12, id_col="vec_id").count() == 0


def test_tiles_of_queries_meet_chunks_of_blocks(spark):
    """what is sent to the far blocks grows with tiles x chunks, not with queries x blocks."""
    rng = np.random.default_rng(5)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (900, 8)))], "vec_id long, embedding array<double>")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    cols, counts = ["query_id", "vec_id", "rank"], {}
    got = cells_topk(emb, q, 12, id_col="vec_id", pivots=8, block_rows=20, query_rows=50, chunk_rows=200, counts=counts)
    want = vector_topk(emb, q, 12, id_col="vec_id")
    assert got.count() == want.count() == 900 * 12 and got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert counts["measured"] > 0 and counts["all"] == 900 * 900
