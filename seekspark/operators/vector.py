"""Vector search and vector maths (RNK-1/2, MAT-1/2, REL-10, EVA-10, ING-4).

Exact top-k by squared L2 distance. The corpus is never shuffled whole:
each partition multiplies blocks of its vectors by tiles of the query
matrix, keeps a running top-k per query and yields it once, at its end; one
window over ``query_id`` then picks the global top-k from those few rows.
The block of distances alive at a time has at most ``BLOCK_CELLS`` cells.
The query batch is the bounded side: tiles of at most ``max_query_rows``
rows, exactly numbered, reach the tasks one after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import materialize, top_k
from .ingest import dense_ids

MAX_QUERY_ROWS = 20_000      # query vectors sent to the tasks at once
BLOCK_CELLS = 1 << 21        # distances that a task holds at once
ROUND_KEY = 9                # distance digits that decide the order (then id)


def similarity(d2) -> Column:
    """MAT-1: ``1/(1+4*D^2)`` where D is the squared distance a flat L2
    index returns, i.e. ``1/(1+4*d^4)`` in Euclidean d; range (0, 1]."""
    d = F.col(d2) if isinstance(d2, str) else d2
    return 1.0 / (1.0 + 4.0 * d * d)


def l2_normalize(v) -> Column:
    """MAT-2: the vector divided by its L2 norm (zero vector unchanged)."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a, b) -> Column:
    """REL-10: cosine of two vectors as one Column expression."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, na * nb)


def _merge(old, ids: np.ndarray, d2: np.ndarray, k: int):
    """Running top-k ``(rounded distance, id, distance)`` of some queries with a block
    of new distances merged in; best first, ties by id."""
    both = (np.round(d2, ROUND_KEY), np.broadcast_to(ids, d2.shape), d2)
    if old is not None:
        both = tuple(np.concatenate([x, y], axis=1) for x, y in zip(old, both))
    order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in both)


def _partial_topk_fn(qids: np.ndarray, qmat: np.ndarray, k: int, id_col: str, vec_col: str, shard_col):
    step = max(1, min(len(qids), 512))
    tiles = [slice(i, min(i + step, len(qids))) for i in range(0, len(qids), step)]
    width = max(1, BLOCK_CELLS // step)

    def run(batches):
        qn = (qmat * qmat).sum(axis=1)
        best = {}
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            shards = [(None, pdf)] if shard_col is None else pdf.groupby(shard_col, sort=False)
            for shard, part in shards if len(pdf) else ():
                own = best.setdefault(shard, {t.start: None for t in tiles})
                for at in range(0, len(part), width):
                    block = part.iloc[at:at + width]
                    x, ids = np.stack(block[vec_col].to_numpy()).astype(np.float64), block[id_col].to_numpy()
                    xn = (x * x).sum(axis=1)
                    for t in tiles:
                        d2 = qn[t, None] + xn[None, :] - 2.0 * (qmat[t] @ x.T)
                        own[t.start] = _merge(own[t.start], ids, np.maximum(d2, 0.0, out=d2), k)
        for shard, own in best.items():
            for t in tiles:
                key, ids, d2 = own[t.start]
                out = {"query_id": np.repeat(qids[t], key.shape[1]), id_col: ids.reshape(-1), "d2": d2.reshape(-1),
                       "d2_key": key.reshape(-1)}
                if shard_col is not None:
                    out[shard_col] = np.full(key.size, shard)
                yield pd.DataFrame(out)
    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id",
                vec_col: str = "embedding", qvec_col: str = "embedding", shard_col: str | None = None,
                max_query_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """RNK-1 (and RNK-2 with ``shard_col``): for every query the ``k``
    nearest corpus vectors by squared L2 distance, ties by id.

    Returns ``(query_id, <id_col>, d2, rank)`` (``rank`` from 1; with a
    shard column, ``k`` per shard and ``shard`` in the output).
    """
    spark = corpus.sparkSession
    id_type = dict(corpus.dtypes)[id_col]
    q_type = dict(queries.dtypes)["query_id"]
    cols = [id_col, vec_col] + ([shard_col] if shard_col else [])
    schema = f"query_id {q_type}, {id_col} {id_type}, d2 double, d2_key double" + (
        f", {shard_col} {dict(corpus.dtypes)[shard_col]}" if shard_col else "")
    asked = queries.select("query_id", F.col(qvec_col).alias("v")).filter("v IS NOT NULL")
    n_q = asked.count()
    if n_q > max_query_rows:
        asked = materialize(dense_ids(asked, ["query_id"], id_col="tile_row"))
    parts = []
    for first in range(0, n_q, max_query_rows):
        tile = asked if n_q <= max_query_rows else asked.filter(
            (F.col("tile_row") >= first) & (F.col("tile_row") < first + max_query_rows))
        rows = tile.select("query_id", "v").collect()    # at most max_query_rows, by their numbers
        fn = _partial_topk_fn(np.array([r[0] for r in rows]), np.array([np.asarray(r[1], dtype=np.float64) for r in rows]),
                              k, id_col, vec_col, shard_col)
        found = corpus.select(*cols).mapInPandas(fn, schema)
        # more than one tile: written at once, so that the driver holds one tile at a time
        parts.append(found if n_q <= max_query_rows else materialize(found))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int").drop("d2_key")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    part_cols = ["query_id"] + ([shard_col] if shard_col else [])
    return top_k(out, part_cols, [F.col("d2_key"), F.col(id_col)], k, "rank").drop("d2_key")


def sharded_topk(corpus: DataFrame, queries: DataFrame, k: int, shards: int, id_col: str = "doc_id",
                 shard_col: str = "shard", **kw) -> DataFrame:
    """RNK-2: ``int(k/shards)`` nearest from every shard, concatenated per
    query, with one global rank over the union (distance, then id)."""
    per = int(k / shards)
    hits = vector_topk(corpus, queries, per, id_col=id_col, shard_col=shard_col, **kw).drop("rank")
    return top_k(hits, ["query_id"], [F.round("d2", ROUND_KEY), F.col(id_col)], None, "rank")


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Unit-length mean vector of each group: ``(group, embedding)``; one vector
    aggregate, partial in every task."""
    mean = Summarizer.mean(array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))
    arr = vectors.filter(F.col(vec_col).isNotNull()).groupBy(group_col).agg(mean.alias("m"))
    return arr.select(group_col, vector_to_array("m").alias("v")).select(group_col, l2_normalize("v").alias(vec_col))


def hashed_tf_vectors(postings: DataFrame, id_col: str = "doc_id", dim: int = 64) -> DataFrame:
    """ING-4 default encoder: hashed term counts, L2-normalised, dense.

    bucket = first 8 hex digits of md5(term) mod ``dim``. The norm comes
    from the sparse (doc, bucket) sums, so the dense array is built once
    from already normalised values. A user encoder replaces this through
    ``encode_with`` (a pandas function per batch).
    """
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sparse = postings.select(id_col, bucket.alias("b"), "tf").groupBy(id_col, "b") \
        .agg(F.sum("tf").cast("double").alias("v"))
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"),
                                   F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("norm"))
    return m.select(id_col, dense.alias("embedding"))


def encode_with(df: DataFrame, text_col: str, make_encoder, dim: int, id_col: str = "doc_id") -> DataFrame:
    """UDF-1 plug point: ``make_encoder()`` is called once in each task and gives
    ``encoder(list[str]) -> np.ndarray (n, dim)``, run on Arrow batches."""
    def run(batches):
        encoder = make_encoder()
        for pdf in batches:
            emb = np.asarray(encoder(pdf[text_col].tolist()), dtype=np.float64)
            norms = np.linalg.norm(emb, axis=1, keepdims=True)
            emb = np.where(norms > 0, emb / np.where(norms > 0, norms, 1), emb)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(emb)})
    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, embedding array<double>")
