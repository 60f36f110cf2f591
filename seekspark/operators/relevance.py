"""Relevance and ranking functions over candidate lists (REL-1..7, RNK-15, FIL-4/5).

All functions take a candidates DataFrame ``(query_id, doc_id, ...)``, the
query terms ``(query_id, term, mult, qlen)`` and a ``CorpusIndex``, and return
the candidates with one score column. Per-query statistics (average length,
local df) are computed over the candidate set, as the reference does; idf
from the corpus table where the reference reads its df table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import broadcast_if_small
from .index import CorpusIndex, candidate_cells

# Fixed values of the reference's rankers.
BM25_K1 = 1.5
BM25_B = 0.75
PROXIMITY_WEIGHT = 0.6
OKAPI_EPSILON = 0.25

QD = ["query_id", "doc_id"]


def _with_idf(cells: DataFrame, index: CorpusIndex, missing: float) -> DataFrame:
    """JOI-6: idf of each query term, ``missing`` when the corpus lacks it."""
    terms = cells.select("term").distinct()
    idf = index.dfs.select("term", "idf").join(broadcast_if_small(terms), "term")
    return cells.join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(float(missing))))


def quorum_relevance(cands: DataFrame, qterms: DataFrame, index: CorpusIndex, kind: str = "idf",
                     col: str = "relevance", cells: DataFrame | None = None) -> DataFrame:
    """REL-1 (``vanilla``), REL-2 (``idf``), REL-3 (``tfidf``).

    vanilla: share of distinct query words present in the doc.
    idf:     sum(idf * mult * [present]) / sum(idf * mult), idf missing -> 1.
    tfidf:   sum(mult * tf/dl * idf) / sum(mult * mult/qlen * idf).
    A zero denominator gives null (the reference's NaN), which no threshold keeps.
    """
    cells = cells if cells is not None else candidate_cells(cands, qterms, index)
    if kind == "vanilla":
        agg = F.try_divide(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).cast("double"),
                           F.count(F.lit(1)).cast("double"))
    else:
        cells = _with_idf(cells, index, missing=1.0)
        if kind == "idf":
            num = F.sum(F.when(F.col("tf") > 0, F.col("mult") * F.col("idf")).otherwise(0.0))
            den = F.sum(F.col("mult") * F.col("idf"))
        elif kind == "tfidf":
            num = F.sum(F.when(F.col("tf") > 0, F.col("mult") * F.col("tf") / F.col("dl") * F.col("idf"))
                        .otherwise(0.0))
            den = F.sum(F.col("mult") * F.col("mult") / F.col("qlen") * F.col("idf"))
        else:
            raise ValueError(kind)
        agg = F.when(den != 0, num / den)
    scores = cells.groupBy(*QD).agg(agg.alias(col))
    return _empty_queries_zero(cands.join(scores, QD, "left"), qterms, col)


def _empty_queries_zero(out: DataFrame, qterms: DataFrame, col: str) -> DataFrame:
    # candidates of a query without tokens score 0, as in the reference
    has = qterms.select("query_id").distinct().withColumn("__has", F.lit(True))
    out = out.join(broadcast_if_small(has), "query_id", "left")
    return out.withColumn(col, F.when(F.col("__has").isNull(), F.lit(0.0)).otherwise(F.col(col))).drop("__has")


def quorum_filter(scored: DataFrame, threshold: float, col: str = "relevance", strict: bool = True) -> DataFrame:
    """FIL-4 (``rel > t``) or FIL-5 (``rel >= t``, ``strict=False``)."""
    c = F.col(col)
    return scored.filter(c > threshold if strict else c >= threshold)


def _bm25_term(tf, dl, avgdl, idf, k1, b):
    norm = 1 - b + b * (dl / avgdl)
    return F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * norm)).otherwise(0.0)


def bm25(cands: DataFrame, qterms: DataFrame, index: CorpusIndex, variant: str = "global",
         k1: float = BM25_K1, b: float = BM25_B, col: str = "score", cells: DataFrame | None = None) -> DataFrame:
    """REL-4 (``global``: idf from the corpus table, missing -> 0),
    REL-5 (``local``: ``ln(N/(df+1)+1)`` over the candidate set),
    REL-7 (``okapi``: ``ln(N-df+.5)-ln(df+.5)`` over the candidates' whole
    vocabulary, negative idf -> epsilon * mean idf).

    Query duplicates count once per occurrence; ``avgdl`` is the mean length
    of the query's candidates. An empty candidate list gives no rows.
    """
    cells = cells if cells is not None else candidate_cells(cands, qterms, index)
    per_q = cells.select(*QD, "dl").distinct().groupBy("query_id").agg(
        F.avg("dl").alias("avgdl"), F.count(F.lit(1)).cast("double").alias("n_cand"))
    cells = cells.join(per_q, "query_id")
    if variant == "global":
        cells = _with_idf(cells, index, missing=0.0)
    elif variant == "local":
        ldf = cells.groupBy("query_id", "term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("ldf"))
        cells = cells.join(ldf, ["query_id", "term"]) \
            .withColumn("idf", F.log(F.col("n_cand") / (F.col("ldf") + 1.0) + 1.0))
    elif variant == "okapi":
        cells = cells.join(_okapi_idf(cands, index), ["query_id", "term"], "left") \
            .withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    else:
        raise ValueError(variant)
    term = _bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), k1, b)
    scores = cells.groupBy(*QD).agg(F.sum(F.col("mult") * term).alias(col))
    return cands.join(scores, QD, "left").withColumn(col, F.coalesce(col, F.lit(0.0)))


def _okapi_idf(cands: DataFrame, index: CorpusIndex) -> DataFrame:
    """Per query: idf of every term of its candidates' vocabulary (BM25Okapi)."""
    pairs = cands.select(*QD).distinct()
    docs = broadcast_if_small(pairs.select("doc_id").distinct())
    vocab = index.postings.select("doc_id", "term").join(docs, "doc_id").join(pairs, "doc_id")
    n = pairs.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    dfq = vocab.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df")).join(n, "query_id")
    raw = dfq.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    avg = raw.groupBy("query_id").agg(F.avg("idf").alias("avg_idf"))
    return raw.join(avg, "query_id").select(
        "query_id", "term",
        F.when(F.col("idf") < 0, OKAPI_EPSILON * F.col("avg_idf")).otherwise(F.col("idf")).alias("idf"))


def proximity(cands: DataFrame, qterms: DataFrame, index: CorpusIndex, col: str = "proximity",
              cells: DataFrame | None = None) -> DataFrame:
    """RNK-15: ``1/(1+d)``, d = least distance between positions of two
    query-term slots in the doc, 0 when no pair exists.

    A repeated query term present in the doc gives d = 0. Otherwise the least
    distance between different terms is reached by two neighbours in position
    order, so one ``lag`` over the sorted positions finds it: no pairs.
    """
    cells = (cells if cells is not None else candidate_cells(cands, qterms, index, positions=True)) \
        .filter(F.col("tf") > 0)
    dup = cells.filter(F.col("mult") >= 2).select(*QD).distinct().withColumn("dup", F.lit(True))
    occ = cells.select(*QD, "term", F.explode("positions").alias("pos"))
    w = Window.partitionBy(*QD).orderBy("pos")
    adj = (occ.withColumn("prev_pos", F.lag("pos").over(w)).withColumn("prev_term", F.lag("term").over(w))
           .filter(F.col("prev_term").isNotNull() & (F.col("prev_term") != F.col("term")))
           .groupBy(*QD).agg(F.min(F.col("pos") - F.col("prev_pos")).alias("d")))
    dist = adj.join(dup, QD, "full").select(
        *QD, F.when(F.col("dup"), F.lit(0)).otherwise(F.col("d")).alias("d"))
    out = cands.join(dist, QD, "left")
    return out.withColumn(col, F.when(F.col("d").isNull(), F.lit(0.0)).otherwise(1.0 / (1.0 + F.col("d")))).drop("d")


def bm25_proximity(cands: DataFrame, qterms: DataFrame, index: CorpusIndex, variant: str = "global",
                   weight: float = PROXIMITY_WEIGHT, col: str = "score", cells: DataFrame | None = None) -> DataFrame:
    """REL-6: BM25 + weight * proximity (``variant='local'`` is the older
    notebook's class, with candidate-local idf)."""
    cells = cells if cells is not None else candidate_cells(cands, qterms, index, positions=True)
    s = bm25(cands, qterms, index, variant, col="bm25", cells=cells)
    p = proximity(cands.select(*QD), qterms, index, cells=cells).select(*QD, "proximity")
    return s.join(p, QD).withColumn(col, F.col("bm25") + weight * F.col("proximity"))


def quorum_topk(qterms: DataFrame, index: CorpusIndex, blocks, k: int, kind: str = "idf", col: str = "relevance",
                least: float | None = None) -> DataFrame:
    """The retrieval form of REL-1/2: for every question the ``k`` documents of the corpus with the largest
    quorum relevance, ties by id: ``(query_id, doc_id, relevance)``.

    Documents sharing no term score 0 and are not listed. ``blocks`` is the corpus's ``TermBlocks``: words too
    common to lift a document into the first ``k`` are never paired with their documents. With ``least``, documents of
    less relevance are not wanted, and some or all of them are left out."""
    from .blocks import top_by_parts
    if kind == "idf":
        qt = qterms.join(broadcast_if_small(index.dfs.select("term", "idf")
                                            .join(broadcast_if_small(qterms.select("term").distinct()), "term")),
                         "term", "left").withColumn("w", F.col("mult") * F.coalesce("idf", F.lit(1.0)))
    elif kind == "vanilla":
        qt = qterms.withColumn("w", F.lit(1.0))
    else:
        raise ValueError(kind)
    den = broadcast_if_small(qt.groupBy("query_id").agg(F.sum("w").alias("den")))
    shares = qt.join(den, "query_id").select("query_id", "term", F.when(F.col("den") != 0, F.col("w") / F.col("den")).otherwise(0.0).alias("w"))
    found = top_by_parts(shares, blocks, k, parts=False, least=least)
    return found.join(den, "query_id").select(*QD, F.when(F.col("den") != 0, F.col("score")).alias(col))
