"""RNK-16: batch hybrid search as one lazy plan.

questions -> (vector top-k  +  relaxed-AND text search) -> additive fusion
-> first k -> metadata lookup -> quorum filter -> ranker -> optional cascade
-> ordered urls / answers. A whole table of questions is answered at once;
every step is partitioned by ``query_id`` (the fix of the reference's
mixing of questions in one flat list).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stop_words
from ..operators import relevance as R
from ..operators.index import CorpusIndex, candidate_cells, query_terms
from ..operators.rerank import cascade, rank_by
from ..operators.textsearch import (DEPTH, conditions, fuse, normalize_text_scores, question_words,
                                    relaxed_and_search)
from ..operators.vector import hashed_tf_vectors, similarity, vector_topk
from ..util import materialize


@dataclass
class SearchOptions:
    k: int = 50                       # candidates kept after fusion
    threshold: float = 0.0            # quorum: keep relevance > threshold
    ranker: str | None = "bm25_proximity"
    ranker2: str | None = None
    part: float = 0.1                 # fraction re-ranked by ranker2
    depth: int = DEPTH
    use_text: bool = True
    use_vectors: bool = True
    dim: int = 64


def score_candidates(cands: DataFrame, qterms: DataFrame, index: CorpusIndex, ranker: str,
                     cells: DataFrame | None = None) -> DataFrame:
    """Candidates + ``score`` by a named built-in ranker (REL-1..7, REL-11:
    the quorum relevances can rank too). ``cells`` may pass the candidate x
    term matrix already built for these candidates (with positions)."""
    if ranker in ("bm25", "bm25_global"):
        return R.bm25(cands, qterms, index, "global", col="score", cells=cells)
    if ranker == "bm25_proximity":
        return R.bm25_proximity(cands, qterms, index, "global", col="score", cells=cells)
    if ranker == "bm25_local":
        return R.bm25_proximity(cands, qterms, index, "local", col="score", cells=cells)
    if ranker == "bm25_okapi":
        return R.bm25(cands, qterms, index, "okapi", col="score", cells=cells)
    if ranker in ("vanilla", "idf", "tfidf"):
        return R.quorum_relevance(cands, qterms, index, ranker, col="score", cells=cells)
    if ranker == "proximity":
        return R.proximity(cands, qterms, index, col="score", cells=cells)
    raise ValueError(ranker)


@dataclass
class SearchInputs:
    qterms: DataFrame       # (query_id, term, mult, qlen): cleaned without stop words, stemmed
    words: DataFrame        # (query_id, words): cleaned with Russian stop words, stemmed


def prepare(questions: DataFrame) -> SearchInputs:
    qt = query_terms(questions, "query_id", "query")
    words = materialize(question_words(questions, stop_list=stop_words("russian")))
    return SearchInputs(qt, words)


def vector_hits(inp: SearchInputs, doc_vectors: DataFrame, k: int, dim: int) -> DataFrame:
    qv = hashed_tf_vectors(inp.qterms.select(F.col("query_id").alias("doc_id"), "term",
                                             F.col("mult").alias("tf")), dim=dim) \
        .withColumnRenamed("doc_id", "query_id")
    hits = vector_topk(doc_vectors, materialize(qv), k, id_col="doc_id")
    return hits.withColumn("similarity", similarity("d2"))


def text_hits(inp: SearchInputs, index: CorpusIndex, depth: int) -> DataFrame:
    return normalize_text_scores(relaxed_and_search(conditions(inp.words, depth), index.blocks))


def fused_candidates(inp: SearchInputs, index: CorpusIndex, doc_vectors: DataFrame,
                     opt: SearchOptions) -> DataFrame:
    parts = []
    vh = vector_hits(inp, doc_vectors, opt.k, opt.dim) if opt.use_vectors else None
    th = text_hits(inp, index, opt.depth) if opt.use_text else None
    if vh is None:
        vh = th.limit(0).select("query_id", "doc_id", F.lit(0.0).alias("similarity"))
    if th is None:
        th = vh.limit(0).select("query_id", "doc_id", F.lit(0.0).alias("text_score"))
    parts.append(fuse(vh, th, opt.k))
    return materialize(parts[0])


def search(questions: DataFrame, index: CorpusIndex, doc_vectors: DataFrame,
           opt: SearchOptions | None = None, inputs: SearchInputs | None = None) -> DataFrame:
    """Answer a table of questions ``(query_id, query)``.

    Returns ``(query_id, doc_id, rank, score)``: the ranked documents kept by
    the quorum (and cut by the cascade when a second ranker is set).
    """
    opt = opt or SearchOptions()
    inp = inputs or prepare(questions)
    fused = fused_candidates(inp, index, doc_vectors, opt)
    # the candidate x query-term matrix is built once; the kept rows are a
    # semi-join of it, and every scorer reads it (the ranker's statistics
    # are then taken over the kept candidates only, as in the reference)
    cells = candidate_cells(fused, inp.qterms, index, positions=True)
    kept = materialize(R.quorum_filter(R.quorum_relevance(fused, inp.qterms, index, "idf", cells=cells),
                                       opt.threshold))
    kept_cells = cells.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if opt.ranker:
        ranked = rank_by(score_candidates(kept, inp.qterms, index, opt.ranker, cells=kept_cells),
                         "score", "fused_rank")
    else:   # no ranker: the fused order stands
        ranked = rank_by(kept.withColumn("score", F.col("fused")), "score")
    if opt.ranker2:
        def second(c):
            return score_candidates(c, inp.qterms, index, opt.ranker2).withColumnRenamed("score", "score2")
        first = ranked.select("query_id", "doc_id", "rank", "score")     # the second ranker makes columns of its own
        out = cascade(first, "rank", second, opt.part).drop("rank").withColumnRenamed("final_rank", "rank")
    else:
        out = ranked
    return out.select("query_id", "doc_id", "rank", "score")
