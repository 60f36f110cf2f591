"""The registered queries: one function ``(spark, sf_dir) -> DataFrame`` each.

Every query reads the whole given tables. Scores are published rounded to 6
decimals; ranks order by the score rounded to 9 decimals, then by id, so a
last-bit difference of a floating sum never reorders equal documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import with_stem
from ..functions.text import clean_string, stop_words, word_count
from ..operators import relevance as R
from ..operators.blocks import TermBlocks, top_by_parts
from ..operators.index import CorpusIndex
from ..sources import tables as S
from ..util import broadcast_if_small, materialize, top_k
from . import stores

CAND_K = 50        # candidates per question for the re-rankers
TOP_K = 10         # length of a published top-k report
SHORT_BLOCK = 1000 # passages without an inner token that are looked for in one pass over the texts
QUORUM_T = 0.5     # default quorum threshold of the reference's filter


def rkey(c: str):
    return F.round(F.col(c), 9)


def _index(spark, sf) -> CorpusIndex:
    return stores.corpus_index(spark, sf)


def _qterms(spark, sf, stop_list=()) -> DataFrame:
    return stores.question_terms(spark, sf, tuple(stop_list))


def match_candidates(qterms: DataFrame, blocks: TermBlocks, k: int = CAND_K) -> DataFrame:
    """First stage: the ``k`` documents holding most distinct query words
    (exact integer counts, ties by doc_id): ``(query_id, doc_id, cand_rank)``.
    Words too common to lift a document into the first ``k`` are looked up, not paired."""
    found = top_by_parts(qterms.select("query_id", "term", F.lit(1.0).alias("w")), blocks, k, parts=False)
    return materialize(top_k(found, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, "cand_rank")
                       .select("query_id", "doc_id", "cand_rank"))


def _publish(df: DataFrame, score: str, rank: bool = True) -> DataFrame:
    out = df
    if rank:
        out = top_k(out, ["query_id"], [rkey(score).desc(), F.col("doc_id")], None, "rank")
    out = out.withColumn(score, F.round(score, 6)).withColumnRenamed("query_id", "item_id")
    cols = ["item_id", "doc_id", score] + (["rank"] if rank else [])
    return out.select(*cols)


# --- corpus and statistics ------------------------------------------------

def q_clean_tokens(spark, sf):
    d = S.documents(spark, sf)
    proc = clean_string("text")
    return d.select("doc_id", proc.alias("proc_article")).withColumn("proc_len", word_count("proc_article"))


def q_stopword_filter(spark, sf):
    d = S.documents(spark, sf)
    proc = clean_string("text", stop_words("russian", "english"))
    return d.select("doc_id", proc.alias("proc_article")).withColumn("proc_len", word_count("proc_article"))


def q_postings(spark, sf):
    p = _index(spark, sf).postings
    return p.select("doc_id", "term", "tf", "dl", F.element_at("positions", 1).alias("first_pos"),
                    F.element_at("positions", -1).alias("last_pos"))


def q_doc_lengths(spark, sf):
    idx = _index(spark, sf)
    avg = idx.lengths.select(F.avg("dl")).scalar()
    return idx.lengths.select("doc_id", "dl", F.round(F.col("dl") / avg, 6).alias("dl_rel"))


def q_doc_freq_idf(spark, sf):
    return _index(spark, sf).dfs.select("term", "df", F.round("idf", 6).alias("idf"))


# --- quorum relevance and re-rankers over first-stage candidates -----------

def _rerank_inputs(spark, sf):
    idx = _index(spark, sf)
    qt = _qterms(spark, sf)
    return idx, qt, match_candidates(qt, stores.term_blocks(spark, sf))


def q_quorum_search(spark, sf):
    hits = R.quorum_topk(_qterms(spark, sf), _index(spark, sf), stores.term_blocks(spark, sf), TOP_K, "idf")
    return _publish(hits, "relevance")


def q_bm25f_topk(spark, sf):
    """The documents with the largest sum of BM25F parts over a question's distinct words, blocks
    below the running k-th score skipped."""
    words = _qterms(spark, sf).select("query_id", "term", F.lit(1.0).alias("w"))
    return _publish(top_by_parts(words, stores.term_blocks(spark, sf), TOP_K, plain_pairs=0), "score")


def _quorum(kind):
    def q(spark, sf):
        idx, qt, cands = _rerank_inputs(spark, sf)
        return _publish(R.quorum_relevance(cands, qt, idx, kind), "relevance")
    q.__name__ = f"q_quorum_{kind}"
    return q


def q_quorum_filter(spark, sf):
    idx, qt, cands = _rerank_inputs(spark, sf)
    kept = R.quorum_filter(R.quorum_relevance(cands, qt, idx, "idf"), QUORUM_T)
    return _publish(kept, "relevance", rank=False)


def _bm25(variant, prox):
    def q(spark, sf):
        idx, qt, cands = _rerank_inputs(spark, sf)
        if prox:
            s = R.bm25_proximity(cands, qt, idx, variant)
        else:
            s = R.bm25(cands, qt, idx, variant)
        return _publish(s, "score")
    return q


def q_proximity(spark, sf):
    idx, qt, cands = _rerank_inputs(spark, sf)
    return _publish(R.proximity(cands, qt, idx), "proximity")


QUERIES = {
    "clean_tokens": q_clean_tokens,
    "stopword_filter": q_stopword_filter,
    "postings": q_postings,
    "doc_lengths": q_doc_lengths,
    "doc_freq_idf": q_doc_freq_idf,
    "quorum_search": q_quorum_search,
    "bm25f_topk": q_bm25f_topk,
    "quorum_vanilla": _quorum("vanilla"),
    "quorum_idf": _quorum("idf"),
    "quorum_tfidf": _quorum("tfidf"),
    "quorum_filter": q_quorum_filter,
    "bm25_global": _bm25("global", False),
    "bm25_local": _bm25("local", True),
    "bm25_okapi": _bm25("okapi", False),
    "proximity": q_proximity,
    "bm25_proximity": _bm25("global", True),
}


# --- vector search ----------------------------------------------------------

VEC_K = 20
SHARDS = 9


def _vec_inputs(spark, sf):
    from ..operators.vector import centroids
    emb = S.vectors(spark, sf)
    q = materialize(centroids(emb, "label").withColumnRenamed("label", "query_id"))
    return emb, q


def q_vector_topk(spark, sf):
    from ..operators.vector import vector_topk
    emb, q = _vec_inputs(spark, sf)
    hits = vector_topk(emb, q, VEC_K, id_col="vec_id")
    return hits.select("query_id", "vec_id", F.round("d2", 6).alias("d2"), "rank")


def q_vector_similarity(spark, sf):
    from ..operators.vector import similarity, vector_topk
    emb, q = _vec_inputs(spark, sf)
    hits = vector_topk(emb, q, VEC_K, id_col="vec_id")
    return hits.select("query_id", "vec_id", F.round(similarity("d2"), 6).alias("similarity"), "rank")


def q_vector_topk_sharded(spark, sf):
    from ..operators.vector import sharded_topk
    emb, q = _vec_inputs(spark, sf)
    emb = emb.withColumn("shard", F.pmod("vec_id", F.lit(SHARDS)).cast("int"))
    hits = sharded_topk(emb, q, 3 * SHARDS, SHARDS, id_col="vec_id")
    return hits.select("query_id", "vec_id", "shard", F.round("d2", 6).alias("d2"), "rank")


def q_cosine_rerank(spark, sf):
    from ..operators.vector import cosine, vector_topk
    emb, q = _vec_inputs(spark, sf)
    hits = vector_topk(emb, q, VEC_K, id_col="vec_id").select("query_id", "vec_id")
    scored = hits.join(emb.select("vec_id", F.col("embedding").alias("x")), "vec_id") \
        .join(broadcast_if_small(q.select("query_id", F.col("embedding").alias("qv"))), "query_id") \
        .withColumn("cosine", cosine("qv", "x"))
    ranked = top_k(scored, ["query_id"], [rkey("cosine").desc(), F.col("vec_id")], None, "rank")
    return ranked.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def q_vector_label_precision(spark, sf):
    """Share of each centroid's top-k that carries the centroid's label."""
    from ..operators.vector import vector_topk
    emb, q = _vec_inputs(spark, sf)
    hits = vector_topk(emb, q, VEC_K, id_col="vec_id").join(emb.select("vec_id", "label"), "vec_id")
    return hits.groupBy("query_id").agg(
        F.round(F.avg((F.col("label") == F.col("query_id")).cast("double")), 6).alias("precision"),
        F.count(F.lit(1)).alias("n"))


def q_self_recall(spark, sf):
    """EVA-10 over the whole store: is each vector its own nearest neighbour? Cells beyond a vector's
    reach are left out where the store is larger than one block of queries."""
    from ..operators.cells import nearest
    emb = S.vectors(spark, sf)
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = nearest(emb, q, 12, id_col="vec_id")
    self_rank = hits.filter(F.col("query_id") == F.col("vec_id")).select("query_id", "rank")
    per_q = q.select("query_id").join(self_rank, "query_id", "left")
    return per_q.agg(F.count(F.lit(1)).alias("n"),
                     F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("recall_at_1"),
                     F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall_at_12"))


QUERIES.update({
    "vector_topk": q_vector_topk,
    "vector_similarity": q_vector_similarity,
    "vector_topk_sharded": q_vector_topk_sharded,
    "cosine_rerank": q_cosine_rerank,
    "vector_label_precision": q_vector_label_precision,
    "self_recall": q_self_recall,
})


# --- full-text search, fusion, hybrid search, cascade, answers ----------------

def _search_inputs(spark, sf):
    from .search import prepare
    k = stores._key(spark, sf, "benchmark", "search_inputs")
    if k not in stores._CACHE:
        stores._CACHE[k] = prepare(S.questions(spark, sf))
    return stores._CACHE[k]


def _doc_vectors(spark, sf):
    from ..operators.vector import hashed_tf_vectors
    k = stores._key(spark, sf, "documents", "hashed_vectors")
    if k not in stores._CACHE:
        stores._CACHE[k] = materialize(hashed_tf_vectors(_index(spark, sf).postings))
    return stores._CACHE[k]


def q_relaxed_and_conditions(spark, sf):
    from ..operators.textsearch import conditions
    c = conditions(_search_inputs(spark, sf).words)
    return c.select(F.col("query_id").alias("item_id"), "level", "start", F.size("terms").alias("n_terms"),
                    F.array_join(F.array_sort("terms"), " ").alias("terms"))


def q_relaxed_and_search(spark, sf):
    from ..operators.textsearch import conditions, relaxed_and_search
    h = relaxed_and_search(conditions(_search_inputs(spark, sf).words), _index(spark, sf).blocks)
    return h.select(F.col("query_id").alias("item_id"), "level", "start", "doc_id",
                    F.round("score", 6).alias("score"), "hit_rank")


def q_text_score_norm(spark, sf):
    from .search import text_hits
    h = text_hits(_search_inputs(spark, sf), _index(spark, sf), 2)
    return h.select(F.col("query_id").alias("item_id"), "level", "start", "doc_id",
                    F.round("text_score", 6).alias("text_score"))


def _fused(spark, sf):
    from .search import SearchOptions, fused_candidates
    return fused_candidates(_search_inputs(spark, sf), _index(spark, sf), _doc_vectors(spark, sf), SearchOptions())


def q_hybrid_fusion(spark, sf):
    f = _fused(spark, sf)
    return f.select(F.col("query_id").alias("item_id"), "doc_id", F.round("fused", 6).alias("fused"), "fused_rank")


def q_metadata_lookup(spark, sf):
    from ..functions.text import fill_stub
    f = _fused(spark, sf)
    meta = S.doc_meta(spark, sf).select("doc_id", "url", "lang", "n_chars")
    out = f.join(broadcast_if_small(f.select("doc_id").distinct()).join(meta, "doc_id"), "doc_id", "left")
    return fill_stub(out.select(F.col("query_id").alias("item_id"), "fused_rank", "doc_id", "url", "lang", "n_chars"),
                     ["url", "lang"])


def _search(spark, sf, **kw):
    from .search import SearchOptions, search
    return search(None, _index(spark, sf), _doc_vectors(spark, sf), SearchOptions(**kw), _search_inputs(spark, sf))


def q_hybrid_search(spark, sf):
    r = _search(spark, sf)
    return r.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))


def q_cascade_rerank(spark, sf):
    """RNK-11 on the first-stage candidates: BM25, then BM25 + proximity on
    the first int(n * 0.1) + 1 of them."""
    from ..operators.rerank import cascade, rank_by
    idx, qt, cands = _rerank_inputs(spark, sf)
    ranked = rank_by(R.bm25(cands, qt, idx, "global"), "score", "cand_rank")

    def second(c):
        return R.bm25_proximity(c, qt, idx, "global", col="score2")
    out = cascade(ranked, "rank", second, 0.1)
    return out.select(F.col("query_id").alias("item_id"), "doc_id", "final_rank",
                      F.round("score", 6).alias("score"))


def q_answer_text(spark, sf):
    from ..operators.answer import answer_text, url_lists
    r = _search(spark, sf)
    meta = S.doc_meta(spark, sf).select("doc_id", "url")
    urls = url_lists(r.join(broadcast_if_small(r.select("doc_id").distinct()).join(meta, "doc_id"), "doc_id"))
    ans = answer_text(S.questions(spark, sf), urls)
    return ans.select(F.col("query_id").alias("item_id"), "response")


def q_summary_context(spark, sf):
    from ..operators.answer import summary_context
    r = _search(spark, sf)
    meta = S.doc_meta(spark, sf).select("doc_id", "article")
    top = r.filter(F.col("rank") <= 5)
    ctx = summary_context(top.join(broadcast_if_small(top.select("doc_id").distinct()).join(meta, "doc_id"),
                                   "doc_id"), S.questions(spark, sf))
    return ctx.select(F.col("query_id").alias("item_id"), "context")


def q_history_split(spark, sf):
    """JOI-4 over conversations: a request per conversation (its user turns
    joined by blank lines); the history maps a user turn to the assistant
    turn after it. Each question of a request is answered from the history
    or goes on to search."""
    from ..operators.answer import split_requests, use_history
    from pyspark.sql import Window
    conv = S.table(spark, sf, "conversations")
    users = conv.filter(F.col("role") == "user")
    req = users.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l")) \
        .select(F.col("conv_id").alias("request_id"), F.array_join(F.transform("l", lambda s: s["text"]), "\n\n")
                .alias("body"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conv.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    hist = nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")) \
        .select(F.col("text").alias("query"), F.col("next_text").alias("response")) \
        .groupBy("query").agg(F.min("response").alias("response"))
    qs = split_requests(req)
    answered, to_search = use_history(qs, hist)
    return answered.select(F.col("request_id").alias("conv_id"), "q_no", F.lit(1).alias("from_history"), "response") \
        .unionByName(to_search.select(F.col("request_id").alias("conv_id"), "q_no", F.lit(0).alias("from_history"),
                                      F.lit(None).cast("string").alias("response")))


QUERIES.update({
    "relaxed_and_conditions": q_relaxed_and_conditions,
    "relaxed_and_search": q_relaxed_and_search,
    "text_score_norm": q_text_score_norm,
    "hybrid_fusion": q_hybrid_fusion,
    "metadata_lookup": q_metadata_lookup,
    "hybrid_search": q_hybrid_search,
    "cascade_rerank": q_cascade_rerank,
    "answer_text": q_answer_text,
    "summary_context": q_summary_context,
    "history_split": q_history_split,
})


# --- ingestion ------------------------------------------------------------------

def _pages(spark, sf):
    return S.spread(S.table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")


def q_toc_headings(spark, sf):
    from ..functions.text import toc_headings
    p = _pages(spark, sf).select("page_id", toc_headings("html").alias("h"))
    return p.select("page_id", F.posexplode("h").alias("heading_no", "heading"))


def q_strip_tags(spark, sf):
    from ..functions.text import strip_tags
    return _pages(spark, sf).select("page_id", strip_tags("html").alias("text"))


def q_first_url(spark, sf):
    from ..functions.text import first_url
    return _pages(spark, sf).select("page_id", first_url("html").alias("url"))


def _sections(spark, sf):
    from ..functions.text import toc_headings
    from ..operators.ingest import page_lines, sections
    pages = _pages(spark, sf)
    heads = pages.select("page_id", toc_headings("html").alias("headings")).filter(F.col("headings").isNotNull())
    return sections(page_lines(pages), heads, stop_list=stop_words("russian"))


def q_sections(spark, sf):
    return _sections(spark, sf).select("page_id", "section_no", "url", "title", "proc_article", "proc_len")


def q_dense_ids(spark, sf):
    from ..operators.ingest import dense_ids
    return dense_ids(_sections(spark, sf).select("page_id", "section_no"), ["page_id", "section_no"]) \
        .select("doc_id", "page_id", "section_no")


def q_store_consistency(spark, sf):
    from ..operators.index import doc_tokens, postings
    from ..operators.ingest import dense_ids, store_consistency
    from ..operators.vector import hashed_tf_vectors
    meta = dense_ids(_sections(spark, sf), ["page_id", "section_no"])
    vecs = hashed_tf_vectors(postings(doc_tokens(meta, "article", "doc_id"), with_positions=False))
    return store_consistency(vecs, meta)


def q_sections_split(spark, sf):
    """RNK-14 where it splits: each page's own headings stand before every second of its lines."""
    from ..functions.text import toc_headings
    from ..operators.ingest import page_lines, sections
    pages = _pages(spark, sf)
    heads = pages.select("page_id", toc_headings("html").alias("headings")).filter(F.col("headings").isNotNull())
    h = F.col("headings")
    mixed = F.flatten(F.transform("lines", lambda l, i: F.when(
        (i % 2 == 1) & F.get(h, F.floor(i / 2).cast("int")).isNotNull(),
        F.array(F.get(h, F.floor(i / 2).cast("int")), l)).otherwise(F.array(l))))
    lines = page_lines(pages).join(heads, "page_id").select("page_id", "url", "title", mixed.alias("lines"))
    out = sections(lines, heads, stop_list=stop_words("russian"))
    return out.select("page_id", "section_no", "url", "title", "proc_article", "proc_len")


def q_section_store(spark, sf):
    """ING-1 / ING-3: pages long enough, their sections stemmed, ids running on from 1000."""
    from ..functions.text import toc_headings
    from ..operators.ingest import long_enough, page_lines, section_store, sections
    pages = long_enough(_pages(spark, sf), "html", 2000)
    heads = pages.select("page_id", toc_headings("html").alias("headings")).filter(F.col("headings").isNotNull())
    meta = section_store(sections(page_lines(pages), heads, stop_list=stop_words("russian")), start=1000)
    return meta.select("doc_id", "page_id", "section_no", "stem_article")


def q_text_lookup(spark, sf):
    """JOI-2 for every section: the stemmed text for even ids, the processed text for odd ones."""
    from ..operators.ingest import lookup_text, section_store
    meta = materialize(section_store(_sections(spark, sf)))
    ids = meta.select("doc_id")
    both = lookup_text(ids.filter("doc_id % 2 = 0"), meta, stemmed=True).unionByName(
        lookup_text(ids.filter("doc_id % 2 = 1"), meta, stemmed=False))
    return both.select("doc_id", "url", F.md5("article").alias("article_md5"), "text")


def q_whole_articles(spark, sf):
    from ..operators.ingest import long_enough, whole_articles
    arts = whole_articles(long_enough(_articles(spark, sf), "article"), stop_words("russian", "english"))
    return arts.select("file", "article_no", "url", "title", "article", "proc_article", "proc_len")


def q_split_articles(spark, sf):
    from ..operators.ingest import article_fields
    arts = article_fields(_articles(spark, sf))
    return arts.select("file", "article_no", "url", "title", F.length("article").alias("n_chars"))


def _articles(spark, sf):
    """SRC-2 on dump text that Spark writes from the pages (one dump per
    hundred page ids), split back into articles."""
    from ..operators.ingest import page_lines, split_articles
    pl = page_lines(_pages(spark, sf))
    doc = F.concat(F.lit('<doc id="'), F.col("page_id").cast("string"), F.lit('" url="'), F.col("url"),
                   F.lit('" title="'), F.col("title"), F.lit('">\n'), F.col("title"), F.lit("\n\n"),
                   F.array_join("lines", "\n"), F.lit("\n</doc>\n"))
    dumps = pl.select(F.floor(F.col("page_id") / 100).cast("long").alias("file"), "page_id", doc.alias("d")) \
        .groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_id", "d"))).alias("l")) \
        .select("file", F.array_join(F.transform("l", lambda s: s["d"]), "").alias("value"))
    return split_articles(dumps)


def q_title_leak(spark, sf):
    from ..operators.evaluate import title_leak
    from ..operators.ingest import page_lines
    pl = page_lines(_pages(spark, sf)).filter(F.size("lines") > 0)
    return title_leak(pl, "title", "lines").select("page_id", F.col("leak").cast("int").alias("leak"))


QUERIES.update({
    "toc_headings": q_toc_headings,
    "strip_tags": q_strip_tags,
    "first_url": q_first_url,
    "sections": q_sections,
    "dense_ids": q_dense_ids,
    "store_consistency": q_store_consistency,
    "split_articles": q_split_articles,
    "sections_split": q_sections_split,
    "section_store": q_section_store,
    "text_lookup": q_text_lookup,
    "whole_articles": q_whole_articles,
    "title_leak": q_title_leak,
})


# --- evaluation -------------------------------------------------------------------

def passage_truth(spark, sf) -> DataFrame:
    """Right answers of each benchmark question: documents that contain the
    whole passage. The first and last token of a passage may be glued to
    neighbouring text; every other one stands in the document as it is. So the
    candidates are the documents that hold the rarest inner token, and the
    text decides. A passage without an inner token is looked for in every
    text: these questions, a stated set, go to the documents in blocks of at
    most ``SHORT_BLOCK``, one pass for each."""
    from ..operators.index import doc_tokens
    idx = _index(spark, sf)
    q = S.questions(spark, sf)
    toks = materialize(doc_tokens(q, "query", "query_id", id_out="query_id")
                       .select("query_id", F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0))).alias("t")))
    inner = toks.select("query_id", F.explode(F.array_distinct("t")).alias("token"))
    inner = materialize(with_stem(inner, "token", "term").select("query_id", "term").distinct())
    df = idx.dfs.join(broadcast_if_small(inner.select("term").distinct()), "term", "left_semi").select("term", "df")
    need = inner.join(df, "term", "left")      # a token that no document holds: no document holds the passage
    need = materialize(top_k(need, ["query_id"], [F.coalesce("df", F.lit(0)), F.col("term")], 1).select("query_id", "term"))
    got = materialize(idx.postings.select("doc_id", "term").join(broadcast_if_small(need), "term").select("query_id", "doc_id"))
    texts = S.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("page"))
    # two ids a row: the texts stay where they are
    held = texts.join(broadcast_if_small(got), "doc_id").join(broadcast_if_small(q), "query_id") \
        .filter(F.instr("text", F.col("query")) > 0).select("query_id", "doc_id", "page")
    short = materialize(q.join(toks.filter(F.size("t") == 0).select("query_id"), "query_id", "left_semi"))
    n_short = short.count()
    if n_short > SHORT_BLOCK:
        from ..operators.ingest import dense_ids
        short = materialize(dense_ids(short, ["query_id"], id_col="n"))
    for first in range(0, n_short, SHORT_BLOCK):
        block = short if n_short <= SHORT_BLOCK else short.filter((F.col("n") >= first) & (F.col("n") < first + SHORT_BLOCK))
        asked = block.agg(F.collect_list(F.struct("query_id", "query"))).scalar()      # at most SHORT_BLOCK of them
        found = texts.withColumn("asked", asked).select("doc_id", "page", F.explode_outer(
            F.filter("asked", lambda a: F.contains(F.col("text"), a["query"]))).alias("a"))
        held = materialize(held.unionByName(found.filter("a IS NOT NULL").select("a.query_id", "doc_id", "page")))
    return held if n_short else materialize(held)


def q_passage_truth(spark, sf):
    return passage_truth(spark, sf).select(F.col("query_id").alias("item_id"), "doc_id")


def _positions(spark, sf, results):
    from ..operators.evaluate import match_positions
    src = S.table(spark, sf, "documents").select("doc_id", F.col("source").alias("page"))
    res = results.join(src, "doc_id")
    return match_positions(res, passage_truth(spark, sf))


def q_match_positions(spark, sf):
    p = _positions(spark, sf, _search(spark, sf))
    return p.select(F.col("query_id").alias("item_id"), "pos_strong", "pos_light")


def q_metrics(spark, sf):
    from ..operators.evaluate import metric_table
    t = metric_table(_positions(spark, sf, _search(spark, sf)))
    return t.select("metric", F.round("strong", 6).alias("strong"), F.round("light", 6).alias("light"))


GRID_RANKERS = (None, "bm25_proximity", "idf")
GRID_KS = (20, 50)


def q_metrics_grid(spark, sf):
    """EVA-4/6 over every (ranker, k), through the one plan of ``grid``."""
    from .grid import NONE, grid_metrics, grid_positions, rank_grid
    names = {None: NONE, "bm25_proximity": "BM25", "idf": "Quorum"}
    rows = [(i, names[r], NONE, 0.0, 1.0, k) for i, (r, k) in enumerate((r, k) for r in GRID_RANKERS for k in GRID_KS)]
    configs = spark.createDataFrame(rows, "config_id int, ranker string, ranker2 string, threshold double, part double, k int")
    ranked = rank_grid(_search_inputs(spark, sf), _index(spark, sf), _doc_vectors(spark, sf), configs)
    pages = S.table(spark, sf, "documents").select("doc_id", F.col("source").alias("page"))
    t = grid_metrics(grid_positions(ranked, passage_truth(spark, sf), pages, configs), configs)
    shown = F.create_map(*[F.lit(x) for own, name in names.items() for x in (name, own or "none")])
    return t.select(shown[F.col("ranker")].alias("ranker"), "k", "metric", F.round("strong", 6).alias("strong"),
                    F.round("light", 6).alias("light"))


def _doc_scores(spark, sf):
    """A per-document score for ROC: share of distinct terms among tokens."""
    idx = _index(spark, sf)
    d = idx.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("v"), F.first("dl").alias("dl"))
    return d.select("doc_id", F.round(F.col("v") / F.col("dl"), 6).alias("score"))


def _scored(lab, spark, sf):
    """Every labelled document of the corpus; one without tokens scores 0."""
    docs = _index(spark, sf).lengths.select("doc_id").join(_doc_scores(spark, sf), "doc_id", "left")
    return lab.join(docs, "doc_id").withColumn("score", F.coalesce("score", F.lit(0.0)))


def q_roc_curve(spark, sf):
    from ..operators.evaluate import roc_curve
    lab = S.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    c = roc_curve(_scored(lab, spark, sf))
    return c.select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def q_roc_auc(spark, sf):
    from ..operators.evaluate import roc_auc, roc_curve
    lab = S.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return roc_auc(roc_curve(_scored(lab, spark, sf))).select(F.round("auc", 6).alias("auc"))


def q_scorer_plug(spark, sf):
    """REL-9 / REL-12: a user's scorer on (question, document text) pairs, here
    the share of the question's length in the text's."""
    from ..operators.rerank import score_with
    _, _, cands = _rerank_inputs(spark, sf)
    texts = S.table(spark, sf, "documents").select("doc_id", "text")
    pairs = cands.join(texts, "doc_id").join(broadcast_if_small(S.questions(spark, sf)), "query_id") \
        .select("query_id", "doc_id", "query", "text")
    scored = score_with(pairs, lambda: lambda queries, docs: [len(q) / (len(q) + len(d)) for q, d in zip(queries, docs)])
    return scored.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"))


def q_stage_percentiles(spark, sf):
    from ..operators.evaluate import stage_percentiles
    ev = S.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    p = F.col("p")
    return stage_percentiles(ev).select("stage", *[F.round(p[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def q_negative_pairs(spark, sf):
    from pyspark.sql import Window
    from ..operators.evaluate import negative_pairs
    t = passage_truth(spark, sf).join(S.questions(spark, sf), "query_id")
    t = t.withColumn("file", F.pmod("query_id", F.lit(9)).cast("int"))
    t = t.withColumn("row_no", F.row_number().over(Window.partitionBy("file").orderBy("query_id", "doc_id")) - 1)
    return negative_pairs(t.select("file", "row_no", "query", "doc_id"))


def q_latency_report(spark, sf):
    from ..operators.evaluate import stage_report
    ev = S.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    r = stage_report(ev)
    return r.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


QUERIES.update({
    "passage_truth": q_passage_truth,
    "match_positions": q_match_positions,
    "metrics": q_metrics,
    "metrics_grid": q_metrics_grid,
    "roc_curve": q_roc_curve,
    "roc_auc": q_roc_auc,
    "negative_pairs": q_negative_pairs,
    "latency_report": q_latency_report,
    "stage_percentiles": q_stage_percentiles,
    "scorer_plug": q_scorer_plug,
})
