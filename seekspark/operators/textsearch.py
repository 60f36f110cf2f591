"""Relaxed-AND full-text search (RNK-3, RNK-4, JOI-12) and score fusion (RNK-5..9).

A question's words (cleaned with Russian stop words, stemmed, order and
duplicates kept) give conditions: level 0 is all ``n`` words; level ``l`` in
``1..depth`` is each run of ``n-l`` consecutive words. A document matches a
condition when it holds every distinct word of it (relational division:
join the postings with the condition terms, count per condition and doc).
Its score is BM25F summed over the condition's terms, times ``1/(1+l)``;
the best 10 per condition are kept and all hits of all conditions count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, materialize, top_k
from .blocks import TermBlocks, pairs, store_term
from .index import doc_tokens, token_rows

# Fixed values of the text index the reference queries: its default result
# limit, and the depth the service passes.
HITS_PER_CONDITION = 10
DEPTH = 2


def question_words(questions: DataFrame, id_col: str = "query_id", text_col: str = "query",
                   stop_list=()) -> DataFrame:
    """``(query_id, words)``: cleaned, stemmed tokens in order (duplicates kept)."""
    rows = token_rows(doc_tokens(questions, text_col, id_col, stop_list, id_out="query_id"), "query_id")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("w")) \
        .select("query_id", F.transform("w", lambda s: s["term"]).alias("words"))


def conditions(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """RNK-4 conditions: ``(query_id, level, start, terms)``; ``terms`` are
    the distinct words of the run. Questions without words give none."""
    n = F.size("words")
    lv = words.filter(n >= 1).select("query_id", "words",
                                     F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), n - 1))).alias("level"))
    st = lv.select("query_id", "words", "level", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("start"))
    return st.select("query_id", "level", "start",
                     F.array_distinct(F.slice("words", F.col("start") + 1, F.size("words") - F.col("level")))
                     .alias("terms"))


def relaxed_and_search(conds: DataFrame, blocks: TermBlocks, per_condition: int = HITS_PER_CONDITION) -> DataFrame:
    """RNK-3 + RNK-4: ``(query_id, level, start, doc_id, score, hit_rank)``.

    ``score`` already carries the level factor ``1/(1+level)``. A condition
    of level l misses at most l words of the question, so a match holds one of
    its d + 1 rarest distinct words, d being the deepest level. Only documents
    with one of these are paired with the question; the lists of its other words are cut to these
    documents first. The parts of BM25F come from the same rows. Exact: no match is lost.
    """
    cond_terms = materialize(conds.select("query_id", "level", "start", F.size("terms").alias("need"),
                                          F.explode("terms").alias("term")))
    size = cond_terms.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term").alias("terms"),
                          F.sum(F.octet_length("term") + 40).alias("bytes")).first()
    side = F.broadcast if size["rows"] <= BROADCAST_MAX_ROWS and (size["bytes"] or 0) <= BROADCAST_MAX_BYTES else lambda df: df
    qwords = cond_terms.select("query_id", "term").distinct()
    per_query = cond_terms.groupBy("query_id").agg(F.min("need").alias("min_need"), F.max("level").alias("deepest"))
    known = qwords.join(side(blocks.stats.select("term", "df").join(side(qwords.select("term").distinct()), "term")), "term", "left")
    order = top_k(known, ["query_id"], [F.coalesce("df", F.lit(0)), F.col("term")], None, "nth")
    rare = materialize(order.join(side(per_query), "query_id").filter(F.col("nth") <= F.col("deepest") + 1).select("query_id", "term"))
    lists = blocks.of_terms(qwords.select("term").distinct(), size["terms"])
    seeds = materialize(pairs(lists.join(side(rare), "term"), "query_id").select("query_id", "doc_id").distinct())
    docs = seeds.select("doc_id").distinct()
    docs = F.broadcast(docs) if seeds.count() <= BROADCAST_MAX_ROWS else docs     # ids only
    held = pairs(lists, "term").join(docs, "doc_id", "left_semi")
    cells = seeds.join(side(qwords), "query_id").join(held, ["doc_id", "term"])
    got = F.count(F.lit(1)).over(Window.partitionBy("query_id", "doc_id"))
    cells = cells.withColumn("got", got).join(side(per_query), "query_id").filter(F.col("got") >= F.col("min_need"))
    hits = cells.select("query_id", "doc_id", "term", "part").join(side(cond_terms), ["query_id", "term"]) \
        .groupBy("query_id", "level", "start", "doc_id") \
        .agg(F.count(F.lit(1)).alias("got"), F.first("need").alias("need"), F.sum("part").alias("s")) \
        .filter(F.col("got") == F.col("need")) \
        .withColumn("score", F.col("s") / (1.0 + F.col("level")))
    ranked = top_k(hits, ["query_id", "level", "start"], [F.round("score", 9).desc(), F.col("doc_id")],
                   per_condition, "hit_rank")
    return ranked.select("query_id", "level", "start", "doc_id", "score", "hit_rank")


def conditions_by_store(conds: DataFrame, stores: int) -> DataFrame:
    """RNK-2: every condition asked of every store, in the store's own terms; ``query_id`` becomes
    the struct ``(query_id, store)``, so that hits, limits and norms are those of one store."""
    each = conds.withColumn("store", F.explode(F.sequence(F.lit(0), F.lit(stores - 1))))
    return each.select(F.struct("query_id", "store").alias("query_id"), "level", "start",
                       F.transform("terms", lambda t: store_term(F.col("store"), t)).alias("terms"))


def sharded_text_search(conds: DataFrame, blocks: TermBlocks, stores: int, k: int) -> DataFrame:
    """RNK-2 / SET-2 for text: ``(query_id, store, doc_id, text_score, store_rank)``, the ``int(k/stores)`` best
    of every store by the sum of their normalised condition scores, ties by id. ``blocks`` is made by
    ``TermBlocks.by_store``: each store scores with its own statistics."""
    hits = normalize_text_scores(relaxed_and_search(conditions_by_store(conds, stores), blocks))
    summed = hits.groupBy("query_id", "doc_id").agg(F.sum("text_score").alias("text_score"))
    best = top_k(summed, ["query_id"], [F.round("text_score", 9).desc(), F.col("doc_id")], int(k / stores), "store_rank")
    return best.select("query_id.query_id", "query_id.store", "doc_id", "text_score", "store_rank")


def normalize_text_scores(hits: DataFrame, col: str = "score", out: str = "text_score") -> DataFrame:
    """RNK-5 per question: ``(s - min + 0.1) / (max - min + 0.5)``."""
    own = Window.partitionBy("query_id")      # a few hits for each condition of a question
    low, high = F.min(col).over(own), F.max(col).over(own)
    return hits.withColumn(out, (F.col(col) - low + 0.1) / (high - low + 0.5))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int | None, vec_col: str = "similarity",
         text_col: str = "text_score") -> DataFrame:
    """RNK-8 additive fusion + RNK-7 limit: weights of one document (from
    either list, repeats included) add up; best first, ties by doc_id.
    Returns ``(query_id, doc_id, fused, fused_rank)``."""
    both = vector_hits.select("query_id", "doc_id", F.col(vec_col).alias("w")) \
        .unionByName(text_hits.select("query_id", "doc_id", F.col(text_col).alias("w")))
    summed = both.groupBy("query_id", "doc_id").agg(F.sum("w").alias("fused"))
    return top_k(summed, ["query_id"], [F.round("fused", 9).desc(), F.col("doc_id")], k, "fused_rank")


def interleave(vector_hits: DataFrame, text_hits: DataFrame, vec_rank: str = "rank",
               text_rank: str = "rank") -> DataFrame:
    """RNK-9 (the reference's commented alternative): vector, text, vector, ...
    then the rest of the longer list: ``(query_id, doc_id, slot)``."""
    v = vector_hits.select("query_id", "doc_id", (F.col(vec_rank) * 2 - 2).alias("slot"))
    t = text_hits.select("query_id", "doc_id", (F.col(text_rank) * 2 - 1).alias("slot"))
    return v.unionByName(t)
