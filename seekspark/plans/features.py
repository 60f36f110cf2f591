"""Registered queries of ingestion, sources, sinks, requests and generation that go through files and state:
what they read back they have written, as a user's job would. SQL twins are in ``features_sql``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import with_stem
from ..operators.ingest import dense_ids
from ..session import scratch_path
from ..sources import files as FS
from ..sources import tables as S
from ..util import broadcast_if_small, materialize, top_k
from . import stores

STORES = 9
SHARD_K = 50
ANSWER_K = 3
ANSWER_T = 0.6          # quorum an answer's document must pass
N_FILES = 9
TIMED_K = 20


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# --- two stores ---------------------------------------------------------------

def q_store_append(spark, sf):
    """ING-3 / SNK-1 / JOI-13: the pages arrive in two batches, the second dies between its two writes and is run again.
    Counts of both stores as they lie on disk after the death, as readers see them then, and after the replay."""
    from ..streaming.store import SectionStore
    store = SectionStore(spark, _scratch(spark, "store"))
    pages = S.table(spark, sf, "pages").select("page_id", "url", "html")
    first, second = pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")
    store.append(first, 0)
    store.write_meta(second, 1)
    steps = [materialize(store.consistency(committed=c).withColumn("step", F.lit(n))) for n, c in (("died", False), ("read", True))]
    store.append(second, 1)
    store.append(second, 1)
    steps.append(store.consistency(committed=False).withColumn("step", F.lit("finished")))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


# --- requests and their history -------------------------------------------------

def quorum_answers(spark, sf):
    """An ``answer`` for requests: the urls of the best documents by quorum, if they pass."""
    from ..operators.answer import answer_text, url_lists
    from ..operators.index import query_terms
    from ..operators.relevance import quorum_topk
    idx, blocks = stores.corpus_index(spark, sf), stores.term_blocks(spark, sf)
    urls = S.doc_meta(spark, sf).select("doc_id", "url")

    def answer(questions: DataFrame) -> DataFrame:
        hits = quorum_topk(query_terms(questions, "query_id", "query"), idx, blocks, ANSWER_K, least=ANSWER_T)
        kept = hits.filter(F.col("relevance") > ANSWER_T)
        ranked = materialize(top_k(kept, ["query_id"], [F.round("relevance", 9).desc(), F.col("doc_id")], ANSWER_K))
        return answer_text(questions, url_lists(ranked.join(urls, "doc_id")))
    return answer


def conversation_requests(spark, sf, turns: str) -> DataFrame:
    """``(request_id, body)``: the user turns of each conversation, blank lines between them."""
    users = S.table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").filter(turns)
    return users.groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l")) \
        .select("request_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n\n").alias("body"))


def q_request_history(spark, sf):
    """JOI-4 / Q9: the first turns of all conversations are a first batch of requests, whole conversations a second one, whose
    first questions come from the history that the first batch left."""
    from ..streaming.requests import History, answer_requests
    answer, history = quorum_answers(spark, sf), History(spark, _scratch(spark, "history"))
    out = None
    for batch, turns in enumerate(("turn = 0", "turn >= 0")):
        done = answer_requests(conversation_requests(spark, sf, turns), history, batch, f"2024-01-0{batch + 1} 00:00:00", answer)
        done = materialize(done.withColumn("batch", F.lit(batch)))
        out = done if out is None else out.unionByName(done)
    return out.select("batch", F.col("request_id").alias("conv_id"), "n_questions", "n_from_history", F.md5("body").alias("body_md5"))


# --- search variants ----------------------------------------------------------------

def q_text_search_sharded(spark, sf):
    """RNK-2 / SET-2 for text: nine stores with statistics of their own, ``int(k/9)`` hits of each."""
    from ..operators.textsearch import conditions, sharded_text_search
    from .queries import _search_inputs
    hits = sharded_text_search(conditions(_search_inputs(spark, sf).words), _store_blocks(spark, sf), STORES, SHARD_K)
    return hits.select(F.col("query_id").alias("item_id"), "store", "doc_id", F.round("text_score", 6).alias("text_score"), "store_rank")


def _store_blocks(spark, sf):
    from ..operators.blocks import TermBlocks
    key = stores._key(spark, sf, "documents", "store_blocks")
    if key not in stores._CACHE:
        idx = stores.corpus_index(spark, sf)
        store_of = idx.lengths.select("doc_id", F.pmod("doc_id", F.lit(STORES)).cast("int").alias("store"))
        stores._CACHE[key] = TermBlocks.by_store(idx, store_of)
    return stores._CACHE[key]


def q_vector_only_search(spark, sf):
    """RNK-17: the same search without the text side and without a ranker."""
    from .queries import _search
    r = _search(spark, sf, use_text=False, ranker=None, k=TIMED_K)
    return r.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))


def q_interleaved_fusion(spark, sf):
    """RNK-9: vector and text hits of each question in turn."""
    from ..operators.textsearch import interleave
    from .queries import _doc_vectors, _search_inputs
    from .search import text_hits, vector_hits
    inp = _search_inputs(spark, sf)
    texts = text_hits(inp, stores.corpus_index(spark, sf), 2).groupBy("query_id", "doc_id").agg(F.sum("text_score").alias("s"))
    texts = top_k(texts, ["query_id"], [F.round("s", 9).desc(), F.col("doc_id")], TIMED_K)
    slots = interleave(vector_hits(inp, _doc_vectors(spark, sf), TIMED_K, 64), texts)
    return slots.select(F.col("query_id").alias("item_id"), "doc_id", "slot")


def q_quorum_whitespace(spark, sf):
    """TXT-8 / REL-1: words as they stand between white space, neither cleaned nor stemmed."""
    from ..operators.index import CorpusIndex, query_terms
    from ..operators.relevance import quorum_topk
    key = stores._key(spark, sf, "documents", "whitespace")
    if key not in stores._CACHE:
        stores._CACHE[key] = CorpusIndex.build(S.documents(spark, sf), stem=False, preprocess=T.whitespace_tokens)
    idx = stores._CACHE[key]
    asked = query_terms(S.questions(spark, sf), "query_id", "query", stem=False, preprocess=T.whitespace_tokens)
    hits = quorum_topk(asked, idx, idx.blocks, TIMED_K, "vanilla")
    ranked = top_k(hits, ["query_id"], [F.round("relevance", 9).desc(), F.col("doc_id")], TIMED_K)
    return ranked.select(F.col("query_id").alias("item_id"), "doc_id", F.round("relevance", 6).alias("relevance"), "rank")


def q_quorum_at_least(spark, sf):
    """FIL-5: the older filter keeps what reaches the threshold itself."""
    from ..operators import relevance as R
    from .queries import _rerank_inputs
    idx, asked, cands = _rerank_inputs(spark, sf)
    kept = R.quorum_filter(R.quorum_relevance(cands, asked, idx, "vanilla"), 0.5, strict=False)
    return kept.select(F.col("query_id").alias("item_id"), "doc_id", F.round("relevance", 6).alias("relevance"))


# --- questions, pairs, rows by position -----------------------------------------------

def _page_articles(spark, sf) -> DataFrame:
    """``(page_id, url, title, lines)`` of every page, two blank-free lines at least kept as they are."""
    from ..operators.ingest import page_lines
    from .queries import _pages
    return page_lines(_pages(spark, sf))


def page_questions(pages: DataFrame) -> DataFrame:
    """``(file, url, queries)``: up to five questions of each page, the first six words of its first lines, in one file
    for each rest of the page id."""
    q = F.transform(F.slice("lines", 1, 5), lambda l: F.array_join(F.slice(F.split(l, " "), 1, 6), " "))
    asked = pages.select(F.concat(F.lit("AA/wiki_0"), F.pmod("page_id", F.lit(N_FILES)).cast("string")).alias("file"), "url",
                         F.filter(q, lambda x: F.length(x) > 0).alias("queries"))
    return asked.filter(F.size("queries") > 0)


def q_relevance_pairs(spark, sf):
    """EVA-7 / JOI-8 / JOI-9 / SNK-4 / SRC-8 / FIL-8 / SNK-6: questions written as one file for each input file and read back but for
    one url, joined with the articles, drawn negatives, written as CSV and read back."""
    from ..operators.pairs import last_articles, relevance_pairs
    from ..sources.query_files import write_question_files
    pages = materialize(_page_articles(spark, sf))
    folder = _scratch(spark, "queries")
    write_question_files(page_questions(pages), folder)
    skipped = pages.agg(F.min("url")).first()[0]
    read = FS.read_generated_queries(spark, folder, skip_url=skipped)
    file_no = F.regexp_extract("file", r"wiki_0(\d)\.txt$", 1).cast("int")
    asked = read.select(file_no.alias("file"), F.col("line_no").alias("row_no"), "url", "query")
    # every page twice, an empty draft before its text: the last one wins
    articles = pages.select("url", F.lit(0).alias("row_no"), F.lit("").alias("article")).unionByName(
        pages.select("url", F.lit(1).alias("row_no"), F.array_join("lines", " ").alias("article")))
    pairs = relevance_pairs(asked, last_articles(articles), N_FILES)
    out = _scratch(spark, "relevance")
    FS.write_store(pairs, out, fmt="csv")
    back = spark.read.schema("url STRING, query STRING, article STRING, relevant INT").csv(out, header=False, multiLine=True, escape='"')
    return back.select("url", "query", F.md5("article").alias("article_md5"), "relevant")


def q_rows_by_position(spark, sf):
    """SRC-3 / SRC-4 / SNK-3: the documents as headerless CSV, appended in two writes, and its rows at the positions that the
    benchmark's ids name, opened by the position index."""
    from ..sources.positions import position_index, rows_at
    folder = _scratch(spark, "texts")
    docs = S.table(spark, sf, "documents").select("doc_id", "source", "text")
    ordered = docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    FS.write_store(ordered, f"{folder}/a", fmt="csv")
    FS.write_store(ordered, f"{folder}/b", fmt="csv")
    index = position_index(spark, folder, split_bytes=1 << 16)
    n = docs.count()
    asked = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("position"))
    asked = asked.unionByName(asked.select((F.col("position") + n).alias("position")))     # in both writes
    rows = rows_at(index, asked, "doc_id BIGINT, source STRING, text STRING")
    return rows.select("position", "doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


class TitleAtFirst:
    """A generator for tests: its questions hold the title as often as the prompt's length says, then no longer."""

    def __call__(self, prompts, tries):
        return [self.reply(p, n) for p, n in zip(prompts, tries)]

    def reply(self, prompt: str, n: int) -> str:
        title, _, text = prompt.partition("Title: ")[2].partition("\nText: ")
        words = text.split(" ")[:4]
        leak = n <= len(text) % 4
        return "Here they are:\n" + "\n".join(f"{i}. {w} {title if leak else 'x' * n}" for i, w in enumerate(words, 1))


def q_generated_questions(spark, sf):
    """GEN-2 / FIL-7 / UDF-1: questions asked of a generator until they don't hold the title, at most three times."""
    from ..operators.generate import generate_queries
    pages = _page_articles(spark, sf).select("page_id", F.col("title"), F.array_join("lines", " ").alias("article"))
    done, _ = generate_queries(pages, TitleAtFirst, max_tries=3)
    return done.select("page_id", "tries", F.col("leak").cast("int").alias("leak"), F.array_join("queries", "|").alias("queries"))


def q_score_with_time(spark, sf):
    """EVA-5: metric and time of every configuration in one table; the events stand for stage timings, the user for
    the question, the event's number for the configuration."""
    from ..operators.evaluate import score_and_time
    from .evaluation import doc_urls
    from .grid import NONE, grid_positions, rank_grid
    from .queries import _doc_vectors, _search_inputs, passage_truth
    rows = [(i, r, NONE, 0.0, 1.0, TIMED_K) for i, r in enumerate((NONE, "BM25", "Quorum"))]
    configs = spark.createDataFrame(rows, "config_id int, ranker string, ranker2 string, threshold double, part double, k int")
    # one right answer, the last document with the passage: copies before it make its rank vary
    last = passage_truth(spark, sf).groupBy("query_id").agg(F.max("doc_id").alias("doc_id"))
    pages = doc_urls(spark, sf).select("doc_id", "page")
    ranked = rank_grid(_search_inputs(spark, sf), stores.corpus_index(spark, sf), _doc_vectors(spark, sf), configs)
    positions = grid_positions(ranked, last.join(pages, "doc_id"), pages, configs)
    spent = S.table(spark, sf, "events").select(F.pmod("event_id", F.lit(len(rows))).cast("int").alias("config_id"),
                                                F.col("user_id").alias("query_id"), F.col("event_type").alias("stage"),
                                                F.col("value").alias("seconds"))
    t = score_and_time(positions, spent).join(F.broadcast(configs.select("config_id", "ranker")), "config_id")
    return t.select("ranker", "n", "n_timed", *[F.round(c, 6).alias(c) for c in ("strong", "light", "mean_seconds", "std_seconds")])


# --- dumps, tables and logs read from files -------------------------------------------------

def q_dump_articles(spark, sf):
    """SRC-1 / SRC-2: the pages as dump files in nested folders, read article by article where the marker stands."""
    from ..operators.ingest import article_fields
    pages = _page_articles(spark, sf)
    doc = F.concat(F.lit('<doc id="'), F.col("page_id").cast("string"), F.lit('" url="'), F.col("url"), F.lit('" title="'), F.col("title"),
                   F.lit('">\n'), F.col("title"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n</doc>"))
    folder = _scratch(spark, "dumps")
    pages.select(F.pmod("page_id", F.lit(3)).alias("folder"), doc.alias("value")).repartition(2).write.partitionBy("folder").text(folder)
    arts = article_fields(FS.read_dump(spark, folder))
    return arts.select("url", "title", F.md5(F.rtrim("article", F.lit("\n"))).alias("article_md5"))


def q_section_table(spark, sf):
    """SRC-4 / SNK-3: the section store as headerless CSV with its positional schema, read back whole."""
    from ..operators.ingest import section_store
    from .queries import _sections
    store = section_store(_sections(spark, sf))
    folder = _scratch(spark, "sections")
    FS.write_store(store.select("doc_id", F.col("page_id").cast("string").alias("article_id"), "url", "title", "article", "proc_article", "proc_len",
                                "stem_article"), folder, fmt="csv")
    back = FS.read_sections_csv(spark, folder)
    return back.select("doc_id", "article_id", "url", "title", F.md5("article").alias("article_md5"), "proc_len", F.md5("stem_article").alias("stem_md5"))


def q_stage_log(spark, sf):
    """SNK-5 / EVA-9: the events as log lines of stages, with and without a count, metric lines between them; read back and summed up."""
    from ..operators.evaluate import stage_report
    ev = S.table(spark, sf, "events")
    seconds = F.format_string("%.2f.", F.col("value"))
    line = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), seconds)) \
        .otherwise(F.concat_ws(" ", "event_type", seconds))
    folder = _scratch(spark, "log")
    ev.select(F.explode(F.array(line, F.lit("in_top_5: 0.5"))).alias("value")).write.text(folder)
    r = stage_report(FS.parse_stage_log(spark.read.text(folder)))
    return r.select("stage", "n", *[F.round(c, 4).alias(c) for c in ("mean", "min", "max")])


def q_pages_without_headings(spark, sf):
    """FIL-2: a page without a list of headings gives no section; here those with an odd number in their url lose theirs."""
    from ..operators.ingest import page_lines, sections
    from .queries import _pages
    odd = F.regexp_extract("url", r"(\d+)", 1).try_cast("bigint") % 2 == 1
    pages = _pages(spark, sf).withColumn("html", F.when(F.coalesce(odd, F.lit(False)), F.regexp_replace("html", "(?s)<nav.*?</nav>", ""))
                                         .otherwise(F.col("html")))
    heads = pages.select("page_id", T.toc_headings("html").alias("headings")).filter(F.col("headings").isNotNull())
    secs = sections(page_lines(pages), heads).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sections"))
    return pages.select("page_id").join(secs, "page_id", "left").select("page_id", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


# --- text functions on text that reaches them ----------------------------------------------

# Russian words and their stems (fixed values: the published sample of the Snowball stemmer).
GOLDEN = {
    "вагонов": "вагон", "важнейшими": "важн", "важностью": "важност", "валандался": "валанда", "валерию": "валер", "валетами": "валет",
    "павильонам": "павильон", "павлиньим": "павлин", "павловцы": "павловц", "пагубная": "пагубн", "падающего": "пада", "падением": "паден",
    "падений": "паден", "паденья": "паден", "падчерицей": "падчериц", "падшая": "падш",
}


def q_cyrillic_stems(spark, sf):
    """TXT-6: every token of the documents mapped to a Russian word, stemmed: counts for each word and stem."""
    from ..operators.index import doc_tokens
    # outer: see ``token_rows``; equal tokens are counted first and go through the stemmer once
    tokens = doc_tokens(S.documents(spark, sf)).select(F.explode_outer("tokens").alias("t")).filter(F.col("t").isNotNull())
    tokens = materialize(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    words = F.array(*[F.lit(w) for w in GOLDEN])
    at = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint"), F.lit(len(GOLDEN))).cast("int")
    return with_stem(tokens.select(F.get(words, at).alias("word"), "n"), "word", "stem").groupBy("word", "stem").agg(F.sum("n").alias("n"))


def q_request_texts(spark, sf):
    """SRC-10 / SRC-11: the passages as request paths and as request bodies, and the questions read from them."""
    q = S.questions(spark, sf).withColumn("line", F.replace("query", F.lit("\n"), F.lit(" ")))
    path = F.concat(F.lit("/"), F.replace(F.url_encode(F.replace("line", F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")), F.lit("/x"))
    return q.select(F.col("query_id").alias("item_id"), T.request_path_query(path).alias("from_path"),
                    T.request_body_query(F.encode("query", "UTF-8")).alias("from_body"))


def q_titles_and_bodies(spark, sf):
    """TXT-10 / TXT-13 / TXT-17: documents cut at their first blank line, listed strings removed, page part of their urls."""
    from .evaluation import doc_urls
    docs = S.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\n"), F.regexp_replace("text", r"\. ", ".\n\n")).alias("t"))
    title, body = T.title_and_body("t")
    out = docs.select("doc_id", title.alias("title"), F.md5(T.remove_strings(body, ["\n\n", "the "])).alias("body_md5"))
    return out.join(doc_urls(spark, sf).select("doc_id", T.url_page("url").alias("page")), "doc_id")


def q_lemmas(spark, sf):
    """TXT-7: the questions' words by a dictionary of forms; here every word that ends in "ed" or "ing" stands for the rest of it."""
    from ..operators.generate import lemmatize
    from ..operators.index import doc_tokens
    toks = materialize(doc_tokens(S.questions(spark, sf), "query", "query_id", id_out="item_id"))
    forms = toks.select(F.explode("tokens").alias("form")).distinct().filter(F.col("form").rlike("^.{2,}(ed|ing)$")) \
        .select("form", F.regexp_replace("form", "(ed|ing)$", "").alias("lemma"))
    return lemmatize(toks, ["item_id"], "tokens", forms).select("item_id", F.array_join("lemmas", " ").alias("lemmas"))


QUERIES = {
    "store_append": q_store_append,
    "request_history": q_request_history,
    "text_search_sharded": q_text_search_sharded,
    "vector_only_search": q_vector_only_search,
    "interleaved_fusion": q_interleaved_fusion,
    "quorum_whitespace": q_quorum_whitespace,
    "quorum_at_least": q_quorum_at_least,
    "relevance_pairs": q_relevance_pairs,
    "rows_by_position": q_rows_by_position,
    "generated_questions": q_generated_questions,
    "score_with_time": q_score_with_time,
    "dump_articles": q_dump_articles,
    "section_table": q_section_table,
    "stage_log": q_stage_log,
    "pages_without_headings": q_pages_without_headings,
    "cyrillic_stems": q_cyrillic_stems,
    "request_texts": q_request_texts,
    "titles_and_bodies": q_titles_and_bodies,
    "lemmas": q_lemmas,
}
