"""DuckDB SQL of the queries in ``features``."""

from __future__ import annotations

from .evaluation_sql import grid_ctes
from .features import ANSWER_K, ANSWER_T, GOLDEN, N_FILES, SHARD_K, STORES, TIMED_K
from .oracle import BASE, HVEC, PAGES, TEXT, TRUTH, _BASE_HEAD, _quorum, ctes, scoring, tok, with_base

SPACES = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_TOK_DOCS = [(k, BASE[k]) for k in ("docs_tok", "occ", "post", "lens", "dfs")]


def _counts(step: str, vectors: str, meta: str) -> str:
    """Two stores, each the sections of all pages or of those with even ids: the smaller is part of the larger."""
    v, m = (f"count(*) FILTER ({w})" for w in (vectors, meta))
    return (f"SELECT '{step}' AS step, {v} AS n_vectors, {m} AS n_meta, {v} AS n_both, 0::BIGINT AS only_vectors, {m} - {v} AS only_meta FROM sec")


_EVEN, _ALL = "WHERE page_id % 2 = 0", "WHERE true"

# Documents scored by nine stores, each with its own df, size and mean length.
_STORE = [
    ("sp", f"SELECT *, doc_id % {STORES} AS store FROM post"),
    ("ss", f"SELECT doc_id % {STORES} AS store, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens GROUP BY 1"),
    ("sd", "SELECT store, term, count(*) AS df FROM sp GROUP BY ALL"),
    ("spt", "SELECT p.store, p.doc_id, p.term, (ln(s.n / (d.df + 1.0)) + 1.0) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl)) AS part "
            "FROM sp p JOIN ss s ON s.store = p.store JOIN sd d ON d.store = p.store AND d.term = p.term"),
    ("sh", "SELECT c.query_id, t.store, c.level, c.start, t.doc_id, sum(part) / (1.0 + c.level) AS score FROM ctm c JOIN spt t ON t.term = c.term "
           "GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = any_value(c.need)"),
    ("st", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, store, level, start ORDER BY round(score, 9) DESC, doc_id) AS r FROM sh) "
           "WHERE r <= 10"),
    ("sn", "SELECT query_id, store, doc_id, (score - min(score) OVER w + 0.1) / (max(score) OVER w - min(score) OVER w + 0.5) AS s FROM st "
           "WINDOW w AS (PARTITION BY query_id, store)"),
    ("su", "SELECT query_id, store, doc_id, sum(s) AS text_score FROM sn GROUP BY ALL"),
]

_VECTOR_ONLY = _BASE_HEAD + [x for x in HVEC if x[0] not in ("fu", "fk")] + [
    ("vk", f"SELECT query_id, doc_id, 1.0 / (1.0 + 4.0 * d2 * d2) AS fused FROM vtop WHERE vr <= {TIMED_K}"),
] + scoring("v_", "vk")

# Requests in two batches: the texts of each, their answers, and what the first left for the second.
_REQUESTS = _TOK_DOCS + [
    ("users", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL"),
    ("bodies", "SELECT 0 AS batch, conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM users WHERE turn = 0 GROUP BY conv_id "
               "UNION ALL SELECT 1, conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FROM users GROUP BY conv_id"),
    ("single", "SELECT batch, conv_id, unnest(string_split(body, chr(10) || chr(10))) AS query, "
               "unnest(generate_series(0, len(string_split(body, chr(10) || chr(10))) - 1)) AS q_no FROM bodies"),
    ("texts", "SELECT query, row_number() OVER (ORDER BY query) AS query_id FROM (SELECT DISTINCT query FROM single)"),
    ("q_tok", f"SELECT query_id, {tok('query')} AS t FROM texts"),
    ("qt", BASE["qt"]),
    ("qw", "SELECT qt.query_id, qt.term, qt.mult * coalesce(d.idf, 1.0) AS w FROM qt LEFT JOIN dfs d ON d.term = qt.term"),
    ("den", "SELECT query_id, sum(w) AS den FROM qw GROUP BY 1"),
    ("rel", "SELECT query_id, doc_id, num / den AS relevance FROM (SELECT qw.query_id, p.doc_id, sum(w) AS num FROM qw JOIN post p ON p.term = qw.term "
            "GROUP BY 1, 2) JOIN den USING (query_id) WHERE den <> 0"),
    ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, doc_id) AS r FROM rel) "
             f"WHERE r <= {ANSWER_K} AND relevance > {ANSWER_T}"),
    ("urls", "SELECT b.query_id, string_agg(concat_ws('/', d.source, d.doc_id::VARCHAR), chr(10) ORDER BY b.r) AS urls FROM best b "
             "JOIN documents d ON d.doc_id = b.doc_id GROUP BY 1"),
    ("answers", "SELECT t.query, CASE WHEN u.urls IS NULL THEN 'Ответ на вопрос ' || t.query || ': ничего не найдено' ELSE "
                "'Ответ на вопрос ' || t.query || ': - ' || chr(10) || chr(10) || u.urls END AS response FROM texts t LEFT JOIN urls u USING (query_id)"),
    ("known", "SELECT DISTINCT query FROM single WHERE batch = 0"),
]

_ARTICLES = PAGES + [("art", "SELECT page_id, url, title, lines, array_to_string(lines, ' ') AS article FROM pl")]

# Question files: a block of three lines and its questions for each page, in url order.
_PAIRS = _ARTICLES + [
    ("qs", f"SELECT page_id % {N_FILES} AS file, url, list_filter(list_transform(list_slice(lines, 1, 5), lambda l: "
           "array_to_string(list_slice(string_split(l, ' '), 1, 6), ' ')), lambda x: length(x) > 0) AS queries FROM art"),
    ("blocks", "SELECT file, url, queries, coalesce(sum(3 + len(queries)) OVER (PARTITION BY file ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING "
               "AND 1 PRECEDING), 0)::BIGINT AS line FROM qs WHERE len(queries) > 0"),
    ("asked", "SELECT file, url, unnest(queries) AS query, line + 3 + unnest(generate_series(0, len(queries) - 1)) AS row_no FROM blocks "
              "WHERE url <> (SELECT min(url) FROM pages)"),
    ("numbered", "SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM asked"),
    ("sizes", "SELECT DISTINCT file, n FROM numbered"),
    ("drawn", f"SELECT a.url, s.file, CASE WHEN s.n > 1 THEN ('0x' || substr(md5('1337:' || a.file || ':' || a.row_no), 1, 12))::BIGINT % (s.n - 1) "
              f"ELSE 0 END AS i FROM numbered a JOIN sizes s ON s.file = (a.file + 5) % {N_FILES}"),
    ("pairs", "SELECT url, query, 1 AS relevant FROM numbered UNION ALL SELECT d.url, n.query, 0 FROM drawn d JOIN numbered n ON n.file = d.file AND n.i = d.i"),
]

_TRIES = _ARTICLES + [
    ("said", "SELECT page_id, title, n AS tries, list_transform(list_slice(string_split(article, ' '), 1, 4), lambda w: trim(w || ' ' || "
             "CASE WHEN n <= length(article) % 4 THEN title ELSE repeat('x', n) END)) AS queries FROM art, range(1, 4) r(n)"),
    ("judged", "SELECT *, len(list_filter(queries, lambda q: NOT contains(lower(q), lower(title)))) = 0 AS leak FROM said"),
    ("last", "SELECT page_id, coalesce(min(tries) FILTER (WHERE NOT leak), 3) AS tries FROM judged GROUP BY 1"),
]

_TIMED = grid_ctes(
    [("right_doc", "SELECT b.item_id, b.text, max(d.doc_id) AS doc_id FROM benchmark b, documents d WHERE instr(d.text, b.text) > 0 GROUP BY ALL"),
     ("asked", "SELECT r.item_id, '' AS file, r.text, r.doc_id, d.source AS page FROM right_doc r JOIN documents d ON d.doc_id = r.doc_id")],
    ks=f"SELECT {TIMED_K} AS k",
    grid=f"SELECT unnest([0, 1, 2]) AS config_id, unnest(['None', 'BM25', 'Quorum']) AS ranker, 'None' AS ranker2, 0.0::DOUBLE AS threshold, "
         f"1.0::DOUBLE AS part, {TIMED_K} AS k") + [
    ("spent", "SELECT event_id % 3 AS config_id, user_id AS query_id, sum(value) AS spent FROM events GROUP BY ALL"),
]

_LINE = "replace(text, chr(10), ' ')"
_CUT = [
    ("cut", "SELECT doc_id, source, chr(10) || replace(text, '. ', '.' || chr(10) || chr(10)) AS t FROM documents"),
    ("spot", "SELECT *, instr(t, chr(10) || chr(10)) AS p FROM cut"),
    ("parts", "SELECT doc_id, source, CASE WHEN p > 0 THEN substr(t, 2, p - 2) ELSE substr(t, 2, greatest(length(t) - 2, 0)) END AS title, "
              "CASE WHEN p > 0 THEN substr(t, p) ELSE substr(t, greatest(length(t), 1), 1) END AS body FROM spot"),
]
_STEMMED = "regexp_replace(w, '^(.{2,})(ed|ing)$', '\\1')"

ORACLE = {
    "store_append": ctes(PAGES) + "\n" + _counts("died", _EVEN, _ALL) + "\nUNION ALL " + _counts("read", _EVEN, _EVEN)
                    + "\nUNION ALL " + _counts("finished", _ALL, _ALL),
    "request_history": ctes(_REQUESTS) + "\nSELECT s.batch, s.conv_id, count(*) AS n_questions, "
                       "count(*) FILTER (WHERE s.batch = 1 AND k.query IS NOT NULL) AS n_from_history, "
                       "md5(string_agg(a.response, chr(10) || chr(10) ORDER BY s.q_no)) AS body_md5 FROM single s JOIN answers a ON a.query = s.query "
                       "LEFT JOIN known k ON k.query = s.query GROUP BY ALL",
    "text_search_sharded": ctes(_BASE_HEAD + TEXT + _STORE) + "\nSELECT * FROM (SELECT query_id AS item_id, store, doc_id, round(text_score, 6) AS text_score, "
                           "row_number() OVER (PARTITION BY query_id, store ORDER BY round(text_score, 9) DESC, doc_id) AS store_rank FROM su) "
                           f"WHERE store_rank <= {SHARD_K // STORES}",
    "vector_only_search": ctes(_VECTOR_ONLY) + "\nSELECT k.query_id AS item_id, k.doc_id, round(k.fused, 6) AS score, row_number() OVER "
                          "(PARTITION BY k.query_id ORDER BY round(k.fused, 9) DESC, k.doc_id) AS rank FROM vk k JOIN v_rel r ON r.query_id = k.query_id "
                          "AND r.doc_id = k.doc_id WHERE r.relevance > 0",
    "interleaved_fusion": ctes(_BASE_HEAD + TEXT + [x for x in HVEC if x[0] not in ("fu", "fk")]) + "\nSELECT query_id AS item_id, doc_id, vr * 2 - 2 AS slot "
                          f"FROM vtop WHERE vr <= {TIMED_K} UNION ALL SELECT query_id, doc_id, r * 2 - 1 FROM (SELECT query_id, doc_id, row_number() OVER "
                          "(PARTITION BY query_id ORDER BY round(sum(text_score), 9) DESC, doc_id) AS r FROM tnorm GROUP BY query_id, doc_id) "
                          f"WHERE r <= {TIMED_K}",
    "quorum_whitespace": f"WITH d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '')) AS term FROM documents), "
                         f"q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '')) AS term FROM benchmark), "
                         "n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), s AS (SELECT q.item_id, d.doc_id, count(*)::DOUBLE / any_value(n.n) AS relevance "
                         "FROM q JOIN d ON d.term = q.term JOIN n ON n.item_id = q.item_id GROUP BY 1, 2) SELECT * FROM (SELECT item_id, doc_id, "
                         "round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY item_id ORDER BY round(relevance, 9) DESC, doc_id) AS rank FROM s) "
                         f"WHERE rank <= {TIMED_K}",
    "quorum_at_least": with_base(f"SELECT query_id AS item_id, doc_id, round(relevance, 6) AS relevance FROM ({_quorum('vanilla')}) WHERE relevance >= 0.5"),
    "relevance_pairs": ctes(_PAIRS) + "\nSELECT p.url, p.query, md5(a.article) AS article_md5, p.relevant FROM pairs p JOIN art a ON a.url = p.url",
    "rows_by_position": "WITH r AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS p, "
                        "count(*) OVER () AS n FROM documents), w AS (SELECT p AS position, doc_id, source, text_md5, n FROM r WHERE p IN (SELECT item_id FROM benchmark)) "
                        "SELECT position, doc_id, source, text_md5 FROM w UNION ALL SELECT position + n, doc_id, source, text_md5 FROM w",
    "generated_questions": ctes(_TRIES) + "\nSELECT j.page_id, j.tries, j.leak::INT AS leak, array_to_string(j.queries, '|') AS queries FROM judged j "
                           "JOIN last l ON l.page_id = j.page_id AND l.tries = j.tries",
    "score_with_time": ctes(_TIMED) + "\nSELECT g.ranker, count(*) AS n, count(s.spent) AS n_timed, round(avg(m.s), 6) AS strong, round(avg(m.l), 6) AS light, "
                       "round(avg(s.spent), 6) AS mean_seconds, round(stddev_pop(s.spent), 6) AS std_seconds FROM mv m JOIN grid g ON g.config_id = m.config_id "
                       "LEFT JOIN spent s ON s.config_id = m.config_id AND s.query_id = m.query_id WHERE m.metric = 'inv_5' GROUP BY g.ranker",
    "dump_articles": ctes(PAGES) + "\nSELECT url, title, md5(a) AS article_md5 FROM (SELECT url, title, '<doc id=\"' || page_id || '\" url=\"' || url || "
                     "'\" title=\"' || title || '\">' || chr(10) || title || chr(10) || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '</doc>' AS a "
                     "FROM pl) WHERE length(a) >= 499",
    # the texts have no Cyrillic letter, so stems are the words themselves
    "section_table": ctes(PAGES) + "\nSELECT row_number() OVER (ORDER BY page_id, section_no) - 1 AS doc_id, page_id::VARCHAR AS article_id, url, title, "
                     "md5(article) AS article_md5, len(string_split(proc_article, ' '))::INT AS proc_len, md5(proc_article) AS stem_md5 FROM secp",
    "stage_log": "SELECT event_type AS stage, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max FROM "
                 "(SELECT event_type, round(value, 2) AS v FROM events) GROUP BY 1",
    "pages_without_headings": ctes([("pages_all", "SELECT page_id, url, CASE WHEN coalesce(TRY_CAST(regexp_extract(url, '(\\d+)', 1) AS BIGINT) % 2 = 1, false) "
                                     "THEN regexp_replace(html, '(?s)<nav.*?</nav>', '', 'g') ELSE html END AS html FROM pages")]
                                   + [(n, q.replace("FROM pages", "FROM pages_all")) for n, q in PAGES])
                              + "\nSELECT p.page_id, count(s.page_id) AS n_sections FROM pages p LEFT JOIN sec s ON s.page_id = p.page_id GROUP BY 1",
    "cyrillic_stems": ctes(_TOK_DOCS[:1] + [
        ("golden", "SELECT unnest([" + ", ".join(f"'{w}'" for w in GOLDEN) + "]) AS word, unnest([" + ", ".join(f"'{s}'" for s in GOLDEN.values())
                   + f"]) AS stem, unnest(range(0, {len(GOLDEN)})) AS i"),
        ("tokens", f"SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % {len(GOLDEN)} AS i FROM (SELECT unnest(t) AS w FROM docs_tok)")])
        + "\nSELECT word, stem, count(*) AS n FROM tokens JOIN golden USING (i) GROUP BY word, stem",
    "request_texts": f"SELECT item_id, replace({_LINE}, '_', ' ') AS from_path, text AS from_body FROM benchmark",
    "titles_and_bodies": ctes(_CUT) + "\nSELECT doc_id, source AS page, title, md5(replace(replace(replace(body, chr(10) || chr(10), ''), 'the ', ''), "
                         "chr(160), ' ')) AS body_md5 FROM parts",
    "lemmas": f"SELECT item_id, array_to_string(list_transform({tok('text')}, lambda w: {_STEMMED}), ' ') AS lemmas FROM benchmark",
}
