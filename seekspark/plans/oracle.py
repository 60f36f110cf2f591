"""DuckDB SQL that states each registered query independently of Spark.

The tables are the pre-registered views (``documents``, ``benchmark``, ...).
The test corpus has no Cyrillic letters, so the Russian stemmer is the
identity on it and the SQL leaves it out.
"""

from __future__ import annotations

from ..functions.text import LETTER_CLASS, MAX_TOKEN_LEN, MIN_TOKEN_LEN, stop_words


def tok(expr: str, stop_list=()) -> str:
    """SQL twin of ``clean_tokens``."""
    raw = f"regexp_split_to_array(trim(regexp_replace({expr}, '[^{LETTER_CLASS}]', ' ', 'g')), ' +')"
    if stop_list:
        lst = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_list)
        raw = f"list_filter({raw}, lambda w: NOT list_contains([{lst}], w))"
    low = f"list_transform({raw}, lambda w: lower(w))"
    return f"list_filter({low}, lambda w: length(w) BETWEEN {MIN_TOKEN_LEN} AND {MAX_TOKEN_LEN})"


BASE = {
    "docs_tok": f"SELECT doc_id, {tok('text')} AS t FROM documents",
    "occ": "SELECT doc_id, len(t) AS dl, unnest(t) AS term, unnest(generate_series(0, len(t) - 1)) AS pos "
           "FROM docs_tok",
    "post": "SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl, min(pos) AS first_pos, "
            "max(pos) AS last_pos FROM occ GROUP BY doc_id, term",
    "lens": "SELECT doc_id, len(t) AS dl FROM docs_tok",
    "dfs": "SELECT term, count(*) AS df, ln((SELECT count(*)::DOUBLE FROM documents) / count(*)) AS idf "
           "FROM post GROUP BY term",
    "q_tok": f"SELECT item_id AS query_id, {tok('text')} AS t FROM benchmark",
    "qt": "SELECT query_id, term, count(*) AS mult, any_value(qlen) AS qlen FROM "
          "(SELECT query_id, len(t) AS qlen, unnest(t) AS term FROM q_tok) GROUP BY query_id, term",
    "cand": "SELECT query_id, doc_id, cand_rank FROM (SELECT qt.query_id, p.doc_id, "
            "row_number() OVER (PARTITION BY qt.query_id ORDER BY count(*) DESC, p.doc_id) AS cand_rank "
            "FROM qt JOIN post p ON p.term = qt.term GROUP BY qt.query_id, p.doc_id) WHERE cand_rank <= 50",
    "cells": "SELECT c.query_id, c.doc_id, qt.term, qt.mult, qt.qlen, l.dl, coalesce(p.tf, 0) AS tf "
             "FROM cand c JOIN qt ON qt.query_id = c.query_id JOIN lens l ON l.doc_id = c.doc_id "
             "LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = qt.term",
    "per_q": "SELECT query_id, avg(dl) AS avgdl, count(*)::DOUBLE AS n_cand FROM "
             "(SELECT DISTINCT query_id, doc_id, dl FROM cells) GROUP BY query_id",
    "cells_idf1": "SELECT c.*, coalesce(d.idf, 1.0) AS idf FROM cells c LEFT JOIN dfs d ON d.term = c.term",
    "cells_idf0": "SELECT c.*, coalesce(d.idf, 0.0) AS idf, q.avgdl, q.n_cand FROM cells c "
                  "LEFT JOIN dfs d ON d.term = c.term JOIN per_q q ON q.query_id = c.query_id",
}


def with_base(body: str, extra: dict | None = None) -> str:
    ctes = dict(BASE)
    ctes.update(extra or {})
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def ranked(inner: str, score: str, rank: bool = True) -> str:
    """Publish ``(item_id, doc_id, score[, rank])`` from ``inner(query_id, doc_id, <score>)``."""
    r = (f", row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC NULLS LAST, doc_id)"
         f" AS rank") if rank else ""
    return f"SELECT query_id AS item_id, doc_id, round({score}, 6) AS {score}{r} FROM ({inner})"


def bm25_term(idf: str = "idf") -> str:
    return (f"CASE WHEN tf > 0 THEN {idf} * (tf * (1.5 + 1)) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) "
            f"ELSE 0 END")


PROX = {
    "pocc": "SELECT c.query_id, c.doc_id, o.term, o.pos FROM cand c JOIN qt ON qt.query_id = c.query_id "
            "JOIN occ o ON o.doc_id = c.doc_id AND o.term = qt.term",
    "padj": "SELECT query_id, doc_id, term, pos - lag(pos) OVER w AS d, lag(term) OVER w AS pt FROM pocc "
            "WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)",
    "pd": "SELECT query_id, doc_id, min(d) AS d FROM padj WHERE pt IS NOT NULL AND pt <> term GROUP BY 1, 2",
    "pdup": "SELECT DISTINCT query_id, doc_id FROM cells WHERE mult >= 2 AND tf > 0",
    "prox": "SELECT c.query_id, c.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN 1.0 WHEN pd.d IS NULL THEN 0.0 "
            "ELSE 1.0 / (1 + pd.d) END AS proximity FROM cand c "
            "LEFT JOIN pdup u ON u.query_id = c.query_id AND u.doc_id = c.doc_id "
            "LEFT JOIN pd ON pd.query_id = c.query_id AND pd.doc_id = c.doc_id",
    "bm25g": f"SELECT query_id, doc_id, sum(mult * {bm25_term()}) AS bm25 FROM cells_idf0 GROUP BY 1, 2",
    "bm25l": "SELECT c.query_id, c.doc_id, sum(c.mult * CASE WHEN c.tf > 0 THEN "
             "ln(q.n_cand / (l.ldf + 1.0) + 1.0) * (c.tf * 2.5) / (c.tf + 1.5 * (1 - 0.75 + 0.75 * c.dl / q.avgdl)) "
             "ELSE 0 END) AS bm25 FROM cells c JOIN per_q q ON q.query_id = c.query_id "
             "JOIN (SELECT query_id, term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS ldf FROM cells GROUP BY 1, 2) l "
             "ON l.query_id = c.query_id AND l.term = c.term GROUP BY 1, 2",
}

OKAPI = {
    "okv": "SELECT c.query_id, p.term, count(*)::DOUBLE AS df FROM cand c JOIN post p ON p.doc_id = c.doc_id "
           "GROUP BY 1, 2",
    "okn": "SELECT query_id, count(*)::DOUBLE AS n FROM cand GROUP BY 1",
    "okr": "SELECT v.query_id, v.term, ln(n.n - v.df + 0.5) - ln(v.df + 0.5) AS idf FROM okv v "
           "JOIN okn n ON n.query_id = v.query_id",
    "oka": "SELECT query_id, avg(idf) AS a FROM okr GROUP BY 1",
    "oki": "SELECT r.query_id, r.term, CASE WHEN r.idf < 0 THEN 0.25 * a.a ELSE r.idf END AS idf FROM okr r "
           "JOIN oka a ON a.query_id = r.query_id",
}


def _clean(stop_list=()):
    p = tok("text", stop_list)
    return (f"SELECT doc_id, array_to_string({p}, ' ') AS proc_article, "
            f"len(string_split(array_to_string({p}, ' '), ' ')) AS proc_len FROM documents")


def _quorum(kind: str) -> str:
    if kind == "vanilla":
        expr = "sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END)::DOUBLE / count(*)"
        src = "cells"
    elif kind == "idf":
        expr = ("CASE WHEN sum(mult * idf) <> 0 THEN sum(CASE WHEN tf > 0 THEN mult * idf ELSE 0 END) "
                "/ sum(mult * idf) END")
        src = "cells_idf1"
    else:
        expr = ("CASE WHEN sum(mult * mult / qlen * idf) <> 0 THEN "
                "sum(CASE WHEN tf > 0 THEN mult * tf / dl * idf ELSE 0 END) / sum(mult * mult / qlen * idf) END")
        src = "cells_idf1"
    return f"SELECT query_id, doc_id, {expr} AS relevance FROM {src} GROUP BY query_id, doc_id"


QUORUM_SEARCH = {
    "qw": "SELECT qt.query_id, qt.term, qt.mult * coalesce(d.idf, 1.0) AS w FROM qt LEFT JOIN dfs d ON d.term = qt.term",
    "den": "SELECT query_id, sum(w) AS den FROM qw GROUP BY 1",
    "num": "SELECT qw.query_id, p.doc_id, sum(w) AS num FROM qw JOIN post p ON p.term = qw.term GROUP BY 1, 2",
    "rel": "SELECT n.query_id, n.doc_id, CASE WHEN d.den <> 0 THEN n.num / d.den END AS relevance "
           "FROM num n JOIN den d ON d.query_id = n.query_id",
}

ORACLE = {
    "clean_tokens": _clean(),
    "stopword_filter": _clean(stop_words("russian", "english")),
    "postings": with_base("SELECT doc_id, term, tf, dl, first_pos, last_pos FROM post"),
    "doc_lengths": with_base("SELECT doc_id, dl, round(dl / (SELECT avg(dl) FROM lens), 6) AS dl_rel FROM lens"),
    "doc_freq_idf": with_base("SELECT term, df, round(idf, 6) AS idf FROM dfs"),
    "quorum_search": with_base(
        "SELECT * FROM (" + ranked("SELECT * FROM rel", "relevance") + ") WHERE rank <= 10", QUORUM_SEARCH),
    "bm25f_topk": with_base("SELECT * FROM (" + ranked(
        "SELECT qt.query_id, p.doc_id, sum((ln((SELECT count(*)::DOUBLE FROM documents) / (d.df + 1.0)) + 1.0) * (p.tf * 2.2) / "
        "(p.tf + 1.2 * (0.25 + 0.75 * p.dl / (SELECT avg(dl) FROM lens)))) AS score FROM qt JOIN post p ON p.term = qt.term "
        "JOIN dfs d ON d.term = qt.term GROUP BY 1, 2", "score") + ") WHERE rank <= 10"),
    "quorum_vanilla": with_base(ranked(_quorum("vanilla"), "relevance")),
    "quorum_idf": with_base(ranked(_quorum("idf"), "relevance")),
    "quorum_tfidf": with_base(ranked(_quorum("tfidf"), "relevance")),
    "quorum_filter": with_base(ranked(f"SELECT * FROM ({_quorum('idf')}) WHERE relevance > 0.5",
                                      "relevance", rank=False)),
    "bm25_global": with_base(ranked("SELECT query_id, doc_id, bm25 AS score FROM bm25g", "score"), PROX),
    "bm25_local": with_base(ranked("SELECT b.query_id, b.doc_id, b.bm25 + 0.6 * p.proximity AS score FROM bm25l b "
                                   "JOIN prox p ON p.query_id = b.query_id AND p.doc_id = b.doc_id", "score"), PROX),
    "bm25_okapi": with_base(ranked(
        "SELECT c.query_id, c.doc_id, sum(c.mult * " + bm25_term("coalesce(o.idf, 0.0)") + ") AS score "
        "FROM (SELECT c.*, q.avgdl FROM cells c JOIN per_q q ON q.query_id = c.query_id) c "
        "LEFT JOIN oki o ON o.query_id = c.query_id AND o.term = c.term GROUP BY 1, 2", "score"), OKAPI),
    "proximity": with_base(ranked("SELECT * FROM prox", "proximity"), PROX),
    "bm25_proximity": with_base(ranked("SELECT b.query_id, b.doc_id, b.bm25 + 0.6 * p.proximity AS score FROM bm25g b "
                                       "JOIN prox p ON p.query_id = b.query_id AND p.doc_id = b.doc_id", "score"), PROX),
}


VEC = {
    "comp": "SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, "
            "unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i",
    "cen": "SELECT label AS query_id, list(x ORDER BY i) AS v FROM comp GROUP BY label",
    "cq": "SELECT query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS q "
          "FROM cen",
    "dist": "SELECT cq.query_id, e.vec_id, e.label, e.embedding::DOUBLE[] AS x, cq.q, "
            "list_distance(cq.q, e.embedding::DOUBLE[]) ^ 2 AS d2 FROM cq, embeddings e",
    "vk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), vec_id) AS rank "
          "FROM dist) WHERE rank <= 20",
    "shd": "SELECT * FROM (SELECT *, vec_id % 9 AS shard, row_number() OVER (PARTITION BY query_id, vec_id % 9 "
           "ORDER BY round(d2, 9), vec_id) AS srank FROM dist) WHERE srank <= 3",
}

ORACLE.update({
    "vector_topk": with_base("SELECT query_id, vec_id, round(d2, 6) AS d2, rank FROM vk", VEC),
    "vector_similarity": with_base(
        "SELECT query_id, vec_id, round(1.0 / (1.0 + 4.0 * d2 * d2), 6) AS similarity, rank FROM vk", VEC),
    "vector_topk_sharded": with_base(
        "SELECT query_id, vec_id, shard::INT AS shard, round(d2, 6) AS d2, row_number() OVER "
        "(PARTITION BY query_id ORDER BY round(d2, 9), vec_id) AS rank FROM shd", VEC),
    "cosine_rerank": with_base(
        "SELECT query_id, vec_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id "
        "ORDER BY round(c, 9) DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, "
        "list_dot_product(q, x) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x, x))) AS c FROM vk)", VEC),
    "vector_label_precision": with_base(
        "SELECT query_id, round(avg(CASE WHEN label = query_id THEN 1.0 ELSE 0.0 END), 6) AS precision, "
        "count(*) AS n FROM vk GROUP BY query_id", VEC),
    "self_recall": "WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id "
                   "ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ^ 2, 9), b.vec_id) "
                   "AS rank FROM embeddings a, embeddings b), s AS (SELECT query_id, rank FROM d "
                   "WHERE query_id = vec_id AND rank <= 12), q AS (SELECT e.vec_id AS query_id, s.rank FROM "
                   "embeddings e LEFT JOIN s ON s.query_id = e.vec_id) SELECT count(*) AS n, "
                   "round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, "
                   "round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall_at_12 FROM q",
})


# --- full-text search, fusion, hybrid search ---------------------------------

def ctes(pairs) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in pairs)


def scoring(p: str, cand: str) -> list:
    """Cells, per-query stats, BM25 (global) and proximity over candidate table ``cand``."""
    return [
        (f"{p}cells", f"SELECT c.query_id, c.doc_id, qt.term, qt.mult, qt.qlen, l.dl, coalesce(po.tf, 0) AS tf "
                      f"FROM {cand} c JOIN qt ON qt.query_id = c.query_id JOIN lens l ON l.doc_id = c.doc_id "
                      f"LEFT JOIN post po ON po.doc_id = c.doc_id AND po.term = qt.term"),
        (f"{p}perq", f"SELECT query_id, avg(dl) AS avgdl FROM (SELECT DISTINCT query_id, doc_id, dl FROM {p}cells) "
                     f"GROUP BY query_id"),
        (f"{p}bm", f"SELECT c.query_id, c.doc_id, sum(c.mult * CASE WHEN c.tf > 0 THEN coalesce(d.idf, 0.0) * "
                   f"(c.tf * 2.5) / (c.tf + 1.5 * (1 - 0.75 + 0.75 * c.dl / q.avgdl)) ELSE 0 END) AS bm25 "
                   f"FROM {p}cells c LEFT JOIN dfs d ON d.term = c.term JOIN {p}perq q ON q.query_id = c.query_id "
                   f"GROUP BY 1, 2"),
        (f"{p}rel", f"SELECT c.query_id, c.doc_id, CASE WHEN sum(c.mult * coalesce(d.idf, 1.0)) <> 0 THEN "
                    f"sum(CASE WHEN c.tf > 0 THEN c.mult * coalesce(d.idf, 1.0) ELSE 0 END) / "
                    f"sum(c.mult * coalesce(d.idf, 1.0)) END AS relevance FROM {p}cells c "
                    f"LEFT JOIN dfs d ON d.term = c.term GROUP BY 1, 2"),
        (f"{p}pocc", f"SELECT c.query_id, c.doc_id, o.term, o.pos FROM {cand} c JOIN qt ON qt.query_id = c.query_id "
                     f"JOIN occ o ON o.doc_id = c.doc_id AND o.term = qt.term"),
        (f"{p}padj", f"SELECT query_id, doc_id, term, pos - lag(pos) OVER w AS d, lag(term) OVER w AS pt "
                     f"FROM {p}pocc WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)"),
        (f"{p}pd", f"SELECT query_id, doc_id, min(d) AS d FROM {p}padj WHERE pt IS NOT NULL AND pt <> term "
                   f"GROUP BY 1, 2"),
        (f"{p}pdup", f"SELECT DISTINCT query_id, doc_id FROM {p}cells WHERE mult >= 2 AND tf > 0"),
        (f"{p}prox", f"SELECT c.query_id, c.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN 1.0 WHEN x.d IS NULL "
                     f"THEN 0.0 ELSE 1.0 / (1 + x.d) END AS proximity FROM {cand} c "
                     f"LEFT JOIN {p}pdup u ON u.query_id = c.query_id AND u.doc_id = c.doc_id "
                     f"LEFT JOIN {p}pd x ON x.query_id = c.query_id AND x.doc_id = c.doc_id"),
        (f"{p}bmp", f"SELECT b.query_id, b.doc_id, b.bm25, b.bm25 + 0.6 * x.proximity AS bmp FROM {p}bm b "
                    f"JOIN {p}prox x ON x.query_id = b.query_id AND x.doc_id = b.doc_id"),
    ]


_BASE_HEAD = [(k, BASE[k]) for k in ("docs_tok", "occ", "post", "lens", "dfs", "q_tok", "qt")]
_SW_RU = stop_words("russian")

TEXT = [
    ("qw_tok", f"SELECT item_id AS query_id, {tok('text', _SW_RU)} AS t FROM benchmark"),
    ("conds", "SELECT query_id, lvl AS level, st AS start, "
              "list_distinct(list_slice(t, st + 1, st + len(t) - lvl)) AS terms "
              "FROM qw_tok, range(0, 3) a(lvl), range(0, 3) b(st) "
              "WHERE len(t) >= 1 AND lvl <= least(2, len(t) - 1) AND st <= lvl"),
    ("ctm", "SELECT query_id, level, start, len(terms) AS need, unnest(terms) AS term FROM conds"),
    ("pt", "SELECT p.doc_id, p.term, p.tf, p.dl, ln((SELECT count(*)::DOUBLE FROM documents) / (d.df + 1.0)) + 1.0 "
           "AS idf FROM post p JOIN dfs d ON d.term = p.term WHERE p.term IN (SELECT term FROM ctm)"),
    ("rhits", "SELECT c.query_id, c.level, c.start, pt.doc_id, count(*) AS got, any_value(c.need) AS need, "
              "sum(pt.idf * (pt.tf * (1.2 + 1)) / (pt.tf + 1.2 * ((1 - 0.75) + 0.75 * pt.dl / "
              "(SELECT avg(dl) FROM lens)))) / (1.0 + c.level) AS score FROM ctm c JOIN pt ON pt.term = c.term "
              "GROUP BY 1, 2, 3, 4"),
    ("rtop", "SELECT * FROM (SELECT query_id, level, start, doc_id, score, row_number() OVER (PARTITION BY query_id, "
             "level, start ORDER BY round(score, 9) DESC, doc_id) AS hit_rank FROM rhits WHERE got = need) "
             "WHERE hit_rank <= 10"),
    ("tnorm", "SELECT r.query_id, r.level, r.start, r.doc_id, r.score, (r.score - m.mn + 0.1) / (m.mx - m.mn + 0.5) "
              "AS text_score FROM rtop r JOIN (SELECT query_id, min(score) AS mn, max(score) AS mx FROM rtop "
              "GROUP BY 1) m ON m.query_id = r.query_id"),
]

HVEC = [
    ("dv", "SELECT doc_id, b, sum(tf)::DOUBLE AS v FROM (SELECT doc_id, tf, "
           "('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b FROM post) GROUP BY 1, 2"),
    ("qv", "SELECT query_id, b, sum(tf)::DOUBLE AS v FROM (SELECT query_id, mult AS tf, "
           "('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b FROM qt) GROUP BY 1, 2"),
    ("dnv", "SELECT doc_id, b, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS u FROM dv"),
    ("qnv", "SELECT query_id, b, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS u FROM qv"),
    ("dss", "SELECT doc_id, sum(u * u) AS ss FROM dnv GROUP BY 1"),
    ("qss", "SELECT query_id, sum(u * u) AS ss FROM qnv GROUP BY 1"),
    ("dots", "SELECT q.query_id, d.doc_id, sum(q.u * d.u) AS dot FROM qnv q JOIN dnv d ON d.b = q.b GROUP BY 1, 2"),
    ("vd", "SELECT q.query_id, d.doc_id, greatest(q.ss + d.ss - 2 * coalesce(o.dot, 0), 0) AS d2 FROM qss q "
           "CROSS JOIN dss d LEFT JOIN dots o ON o.query_id = q.query_id AND o.doc_id = d.doc_id"),
    ("vtop", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), doc_id) "
             "AS vr FROM vd) WHERE vr <= 50"),
    ("fu", "SELECT query_id, doc_id, sum(w) AS fused FROM (SELECT query_id, doc_id, 1.0 / (1.0 + 4.0 * d2 * d2) AS w "
           "FROM vtop UNION ALL SELECT query_id, doc_id, text_score AS w FROM tnorm) GROUP BY 1, 2"),
    ("fk", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, doc_id) "
           "AS fused_rank FROM fu) WHERE fused_rank <= 50"),
]

HYB = _BASE_HEAD + TEXT + HVEC + scoring("f_", "fk") + [
    ("kept", "SELECT k.query_id, k.doc_id, k.fused_rank FROM fk k JOIN f_rel r ON r.query_id = k.query_id "
             "AND r.doc_id = k.doc_id WHERE r.relevance > 0.0"),
] + scoring("k_", "kept") + [
    ("hs", "SELECT b.query_id, b.doc_id, b.bmp AS score, row_number() OVER (PARTITION BY b.query_id ORDER BY "
           "round(b.bmp, 9) DESC, k.fused_rank, b.doc_id) AS rank FROM k_bmp b JOIN kept k "
           "ON k.query_id = b.query_id AND k.doc_id = b.doc_id"),
    ("meta", "SELECT doc_id, concat_ws('/', source, doc_id::VARCHAR) AS url, lang, n_chars, text AS article "
             "FROM documents"),
]

CASC = _BASE_HEAD + [("cand", BASE["cand"])] + scoring("c1_", "cand") + [
    ("r1", "SELECT b.query_id, b.doc_id, b.bm25 AS score, row_number() OVER (PARTITION BY b.query_id ORDER BY "
           "round(b.bm25, 9) DESC, c.cand_rank, b.doc_id) AS rank, count(*) OVER (PARTITION BY b.query_id) AS n "
           "FROM c1_bm b JOIN cand c ON c.query_id = b.query_id AND c.doc_id = b.doc_id"),
    ("st2", "SELECT * FROM r1 WHERE floor(n * 0.1) + 1 > 1 AND rank <= floor(n * 0.1) + 1"),
] + scoring("c2_", "st2") + [
    ("casc", "SELECT b.query_id, b.doc_id, b.bmp AS score, row_number() OVER (PARTITION BY b.query_id ORDER BY "
             "round(b.bmp, 9) DESC, s.rank, b.doc_id) AS final_rank FROM c2_bmp b JOIN st2 s "
             "ON s.query_id = b.query_id AND s.doc_id = b.doc_id "
             "UNION ALL SELECT query_id, doc_id, score, rank AS final_rank FROM r1 WHERE floor(n * 0.1) + 1 <= 1"),
]

ORACLE.update({
    "relaxed_and_conditions": ctes(_BASE_HEAD + TEXT) + "\nSELECT query_id AS item_id, level, start, "
                              "len(terms) AS n_terms, array_to_string(list_sort(terms), ' ') AS terms FROM conds",
    "relaxed_and_search": ctes(_BASE_HEAD + TEXT) + "\nSELECT query_id AS item_id, level, start, doc_id, "
                          "round(score, 6) AS score, hit_rank FROM rtop",
    "text_score_norm": ctes(_BASE_HEAD + TEXT) + "\nSELECT query_id AS item_id, level, start, doc_id, "
                       "round(text_score, 6) AS text_score FROM tnorm",
    "hybrid_fusion": ctes(HYB) + "\nSELECT query_id AS item_id, doc_id, round(fused, 6) AS fused, fused_rank FROM fk",
    "metadata_lookup": ctes(HYB) + "\nSELECT k.query_id AS item_id, k.fused_rank, k.doc_id, coalesce(m.url, 'stub') "
                       "AS url, coalesce(m.lang, 'stub') AS lang, m.n_chars FROM fk k LEFT JOIN meta m "
                       "ON m.doc_id = k.doc_id",
    "hybrid_search": ctes(HYB) + "\nSELECT query_id AS item_id, doc_id, rank, round(score, 6) AS score FROM hs",
    "cascade_rerank": ctes(CASC) + "\nSELECT query_id AS item_id, doc_id, final_rank, round(score, 6) AS score "
                      "FROM casc",
    "answer_text": ctes(HYB) + "\nSELECT b.item_id AS item_id, CASE WHEN u.urls IS NOT NULL AND len(u.urls) > 0 THEN "
                   "'Ответ на вопрос ' || b.text || ': - \n\n' || array_to_string(u.urls, chr(10)) ELSE "
                   "'Ответ на вопрос ' || b.text || ': ничего не найдено' END AS response FROM benchmark b "
                   "LEFT JOIN (SELECT h.query_id, list(m.url ORDER BY h.rank) AS urls FROM hs h JOIN meta m "
                   "ON m.doc_id = h.doc_id GROUP BY h.query_id) u ON u.query_id = b.item_id",
    "history_split": "WITH u AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM "
                     "conversations WHERE role = 'user' GROUP BY conv_id), "
                     "qs AS (SELECT conv_id, unnest(string_split(body, chr(10) || chr(10))) AS query, "
                     "unnest(generate_series(0, len(string_split(body, chr(10) || chr(10))) - 1)) AS q_no FROM u), "
                     "nx AS (SELECT role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations "
                     "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
                     "h AS (SELECT text AS query, min(nt) AS response FROM nx WHERE role = 'user' AND nr = 'assistant' GROUP BY text) "
                     "SELECT conv_id, q_no, CASE WHEN h.query IS NOT NULL THEN 1 ELSE 0 END AS from_history, h.response "
                     "FROM qs LEFT JOIN h ON h.query = qs.query",
})


# --- ingestion and evaluation ---------------------------------------------------

_LI = "(?s)<li[^>]*>.*?<a[^>]*>(.*?)</a>"
PAGES = [
    ("blk", "SELECT page_id, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS b FROM pages"),
    ("items", f"SELECT page_id, unnest(regexp_extract_all(b, '{_LI}', 1)) AS x, "
              f"unnest(generate_series(1, len(regexp_extract_all(b, '{_LI}', 1)))) AS i FROM blk WHERE b <> ''"),
    ("hd", "SELECT page_id, i, trim(regexp_replace(trim(x), '^\\S+\\s+', '')) || '.' AS heading FROM items "
           "WHERE trim(x) <> ''"),
    ("hf", "SELECT page_id, heading, min(i) AS i FROM hd GROUP BY 1, 2"),
    ("heads", "SELECT b.page_id, coalesce(h.hs, []) AS headings FROM blk b LEFT JOIN (SELECT page_id, "
              "list(heading ORDER BY i) AS hs FROM hf GROUP BY 1) h ON h.page_id = b.page_id WHERE b.b <> ''"),
    ("pl", "SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<.*?>', '', 'g') "
           "AS title, list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(regexp_replace("
           "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<h1[^>]*>.*?</h1>', '', 'g'), "
           "'<br>|</p>|</li>|</h[1-6]>', chr(10), 'g'), '<.*?>', '', 'g'), chr(160), ' '), chr(10)), "
           "lambda l: trim(l)), lambda l: l <> '') AS lines FROM pages"),
    ("ln", "SELECT p.page_id, p.url, p.title, h.headings, unnest(p.lines) AS line, "
           "unnest(generate_series(0, len(p.lines) - 1)) AS i FROM pl p JOIN heads h ON h.page_id = p.page_id"),
    ("lh", "SELECT *, CASE WHEN length(line) < 100 AND list_contains(headings, line) THEN 1 ELSE 0 END AS h FROM ln"),
    ("ls", "SELECT *, sum(h) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT "
           "AS section_no FROM lh"),
    ("sb", "SELECT page_id, section_no, any_value(url) AS url, any_value(title) AS title, "
           "string_agg(line, ' ' ORDER BY i) AS body FROM ls WHERE h = 0 GROUP BY 1, 2"),
    ("sh", "SELECT page_id, section_no, line AS heading FROM ls WHERE h = 1"),
    ("sec0", "SELECT b.page_id, b.section_no, b.url, b.title, coalesce(s.heading, '') AS heading, b.body FROM sb b "
             "LEFT JOIN sh s ON s.page_id = b.page_id AND s.section_no = b.section_no"),
    ("sec", f"SELECT page_id, section_no, CASE WHEN length(heading) > 0 THEN url || '#' || "
            f"replace(substr(heading, 1, length(heading) - 1), ' ', '_') ELSE url END AS url, "
            f"CASE WHEN length(heading) > 0 THEN title || '. ' || heading ELSE title END AS title, "
            f"title || '. ' || heading || ' ' || body AS article FROM sec0"),
    ("secp", f"SELECT *, array_to_string({tok('article', stop_words('russian'))}, ' ') AS proc_article FROM sec"),
]

TRUTH = [
    ("tr", "SELECT b.item_id AS query_id, d.doc_id, d.source AS page FROM benchmark b, documents d "
           "WHERE instr(d.text, b.text) > 0"),
]

DUMP = [
        ("dd", "SELECT floor(page_id / 100)::BIGINT AS file, page_id, '<doc id=\"' || page_id::VARCHAR || "
               "'\" url=\"' || url || '\" title=\"' || title || '\">' || chr(10) || title || chr(10) || chr(10) || "
               "array_to_string(lines, chr(10)) || chr(10) || '</doc>' || chr(10) AS d FROM pl"),
        ("du", "SELECT file, string_agg(d, '' ORDER BY page_id) AS value FROM dd GROUP BY file"),
        ("pc", "SELECT file, unnest(string_split(value, '<doc id=')) AS piece, "
               "unnest(generate_series(1, len(string_split(value, '<doc id=')))) AS n FROM du"),
        ("ar", "SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) AS article_no, '<doc id=' || piece "
               "AS article FROM pc WHERE piece <> ''"),
]

# The lines of a page with its own headings before every second one.
SPLIT = []
for _name, _sql in PAGES:
    if _name == "ln":
        SPLIT.append(("pl2", "SELECT p.page_id, p.url, p.title, flatten(list_transform(p.lines, lambda l, i: CASE WHEN "
                             "i % 2 = 0 AND i // 2 <= len(h.headings) THEN [h.headings[i // 2], l] ELSE [l] END)) AS lines "
                             "FROM pl p JOIN heads h ON h.page_id = p.page_id"))
        _sql = _sql.replace("FROM pl p", "FROM pl2 p")
    SPLIT.append((_name, _sql))

ORACLE.update({
    "sections_split": ctes(SPLIT) + "\nSELECT page_id, section_no, url, title, proc_article, "
                      "len(string_split(proc_article, ' ')) AS proc_len FROM secp",
    # the texts have no Cyrillic letter, so stems are the words themselves
    "section_store": ctes([("pages_all", "SELECT * FROM pages WHERE length(html) >= 2000")]
                          + [(n, q.replace("FROM pages", "FROM pages_all")) for n, q in PAGES])
                     + "\nSELECT 999 + row_number() OVER (ORDER BY page_id, section_no) AS doc_id, page_id, section_no, "
                       "proc_article AS stem_article FROM secp",
    "text_lookup": ctes(PAGES) + "\nSELECT row_number() OVER (ORDER BY page_id, section_no) - 1 AS doc_id, url, "
                   "md5(article) AS article_md5, proc_article AS text FROM secp",
    "whole_articles": ctes(PAGES + DUMP + [
        ("st", "SELECT file, article_no, regexp_extract(article, 'http([^\"]+)', 0) AS url, "
               "regexp_replace(article, '<.*?>', '', 'g') AS t FROM ar WHERE length(article) >= 500"),
        ("sp", "SELECT file, article_no, url, substr(t, 2, instr(t, chr(10) || chr(10)) - 2) AS title, "
               "replace(substr(t, instr(t, chr(10) || chr(10))), chr(10), '') AS article FROM st"),
        ("pr", f"SELECT *, array_to_string({tok('article', stop_words('russian', 'english'))}, ' ') AS proc_article FROM sp"),
    ]) + "\nSELECT file, article_no, url, title, article, proc_article, len(string_split(proc_article, ' ')) AS proc_len "
         "FROM pr",
    "toc_headings": ctes(PAGES) + "\nSELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 "
                    "AS heading_no, heading FROM hf",
    "strip_tags": "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages",
    "first_url": "SELECT page_id, regexp_extract(html, 'http([^\"]+)', 0) AS url FROM pages",
    "sections": ctes(PAGES) + "\nSELECT page_id, section_no, url, title, proc_article, "
                "len(string_split(proc_article, ' ')) AS proc_len FROM secp",
    "dense_ids": ctes(PAGES) + "\nSELECT row_number() OVER (ORDER BY page_id, section_no) - 1 AS doc_id, page_id, "
                 "section_no FROM sec",
    "store_consistency": ctes(PAGES + [("st", f"SELECT len({tok('article')}) AS n FROM sec")])
                         + "\nSELECT sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS n_vectors, count(*) AS n_meta, "
                         "sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS n_both, 0::BIGINT AS only_vectors, "
                         "sum(CASE WHEN n > 0 THEN 0 ELSE 1 END)::BIGINT AS only_meta FROM st",
    "split_articles": ctes(PAGES + DUMP) + "\nSELECT file, article_no, regexp_extract(article, 'http([^\"]+)', 0) AS url, "
         "coalesce(string_split(article, chr(10))[2], '') AS title, length(article) AS n_chars FROM ar "
         "WHERE length(article) >= 500",
    "title_leak": ctes(PAGES) + "\nSELECT page_id, CASE WHEN len(list_filter(lines, lambda l: NOT contains(lower(l), "
                  "lower(title)))) = 0 THEN 1 ELSE 0 END AS leak FROM pl WHERE len(lines) > 0",
    "passage_truth": ctes(TRUTH) + "\nSELECT query_id AS item_id, doc_id FROM tr",
    "latency_report": "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, "
                      "round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max "
                      "FROM events GROUP BY event_type",
})

EVAL = HYB + TRUTH + [
    ("res", "SELECT h.query_id, h.doc_id, h.rank, d.source AS page FROM hs h JOIN documents d ON d.doc_id = h.doc_id"),
    ("fs", "SELECT r.query_id, min(r.rank) AS s FROM res r JOIN (SELECT DISTINCT query_id, doc_id FROM tr) t "
           "ON t.query_id = r.query_id AND t.doc_id = r.doc_id GROUP BY 1"),
    ("fl", "SELECT r.query_id, min(r.rank) AS l FROM res r JOIN (SELECT DISTINCT query_id, page FROM tr) t "
           "ON t.query_id = r.query_id AND t.page = r.page GROUP BY 1"),
    ("mp", "SELECT q.query_id, coalesce(fs.s - 1, -1) AS pos_strong, coalesce(fl.l - 1, -1) AS pos_light FROM "
           "(SELECT DISTINCT query_id FROM tr) q LEFT JOIN fs ON fs.query_id = q.query_id "
           "LEFT JOIN fl ON fl.query_id = q.query_id"),
    ("mv", "SELECT m.metric, CASE m.metric WHEN 'inv_5' THEN CASE WHEN pos_strong = -1 THEN 0.0 ELSE "
           "5.0 / (pos_strong + 5) END ELSE (pos_strong > -1 AND pos_strong < m.k)::DOUBLE END AS s, "
           "CASE m.metric WHEN 'inv_5' THEN CASE WHEN pos_light = -1 THEN 0.0 ELSE 5.0 / (pos_light + 5) END "
           "ELSE (pos_light > -1 AND pos_light < m.k)::DOUBLE END AS l FROM mp, (VALUES ('in_top_5', 5), "
           "('in_top_15', 15), ('in_top_30', 30), ('inv_5', 0)) m(metric, k)"),
]

ROC = [
    ("ds", "SELECT doc_id, round(count(*) / any_value(dl), 6) AS score FROM post GROUP BY doc_id"),
    ("lab", "SELECT l.quality AS label, coalesce(s.score, 0) AS score FROM labels l JOIN documents d "
            "ON d.doc_id = l.doc_id LEFT JOIN ds s ON s.doc_id = l.doc_id"),
    ("g", "SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM lab GROUP BY score"),
    ("cum", "SELECT *, sum(pos) OVER (ORDER BY score) AS cum_pos, sum(neg) OVER (ORDER BY score) AS cum_neg FROM g"),
    ("tot", "SELECT sum(pos)::DOUBLE AS P, sum(neg)::DOUBLE AS N FROM g"),
    ("pts", "SELECT score::DOUBLE AS score, (P - cum_pos) / P AS tpr, (N - cum_neg) / N AS fpr, "
            "(P - (cum_pos - pos)) / P AS prev_tpr, (N - (cum_neg - neg)) / N AS prev_fpr FROM cum, tot"),
]

NEG = TRUTH + [
    ("tq", "SELECT t.query_id, t.doc_id, b.text AS query, t.query_id % 9 AS file FROM tr t "
           "JOIN benchmark b ON b.item_id = t.query_id"),
    ("tn", "SELECT *, row_number() OVER (PARTITION BY file ORDER BY query_id, doc_id) - 1 AS row_no FROM tq"),
    ("sz", "SELECT file, count(*) AS n FROM tn GROUP BY file"),
    ("want", "SELECT t.doc_id, (t.file + 5) % 9 AS tf, CASE WHEN s.n > 1 THEN (t.doc_id * 7919 + t.row_no * 104729) "
             "% (s.n - 1) ELSE 0 END AS pick FROM tn t JOIN sz s ON s.file = (t.file + 5) % 9"),
]

ORACLE.update({
    "match_positions": ctes(EVAL) + "\nSELECT query_id AS item_id, pos_strong, pos_light FROM mp",
    "metrics": ctes(EVAL) + "\nSELECT metric, round(avg(s), 6) AS strong, round(avg(l), 6) AS light FROM mv "
               "GROUP BY metric",
    "roc_curve": ctes(_BASE_HEAD + ROC) + "\nSELECT NULL::DOUBLE AS score, 1.0 AS tpr, 1.0 AS fpr UNION ALL "
                 "SELECT score, round(tpr, 6), round(fpr, 6) FROM pts",
    "roc_auc": ctes(_BASE_HEAD + ROC) + "\nSELECT round(sum((prev_fpr - fpr) * (prev_tpr + tpr) / 2.0), 6) AS auc "
               "FROM pts",
    "negative_pairs": ctes(NEG) + "\nSELECT doc_id, query, 1 AS relevant FROM tn UNION ALL SELECT w.doc_id, "
                      "t.query, 0 AS relevant FROM want w JOIN tn t ON t.file = w.tf AND t.row_no = w.pick",
})

ORACLE["stage_percentiles"] = (
    "SELECT event_type AS stage, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.9), 6) AS p90, "
    "round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")

ORACLE["scorer_plug"] = ctes(_BASE_HEAD + [("cand", BASE["cand"])]) + (
    "\nSELECT c.query_id AS item_id, c.doc_id, round(length(b.text) / (length(b.text) + length(d.text)), 6) AS score "
    "FROM cand c JOIN documents d ON d.doc_id = c.doc_id JOIN benchmark b ON b.item_id = c.query_id")

ORACLE["summary_context"] = ctes(HYB) + (
    "\nSELECT b.item_id, array_to_string(list_slice(regexp_split_to_array(trim('Нади ответ на вопрос:  ' || b.text || "
    "chr(10) || d.docs), '\\s+'), 1, 512), ' ') AS context FROM benchmark b JOIN (SELECT h.query_id, "
    "string_agg(m.article, chr(10) ORDER BY h.rank) AS docs FROM hs h JOIN meta m ON m.doc_id = h.doc_id "
    "WHERE h.rank <= 5 GROUP BY h.query_id) d ON d.query_id = b.item_id")


def _grid_sql(ks=(20, 50)) -> str:
    """Every (ranker, k): candidates, quorum, ranking, positions and metrics spelled out for each."""
    parts, tables = _BASE_HEAD + TEXT + [x for x in HVEC if x[0] not in ("fu", "fk")] + TRUTH, []
    for k in ks:
        parts = parts + [
            (f"fu{k}", "SELECT query_id, doc_id, sum(w) AS fused FROM (SELECT query_id, doc_id, 1.0 / (1.0 + 4.0 * d2 * d2) "
                       f"AS w FROM vtop WHERE vr <= {k} UNION ALL SELECT query_id, doc_id, text_score AS w FROM tnorm) "
                       "GROUP BY 1, 2"),
            (f"fk{k}", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, "
                       f"doc_id) AS fused_rank FROM fu{k}) WHERE fused_rank <= {k}"),
        ] + scoring(f"f{k}_", f"fk{k}") + [
            (f"kept{k}", f"SELECT k.query_id, k.doc_id, k.fused, k.fused_rank FROM fk{k} k JOIN f{k}_rel r ON "
                         "r.query_id = k.query_id AND r.doc_id = k.doc_id WHERE r.relevance > 0.0"),
        ] + scoring(f"k{k}_", f"kept{k}")
        scores = {"none": f"SELECT query_id, doc_id, fused AS s FROM kept{k}",
                  "bm25_proximity": f"SELECT query_id, doc_id, bmp AS s FROM k{k}_bmp",
                  "idf": f"SELECT query_id, doc_id, relevance AS s FROM k{k}_rel"}
        for ranker, sql in scores.items():
            p = f"{ranker}{k}"
            parts = parts + [
                (f"rk_{p}", "SELECT s.query_id, s.doc_id, d.source AS page, row_number() OVER (PARTITION BY s.query_id "
                            "ORDER BY round(s.s, 9) DESC, c.fused_rank, s.doc_id) - 1 AS pos "
                            f"FROM ({sql}) s JOIN kept{k} c ON c.query_id = s.query_id AND c.doc_id = s.doc_id "
                            "JOIN documents d ON d.doc_id = s.doc_id"),
                (f"mp_{p}", "SELECT q.query_id, coalesce((SELECT min(pos) FROM rk_" + p + " r JOIN tr t ON t.query_id = "
                            "r.query_id AND t.doc_id = r.doc_id WHERE r.query_id = q.query_id), -1) AS strong, "
                            "coalesce((SELECT min(pos) FROM rk_" + p + " r JOIN tr t ON t.query_id = r.query_id AND "
                            "t.page = r.page WHERE r.query_id = q.query_id), -1) AS light "
                            "FROM (SELECT DISTINCT query_id FROM tr) q")]
            for metric, value in (("in_top_5", "(x > -1 AND x < 5)::DOUBLE"), ("in_top_15", "(x > -1 AND x < 15)::DOUBLE"),
                                  ("in_top_30", "(x > -1 AND x < 30)::DOUBLE"),
                                  ("inv_5", "CASE WHEN x = -1 THEN 0.0 ELSE 5.0 / (x + 5) END")):
                tables.append(f"SELECT '{ranker}' AS ranker, {k} AS k, '{metric}' AS metric, "
                              f"round(avg({value.replace('x', 'strong')}), 6) AS strong, "
                              f"round(avg({value.replace('x', 'light')}), 6) AS light FROM mp_{p}")
    return ctes(parts) + "\n" + "\nUNION ALL ".join(tables)


ORACLE["metrics_grid"] = _grid_sql()
