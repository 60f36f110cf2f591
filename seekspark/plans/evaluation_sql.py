"""DuckDB SQL of the queries in ``evaluation``."""

from __future__ import annotations

from .evaluation import STYLES
from .oracle import HVEC, TEXT, _BASE_HEAD, ctes


def _asked_sql() -> list:
    w = "string_split(replace(text, chr(10), ' '), ' ')"
    forms = ["replace(text, chr(10), ' ')", f"array_to_string(list_filter({w}, lambda w, i: (i - 1) % 3 = 0), ' ')",
             f"array_to_string(list_slice(list_filter({w}, lambda w: length(w) <= 4), 1, 6), ' ')",
             f"array_to_string(list_transform({w}, lambda w, i: CASE WHEN i <= 2 THEN w ELSE reverse(w) END), ' ')"]
    union = " UNION ALL ".join(f"SELECT item_id, {i} AS style, '{s}' AS file, {f} AS text FROM benchmark"
                               for i, (s, f) in enumerate(zip(STYLES, forms)))
    return [("right_doc", "SELECT b.item_id, max(d.doc_id) AS doc_id FROM benchmark b, documents d WHERE instr(d.text, b.text) > 0 GROUP BY 1"),
            ("asked", f"SELECT a.item_id * {len(STYLES)} + style AS item_id, a.file, a.text, r.doc_id, d.source AS page FROM ({union}) a "
                      "LEFT JOIN right_doc r ON r.item_id = a.item_id LEFT JOIN documents d ON d.doc_id = r.doc_id")]


def _scored_by(p: str, cand: str, keys: str) -> list:
    """Cells, BM25 with proximity (``bmp``) and idf quorum (``rel``) of candidates ``(keys, query_id, doc_id)``,
    with the averages of each setting taken over its own candidates."""
    on = " AND ".join(f"x.{c} = y.{c}" for c in [*(k.strip() for k in keys.split(",")), "query_id"])
    g = f"{keys}, query_id"
    return [
        (f"{p}_c", f"SELECT {keys}, x.query_id, x.doc_id, term, mult, dl, tf, idf0, idf1 FROM {cand} x JOIN cell y "
                   "ON x.query_id = y.query_id AND x.doc_id = y.doc_id"),
        (f"{p}_a", f"SELECT {g}, avg(dl) AS avgdl FROM (SELECT DISTINCT {g}, doc_id, dl FROM {p}_c) GROUP BY {g}"),
        (f"{p}_s", f"SELECT {', '.join('x.' + c.strip() for c in g.split(','))}, x.doc_id, sum(mult * CASE WHEN tf > 0 THEN idf0 * (tf * 2.5) / "
                   f"(tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END) + 0.6 * any_value(prox) AS bmp, "
                   f"sum(CASE WHEN tf > 0 THEN mult * idf1 ELSE 0 END) / sum(mult * idf1) AS rel "
                   f"FROM {p}_c x JOIN {p}_a y ON {on} JOIN prox o ON o.query_id = x.query_id AND o.doc_id = x.doc_id GROUP BY ALL"),
    ]


KS = "SELECT unnest([20, 50]) AS k"
GRID = ("SELECT row_number() OVER () - 1 AS config_id, * FROM (SELECT unnest(['None', 'BM25', 'Quorum']) AS ranker), "
        "(SELECT unnest(['None', 'BM25']) AS ranker2), (SELECT unnest([0.0, 0.3, 0.6])::DOUBLE AS threshold), "
        "(SELECT unnest([0.1, 1.0])::DOUBLE AS part), ks")


def grid_ctes(asked: list, ks: str = KS, grid: str = GRID) -> list:
    """Everything up to the metric values ``mv``, for questions ``asked(item_id, file, text, doc_id, page)``."""
    base = [(n, q.replace("FROM benchmark", "FROM asked")) for n, q in _BASE_HEAD + TEXT + [x for x in HVEC if x[0] not in ("fu", "fk")]]
    return asked + base + [
        ("ks", ks),
        ("grid", grid),
        ("fu", "SELECT k, query_id, doc_id, sum(w) AS fused FROM (SELECT k, query_id, doc_id, 1.0 / (1.0 + 4.0 * d2 * d2) AS w "
               "FROM vtop, ks WHERE vr <= k UNION ALL SELECT k, query_id, doc_id, text_score AS w FROM tnorm, ks) GROUP BY ALL"),
        ("fk", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(fused, 9) DESC, doc_id) "
               "AS fused_rank FROM fu) WHERE fused_rank <= k"),
        ("pair", "SELECT DISTINCT query_id, doc_id FROM fk"),
        ("cell", "SELECT c.query_id, c.doc_id, qt.term, qt.mult, l.dl, coalesce(p.tf, 0) AS tf, coalesce(d.idf, 0.0) AS idf0, "
                 "coalesce(d.idf, 1.0) AS idf1 FROM pair c JOIN qt ON qt.query_id = c.query_id JOIN lens l ON l.doc_id = c.doc_id "
                 "LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = qt.term LEFT JOIN dfs d ON d.term = qt.term"),
        ("occ_q", "SELECT c.query_id, c.doc_id, o.term, o.pos FROM pair c JOIN qt ON qt.query_id = c.query_id "
                  "JOIN occ o ON o.doc_id = c.doc_id AND o.term = qt.term"),
        ("adj", "SELECT query_id, doc_id, term, pos - lag(pos) OVER w AS d, lag(term) OVER w AS pt FROM occ_q "
                "WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)"),
        ("dist", "SELECT query_id, doc_id, min(d) AS d FROM adj WHERE pt IS NOT NULL AND pt <> term GROUP BY ALL"),
        ("prox", "SELECT c.query_id, c.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN 1.0 WHEN x.d IS NULL THEN 0.0 ELSE 1.0 / (1 + x.d) END "
                 "AS prox FROM pair c LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM cell WHERE mult >= 2 AND tf > 0) u "
                 "ON u.query_id = c.query_id AND u.doc_id = c.doc_id LEFT JOIN dist x ON x.query_id = c.query_id AND x.doc_id = c.doc_id"),
        ("quorum", "SELECT query_id, doc_id, sum(CASE WHEN tf > 0 THEN mult * idf1 ELSE 0 END) / sum(mult * idf1) AS rel "
                   "FROM cell GROUP BY ALL HAVING sum(mult * idf1) <> 0"),
        ("kept", "SELECT f.k, t.threshold, f.query_id, f.doc_id, f.fused, f.fused_rank FROM fk f JOIN quorum r ON r.query_id = f.query_id "
                 "AND r.doc_id = f.doc_id JOIN (SELECT DISTINCT threshold FROM grid) t ON r.rel > t.threshold"),
    ] + _scored_by("one", "kept", "k, threshold") + [
        ("rk", "SELECT 'None' AS ranker, k, threshold, query_id, doc_id, row_number() OVER (PARTITION BY k, threshold, query_id "
               "ORDER BY round(fused, 9) DESC, doc_id) AS rank FROM kept UNION ALL "
               + " UNION ALL ".join(
                   f"SELECT '{n}' AS ranker, s.k, s.threshold, s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.k, s.threshold, s.query_id "
                   f"ORDER BY round({c}, 9) DESC, x.fused_rank, s.doc_id) AS rank FROM one_s s JOIN kept x ON x.k = s.k AND "
                   "x.threshold = s.threshold AND x.query_id = s.query_id AND x.doc_id = s.doc_id" for n, c in (("BM25", "bmp"), ("Quorum", "rel")))),
        ("chosen", "SELECT g.config_id, g.ranker2, r.query_id, r.doc_id, r.rank, floor(count(*) OVER (PARTITION BY g.config_id, r.query_id) "
                   "* g.part) + 1 AS keep FROM rk r JOIN grid g USING (ranker, k, threshold)"),
        ("stage2", "SELECT config_id, query_id, doc_id, rank FROM chosen WHERE ranker2 <> 'None' AND keep > 1 AND rank <= keep"),
    ] + _scored_by("two", "stage2", "config_id") + [
        ("final", "SELECT config_id, query_id, doc_id, rank FROM chosen WHERE ranker2 = 'None' OR keep <= 1 UNION ALL "
                  "SELECT s.config_id, s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.config_id, s.query_id ORDER BY round(bmp, 9) DESC, "
                  "x.rank, s.doc_id) AS rank FROM two_s s JOIN stage2 x ON x.config_id = s.config_id AND x.query_id = s.query_id "
                  "AND x.doc_id = s.doc_id"),
        ("mp", "SELECT g.config_id, a.item_id AS query_id, a.file, coalesce(min(f.rank) FILTER (WHERE f.doc_id = a.doc_id) - 1, -1) AS pos_strong, "
               "coalesce(min(f.rank) FILTER (WHERE d.source = a.page) - 1, -1) AS pos_light FROM grid g JOIN asked a ON true "
               "LEFT JOIN final f ON f.config_id = g.config_id AND f.query_id = a.item_id LEFT JOIN documents d ON d.doc_id = f.doc_id GROUP BY ALL"),
        ("mv", "SELECT config_id, query_id, file, metric, CASE metric WHEN 'inv_5' THEN CASE WHEN pos_strong = -1 THEN 0.0 ELSE 5.0 / (pos_strong + 5) "
               "END ELSE (pos_strong > -1 AND pos_strong < top)::DOUBLE END AS s, CASE metric WHEN 'inv_5' THEN CASE WHEN pos_light = -1 "
               "THEN 0.0 ELSE 5.0 / (pos_light + 5) END ELSE (pos_light > -1 AND pos_light < top)::DOUBLE END AS l FROM mp, (VALUES "
               "('in_top_5', 5), ('in_top_15', 15), ('in_top_30', 30), ('inv_5', 0)) m(metric, top)"),
    ]


ORACLE = {
    "evaluation_grid": ctes(grid_ctes(_asked_sql())) + "\nSELECT g.ranker, g.ranker2, g.threshold, g.part, g.k, metric, round(avg(s), 6) AS strong, "
                       "round(avg(l), 6) AS light FROM (SELECT config_id, file, metric, avg(s) AS s, avg(l) AS l FROM mv GROUP BY ALL) m "
                       "JOIN grid g ON g.config_id = m.config_id GROUP BY ALL",
    "styled_positions": ctes(grid_ctes(_asked_sql())) + "\nSELECT file, pos_strong, pos_light, count(*) AS n FROM mp GROUP BY ALL",
}
