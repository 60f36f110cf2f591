import duckdb

import __spark_entry__ as E
from seekspark.sources.tables import TABLES
from tests.conftest import SF001

FAST = ["clean_tokens", "postings", "doc_freq_idf", "quorum_search", "bm25_proximity", "vector_topk",
        "relaxed_and_search", "hybrid_search", "sections", "roc_curve", "negative_pairs"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"item_id", "doc_id", "relevance", "rank"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False):
        rows.append("|".join("NULL" if v is None or (isinstance(v, float) and v != v)
                             else (f"{round(float(v), 6):.6f}" if isinstance(v, float) else str(v)) for v in rec))
    return sorted(rows)


def test_queries_match_oracle_small(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sql = E.oracle_sql()
    for name in FAST:
        sp = E.queries()[name](spark, SF001).toPandas()
        dk = con.execute(sql[name]).df()
        assert sorted(sp.columns) == sorted(dk.columns), name
        assert _norm(sp) == _norm(dk), name
