import os
import random
import zlib

import duckdb
import numpy as np

import __spark_entry__ as E
import corpus_pipeline as C
from seekspark.llm import decontam, line_spread, packing, quality_rules, queries, simhash, tokens
from tests.conftest import SF001
from tests.llm import test_decontam, test_packing, test_quality_rules, test_simhash

SITE_LINE = "this boilerplate line stands on every site there is"


def corpus():
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, passage = [], " ".join(f"bench{i}" for i in range(25))
    for i in range(40):
        text = "\n".join(" ".join(rng.choices(vocabulary, k=30)) for _ in range(3))
        rows.append((i, text + ("\n" + SITE_LINE if i % 2 else ""), f"site{i % 13}"))
    rows[30:33] = [(30 + k, rows[5][1], f"site{k}") for k in range(3)]
    rows[33] = (33, rows[33][1] + " Bench0 " + passage.replace("bench0 ", "") + " end", "site1")
    rows += [(40, "too short", "s"), (41, None, "s"), (42, "", "s"), (43, "again and " * 60, "s"), (None, rows[7][1] + " more", "s")]
    return rows, [(1, passage)]


def write(spark, path, rows, bench, labelled):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, "
                          "source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in labelled], "doc_id long, quality int, toxic int").write.parquet(
        os.path.join(path, "labels.parquet"))


def brute(rows, bench, labelled):
    """The documents that reach the last stage, by plain loops."""
    scores = test_quality_rules.scores([(i, t) for i, t, _ in rows], labelled)
    good = []
    for (i, t, s), score in zip(rows, scores):
        n, _, _, _, repeats = test_quality_rules.base(t)
        if n >= quality_rules.MIN_WORDS and 100 * repeats <= 50 * n and score >= quality_rules.MIN_SCORE:
            good.append((i, t, s))
    sites, first = {}, {}
    for i, t, s in good:
        for pos, line in enumerate(t.split("\n")):
            if len(line.split()) >= line_spread.MIN_WORDS:
                sites.setdefault(line, set()).add(s)
                first[line] = min(first.get(line, (True, i or 0, pos)), (i is not None, i or 0, pos))
    stripped = []
    for i, t, s in good:
        kept = [x for pos, x in enumerate(t.split("\n")) if len(sites.get(x, ())) < line_spread.MIN_SITES
                or first[x] == (i is not None, i or 0, pos)]
        if "".join(kept).strip():
            stripped.append((i, "\n".join(kept)))
    stay = {c for _, _, c in test_simhash.brute(stripped)}
    one = [(i, t) for i, t in stripped if i in stay]
    hit = {i for i, _, n, _ in test_decontam.brute(one, bench) if n}
    return [(i, t) for i, t in one if i not in hit]


def test_pipeline_against_brute_force(spark, tmpdir_path):
    rows, bench = corpus()
    labelled = list(range(0, 40, 2))
    write(spark, tmpdir_path, rows, bench, labelled)
    left = brute(rows, bench, set(labelled))
    assert {i for i, _ in left}.isdisjoint({30, 31, 32, 33, 40, 41, 42, 43}) and 5 in {i for i, _ in left}
    out = C.run(spark, tmpdir_path).collect()
    library, want = tokens.load(tokens.vocabulary(packing.VOCABULARY)), []
    for i, t in left:
        ids = library.encode(t, add_special_tokens=False).ids + [packing.END_ID]
        want += [(i, n, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, zlib.crc32(r.ids)) for r in out), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in out}) == len(test_packing.plain_best_fit([r.length for r in out], 4096))


def test_stages_keep_the_columns_and_bear_empty_input(spark, tmpdir_path):
    rows, bench = corpus()
    write(spark, tmpdir_path, rows[:3], bench, [])
    docs = spark.read.parquet(os.path.join(tmpdir_path, "documents.parquet")).limit(0)
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "simhash_neardup", "decontamination", "best_fit_packing"]
    for name, stage in C.STAGES:
        out = stage(spark, docs, tmpdir_path)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()


def test_sql_twins(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, SF001).collect()) == sorted(want.fetchall())


def test_language_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op6_language_id(spark, SF001).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i, r in rows.items() if r.held_out and truth[i]]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.9 * len(held)


def test_simhash_query_against_all_pairs(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.op2_simhash_neardup(spark, SF001).collect()
    want = [(i, f"{p:016x}", c) for i, p, c in test_simhash.brute(texts)]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)
    assert simhash.MAX_BITS == 2 and decontam.WINDOW == 10
