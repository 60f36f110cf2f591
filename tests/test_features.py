"""State, files and loops: appends that die, histories that fill, records cut by splits, questions asked again."""

import csv
import glob
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from seekspark.operators import pairs as P
from seekspark.operators.generate import generate_queries
from seekspark.plans import features
from seekspark.sources import files as FS
from seekspark.sources import positions as POS
from seekspark.sources.query_files import write_question_files
from seekspark.streaming.requests import History, answer_requests, start_request_answering
from seekspark.streaming.store import SectionStore, start_store_ingestion
from tests.conftest import SF001


def _pages(spark):
    return spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html")


def _counts(df):
    return tuple(df.first())


class Died(Exception):
    pass


def test_a_batch_that_died_between_the_stores_is_finished(spark, tmpdir_path):
    store = SectionStore(spark, os.path.join(tmpdir_path, "s"))
    pages = _pages(spark)
    a, b = pages.filter("page_id < 20"), pages.filter("page_id >= 20")
    na = store.append(a, 0)
    encode, store.encode = store.encode, lambda meta: (_ for _ in ()).throw(Died())
    with pytest.raises(Died):
        store.append(b, 1)
    n_all = store.written("meta").count()
    assert _counts(store.consistency(committed=False)) == (na, n_all, na, 0, n_all - na) and n_all > na
    assert _counts(store.consistency()) == (na, na, na, 0, 0)      # readers see neither half
    before = store.written("meta").filter("batch = 1").select("doc_id", "url").collect()
    store.encode = encode
    assert store.append(b, 1) == n_all - na
    assert _counts(store.consistency()) == (n_all, n_all, n_all, 0, 0)
    assert sorted(store.meta.filter("batch = 1").select("doc_id", "url").collect()) == sorted(before)   # finished, not done anew
    assert store.append(b, 1) == 0 and store.append(pages, 2) == 0
    assert sorted(r[0] for r in store.vectors.select("doc_id").collect()) == list(range(n_all))


def test_half_written_metadata_start_anew(spark, tmpdir_path):
    store = SectionStore(spark, os.path.join(tmpdir_path, "s"))
    pages = _pages(spark).filter("page_id < 10")
    store.write_meta(pages, 0)
    os.remove(os.path.join(tmpdir_path, "s", "meta", "batch=0", "_SUCCESS"))
    n = store.append(pages, 0)
    assert _counts(store.consistency()) == (n, n, n, 0, 0) and n > 0


def test_stream_that_fails_between_the_writes(spark, tmpdir_path):
    inp, progress = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "progress")
    pages = _pages(spark)
    for i, part in enumerate((pages.filter("page_id < 20"), pages.filter("page_id >= 20"))):
        part.coalesce(1).write.parquet(os.path.join(inp, str(i)))
    store = SectionStore(spark, os.path.join(tmpdir_path, "s"))
    write, seen = store.write_vectors, []

    def dies_once(batch):
        seen.append(batch)
        if seen == [0, 1]:
            raise Died()
        write(batch)
    store.write_vectors = dies_once
    with pytest.raises(Exception):
        start_store_ingestion(spark, inp + "/*", store, progress, files_per_batch=1).awaitTermination(300)
    n_vectors, n_meta, *_ = _counts(store.consistency(committed=False))
    assert 0 < n_vectors < n_meta
    start_store_ingestion(spark, inp + "/*", store, progress, files_per_batch=1).awaitTermination(300)
    assert seen == [0, 1, 1]
    whole = SectionStore(spark, os.path.join(tmpdir_path, "whole"))
    n = whole.append(pages, 0)
    assert _counts(store.consistency(committed=False)) == _counts(store.consistency()) == (n, n, n, 0, 0)
    cols = ["page_key", "section_no", "url", "article"]
    assert store.meta.select(*cols).exceptAll(whole.meta.select(*cols)).count() == 0


def _echo(asked):
    def answer(questions):
        asked.append(sorted(r.query for r in questions.collect()))
        return questions.select("query_id", F.concat(F.lit("to "), "query").alias("response"))
    return answer


def test_history_fills_itself_and_expires(spark, tmpdir_path):
    history, asked = History(spark, os.path.join(tmpdir_path, "h"), keep_seconds=3600), []
    day = "2024-05-01 "
    requests = [[(1, "a\n\nb"), (2, "b\n\n\n\nc")], [(3, "c\n\nd\n\na"), (4, "a")], [(5, "a")], [(6, "d")]]
    times = ["10:00:00", "10:30:00", "10:59:00", "11:10:00"]
    out = []
    for n, (rows, t) in enumerate(zip(requests, times)):
        for _ in range(2):       # run again: the same answers
            done = answer_requests(spark.createDataFrame(rows, "request_id long, body string"), history, n, day + t, _echo(asked))
            got = sorted(map(tuple, done.collect()))
        out.append(got)
    assert out[0] == [(1, "to a\n\nto b", 2, 0), (2, "to b\n\nto \n\nto c", 3, 0)]
    assert out[1] == [(3, "to c\n\nto d\n\nto a", 3, 2), (4, "to a", 1, 1)]      # Q9: nothing new found, all from history
    assert out[2] == [(5, "to a", 1, 1)] and out[3] == [(6, "to d", 1, 1)]
    assert asked == [["", "a", "b", "c"]] * 2 + [["d"]] * 2 + [[]] * 4           # each text once
    late = answer_requests(spark.createDataFrame([(7, "a\n\nd")], "request_id long, body string"), history, 4, day + "11:20:00", _echo(asked))
    assert [tuple(r) for r in late.collect()] == [(7, "to a\n\nto d", 2, 1)] and asked[-1] == ["a"]   # a is too old, d is not
    assert history.drop_expired(day + "11:25:00") == [0]


def test_request_stream_answers_from_history(spark, tmpdir_path):
    inp, out, asked = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out"), []
    os.makedirs(inp)
    history = History(spark, os.path.join(tmpdir_path, "h"))
    for n, rows in enumerate([[(1, "one\\n\\ntwo")], [(2, "two\\n\\nthree")]]):
        with open(os.path.join(inp, f"{n}.json"), "w") as f:
            f.writelines(f'{{"request_id": {i}, "body": "{b}"}}\n' for i, b in rows)
        start_request_answering(spark, inp, history, out, os.path.join(tmpdir_path, "progress"), _echo(asked)).awaitTermination(300)
    rows = {r.request_id: (r.body, r.n_from_history) for r in spark.read.parquet(out).collect()}
    assert rows == {1: ("to one\n\nto two", 0), 2: ("to two\n\nto three", 1)} and asked == [["one", "two"], ["three"]]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_rows_by_position_of_quoted_lines(spark, tmpdir_path, split):
    """Line ends and quotes inside fields, cut anywhere by splits; several files, one without a last line end, one empty."""
    rng = random.Random(split)
    folder, rows = os.path.join(tmpdir_path, "csv"), []
    os.makedirs(folder)
    for n in range(4):
        part = [[str(len(rows) + i), "".join(rng.choice(['a', '"', "\n", ",", "é", " ", "\r\n", ""]) for _ in range(rng.randrange(9))),
                 rng.choice(["x", None])] for i in range(rng.randrange(1, 12))]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_NOTNULL).writerows(part)
        body = out.getvalue()
        with open(os.path.join(folder, f"part-{n}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(body[:-1] if n == 2 else body)
        rows += part
    open(os.path.join(folder, "part-1b.csv"), "w").close()
    index = POS.position_index(spark, folder, split_bytes=split)
    assert index.agg(F.sum("n_records")).first()[0] == len(rows)
    asked = sorted(rng.sample(range(len(rows)), len(rows) // 2)) + [0, 0, len(rows) - 1, len(rows), 10 ** 9]
    got = POS.rows_at(index, spark.createDataFrame([(i,) for i in asked], "position long"), "id long, text string, mark string").collect()
    want = [(i, int(rows[i][0]), rows[i][1], rows[i][2]) for i in sorted({i for i in asked if i < len(rows)})]
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == want


def test_only_splits_with_wanted_rows_are_opened(spark, tmpdir_path):
    rows = spark.range(3000).select("id", F.repeat(F.lit('x"\n'), 5).alias("t")).coalesce(1)
    FS.write_store(rows, tmpdir_path, fmt="csv")
    index = POS.position_index(spark, tmpdir_path, split_bytes=4096)
    first = index.orderBy("first_position").first()
    assert index.count() > 10
    # an index whose other files are gone still answers for the first split
    broken = index.withColumn("file", F.when(F.col("split") == 0, F.col("file")).otherwise("/nowhere"))
    got = POS.rows_at(broken, spark.createDataFrame([(first.n_records - 1,)], "position long"), "id long, t string").collect()
    assert [(r.id, r.t) for r in got] == [(first.n_records - 1, 'x"\n' * 5)]
    with pytest.raises(Exception):
        POS.rows_at(broken, spark.createDataFrame([(first.n_records,)], "position long"), "id long, t string").collect()


def test_question_files_one_for_each_input(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    rows = [("AA/w0", "http://b", ["Who?", "Where\nnow?"]), ("AA/w0", "http://a", ["What?"]), ("AB/w1", "http://c", ["Why?"])]
    df = spark.createDataFrame(rows, "file string, url string, queries array<string>").repartition(3)
    for _ in range(2):           # again: replaced
        write_question_files(df, path)
    found = sorted(os.path.relpath(p, path) for p in glob.glob(path + "/**", recursive=True) if os.path.isfile(p))
    assert found == ["AA/w0.txt", "AB/w1.txt"]
    assert open(os.path.join(path, "AA/w0.txt")).read() == "##\nhttp://a\n#\n1. What?\n##\nhttp://b\n#\n1. Who?\n2. Where now?\n"
    back = sorted((r.url, r.query) for r in FS.read_generated_queries(spark, path).collect())
    assert back == [("http://a", "What?"), ("http://b", "Where now?"), ("http://b", "Who?"), ("http://c", "Why?")]


def test_a_failed_write_leaves_no_file(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    boom = F.when(F.col("file") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("url"))
    df = spark.createDataFrame([("a", "u", ["x"]), ("b", "u", ["x"])], "file string, url string, queries array<string>").withColumn("url", boom)
    with pytest.raises(Exception):
        write_question_files(df, path)
    assert [p for p in glob.glob(path + "/**", recursive=True) if p.endswith(".txt")] == []


def test_questions_are_asked_again(spark):
    class LeaksAtFirst:
        """Made once in a task; gives the title as often as the number in the text says."""

        def __call__(self, prompts, tries):
            out = []
            for p, n in zip(prompts, tries):
                title, _, text = p.partition("Title: ")[2].partition("\nText: ")
                out.append("" if text == "mute" else f"1. about {title.upper()}\n2. {title}!" if n <= int(text) else "Sure:\n1. who\n2) " + title)
            return out
    arts = spark.createDataFrame([(1, "Rome", "0"), (2, "Oslo", "2"), (3, "Bern", "99"), (4, "Kyiv", "mute")], "id long, title string, article string")
    out, report = generate_queries(arts, LeaksAtFirst, max_tries=4)
    got = {r.id: (r.tries, r.leak, r.queries) for r in out.collect()}
    assert got == {1: (1, False, ["who", "Rome"]), 2: (3, False, ["who", "Oslo"]), 3: (4, True, ["about BERN", "Bern!"]), 4: (4, True, [])}
    assert [tuple(r) for r in report.orderBy("tries").collect()] == [(1, 4, 1, 3), (2, 3, 0, 3), (3, 3, 1, 2), (4, 2, 0, 2)]
    none, report = generate_queries(arts.filter("id = 1"), LeaksAtFirst)
    assert report.count() == 1 and none.count() == 1


def test_pairs_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    # file 0 holds most of all questions, file 7 a single one, url u3 most of its file, u9 has no article
    asked = [(f if f != 7 else 7, n, f"u{3 if rng.random() < .6 else rng.randrange(10)}", f"q{f}.{n}")
             for f in range(9) for n in range(400 if f == 0 else 1 if f == 7 else 12)]
    q = spark.createDataFrame(asked, "file int, row_no int, url string, query string")
    a = spark.createDataFrame([(f"u{i}", r, f"text {i} {r}") for i in range(9) for r in (2, 0, 1)], "url string, row_no int, article string")
    out = []
    for n in (1, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            out.append(sorted(map(tuple, P.relevance_pairs(q.repartition(n), P.last_articles(a.repartition(n))).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]
    own = [x for x in asked if x[2] != "u9"]
    assert sorted(r[:3] for r in out[0] if r[3]) == sorted((u, x, f"text {u[1:]} 2") for _, _, u, x in own)
    file_of = {x: (f, n) for f, n, _, x in asked}
    sizes = {f: sum(x[0] == f for x in asked) for f in range(9)}
    drawn = [file_of[r[1]] for r in out[0] if not r[3]]
    assert len(drawn) == len(own) and all(n < max(1, sizes[f] - 1) for f, n in drawn)
    assert sorted({f for f, _ in drawn}) == list(range(9))


def test_text_search_by_store_is_a_search_of_each_store(spark):
    """Nine stores of one table against nine indexes built apart."""
    from seekspark.operators.index import CorpusIndex
    from seekspark.operators.textsearch import conditions, normalize_text_scores, relaxed_and_search
    from seekspark.plans.queries import _search_inputs
    got = {(r.item_id, r.store, r.doc_id): r.text_score for r in features.q_text_search_sharded(spark, SF001).collect()}
    docs, want = spark.read.parquet(f"{SF001}/documents.parquet"), {}
    conds = conditions(_search_inputs(spark, SF001).words)
    for store in (0, 4, 8):
        idx = CorpusIndex.build(docs.filter(F.pmod("doc_id", F.lit(9)) == store))
        hits = normalize_text_scores(relaxed_and_search(conds, idx.blocks)).groupBy("query_id", "doc_id").agg(F.sum("text_score").alias("s")).collect()
        for q in {r.query_id for r in hits}:
            best = sorted((r for r in hits if r.query_id == q), key=lambda r: (-round(r.s, 9), r.doc_id))[:5]
            want |= {(q, store, r.doc_id): round(r.s, 6) for r in best}
    assert {k: v for k, v in got.items() if k[1] in (0, 4, 8)} == pytest.approx(want) and want
