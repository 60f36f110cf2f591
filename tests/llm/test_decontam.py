import random
import re

from seekspark.llm import decontam as D
from tests.llm import cases

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "short item"), (3, None), (4, "..."),
         (5, "Alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu!"), (None, "null item words"),
         (6, "a a a a a a a a a a a a"), (7, "ÉTÉ x")]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items):
    out = []
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            b = words_of(text)
            size = min(len(b), D.WINDOW)
            for at in range(len(b) - size + 1 if b else 0):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == b[at:at + size]:
                        hit |= set(range(p, p + size))
                        found |= {item} - {None}
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def noise(rng, n):
    return " ".join(rng.choice(["beta", "delta", "alpha", "a", "item", "short", "zeta"]) for _ in range(n))


def texts():
    rng = random.Random(4)
    full = ITEMS[0][1].lower()
    made = [noise(rng, a) + " " + full + ". " + noise(rng, 7) for a in range(9)]  # every place modulo the step
    made += [noise(rng, 5) + " " + " ".join(full.split()[k:k + 10]) + " x" for k in range(4)]
    made += [" ".join(full.split()[:9]), full.replace("zeta", "zita"), "a " * 30, "SHORT-item", "the short item short item",
             "été x", "ÉTÉ x ÉTÉ x", full + " " + full, "null item words"]
    plain = [(i, t) for i, t in cases.TEXTS if t is not cases.LONG]
    return plain + [(100 + i, t) for i, t in enumerate(made)]


def test_against_brute_force(spark):
    bench = spark.createDataFrame([(i, t, "w") for i, t in ITEMS], "item_id long, text string, words string")
    got = D.report(cases.docs(spark, texts()), bench)
    assert sorted(((r.id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()), key=str) == brute(texts(), ITEMS)


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_RUNS", 0)
    got = D.report(cases.docs(spark, texts()), bench)
    assert sorted(((r.id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()), key=str) == brute(texts(), ITEMS)


def test_documents_and_spans_removed(spark):
    bench = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    docs = cases.docs(spark, [(1, "Keep this, ALPHA beta gamma delta epsilon zeta eta theta iota kappa; and that.\nEnd"),
                              (2, "clean text"), (3, None), (None, "")])
    assert D.decontaminate(docs, bench).columns == docs.columns
    assert sorted((r.doc_id for r in D.decontaminate(docs, bench).collect()), key=str) == [2, 3, None]
    spans = {r.doc_id: r.text for r in D.decontaminate(docs, bench, how="spans").collect()}
    assert spans == {1: "Keep this; and that.\nEnd".replace(";", "; ").replace(";  ", "; "), 2: "clean text", 3: None, None: ""}


def test_long_text_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, " ".join(cases.LONG.split()[500:520]))], "item_id long, text string")
    r = D.report(cases.docs(spark, [(9, cases.LONG)]), bench).collect()
    assert (r[0].n_words, r[0].n_hit > 0, len(r)) == (120_000, True, 1)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in D.report(cases.docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert D.report(cases.empty(spark), bench).count() == 0
    assert D.decontaminate(cases.empty(spark), bench).count() == 0


def test_plan_has_no_python(spark):
    bench = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    plan = D.hits(cases.docs(spark), D.benchmark_texts(bench))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shuffled_join_carries_no_blank_rows(spark, monkeypatch):
    """Beyond the broadcast bound the documents without hits stay out of the join; the result is the same."""
    docs = cases.docs(spark)
    texts = D.benchmark_texts(spark.createDataFrame([(1, cases.BASE), (2, "two words")], "item_id long, text string"))

    def found():
        out = D.hits(docs, texts)
        return out._jdf.queryExecution().optimizedPlan().toString(), sorted(map(str, out.collect()))
    plan, want = found()
    monkeypatch.setattr(D, "BROADCAST_RUNS", 0)
    shuffled, got = found()
    assert got == want and len(got) > 10
    assert "Union" not in plan and "Union" in shuffled
