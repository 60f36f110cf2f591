import random

from seekspark.llm import line_spread as L
from tests.llm import cases


def brute(texts, min_sites, min_words):
    """Text left, lines and lines removed for each row."""
    def norm(line):
        return " ".join(line.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").split(" ")).split()
    sites, first = {}, {}
    rows = [(i, t, None if i == 3 else f"src{(i or 0) % 3}") for i, t in texts]
    for i, t, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            w = tuple(norm(line))
            if len(w) >= min_words:
                sites.setdefault(w, set()).add(s or "")
                place = (i is not None, i or 0, pos)
                first[w] = min(first.get(w, place), place)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for pos, x in enumerate(lines) if len(norm(x)) < min_words or len(sites[tuple(norm(x))]) < min_sites
                or first[tuple(norm(x))] == (i is not None, i or 0, pos)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def texts():
    rng = random.Random(8)
    lines = [f"common line number {i} here" for i in range(6)] + ["too short", "", "  spaced   common line number 1 here"]
    return cases.TEXTS + [(20 + i, "\n".join(rng.choices(lines, k=6) + [f"own line of document {i}"])) for i in range(40)]


def test_against_brute_force(spark):
    for min_sites in (2, 3, 4):
        got = L.strip_boilerplate(cases.docs(spark, texts()), min_sites=min_sites, min_words=4)
        got = sorted(((r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
        assert got == brute(texts(), min_sites, 4)


def test_many_sites_near_and_above_the_threshold(spark):
    """Lines on 90, 99, 100, 101 and 300 sites: sketches alone would not tell the middle ones apart."""
    data = [(n * 1000 + s, f"line that stands on {n} sites", f"s{s}") for n in (90, 99, 100, 101, 300) for s in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = L.strip_boilerplate(docs, min_sites=100).collect()
    gone = {}
    for r in out:
        gone[r.row.doc_id // 1000] = gone.get(r.row.doc_id // 1000, 0) + r.n_removed
    assert gone == {90: 0, 99: 0, 100: 99, 101: 100, 300: 299}


def test_pipeline_stage(spark):
    data = [(i, "boilerplate line of every site" + ("\nown text" if i else ""), f"s{i}", 0) for i in range(12)]
    data += [(50, "boilerplate line of every site", "s1", 30), (51, None, "s1", 0), (52, "", "s2", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[0] == (data[0][1], 0)  # the first place keeps the line
    assert all(got[i] == ("own text", 8) for i in range(1, 12))
    assert 50 not in got and got[51] == (None, 0) and got[52] == ("", 0)


def test_pipeline_stage_long_passages_on_few_sites(spark):
    """Passages of 60 words on 2, 3 and 7 sites, a table of 5 sites, copies of one document, and a short line on 7 sites."""
    rng = random.Random(4)

    def own(n):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    passages = {n: own(60) for n in (2, 3, 7)}
    data = [(100 * n + s, f"{own(45)}\n{passages[n]}", f"s{s}", 0) for n in passages for s in range(n)]
    data += [(800 + s, f"{own(45)}\nshort line on seven sites", f"s{s}", 0) for s in range(7)]
    copy = own(70)
    data += [(900 + s, copy, f"s{s}", 0) for s in range(3)]
    data += [(950 + s, f"{own(45)}\n{passages[2]} other", "s1", 0) for s in range(3)]  # one site alone
    for most in (7, 5):
        rows = [r for r in data if int(r[2][1:]) < most]
        got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(
            rows, "doc_id long, text string, source string, n_chars long")).collect()}
        want = {i: t.split("\n")[0] if i < 800 and i % 100 else t for i, t, _, _ in rows}
        assert got == want, most


def test_empty(spark):
    assert L.strip_boilerplate(cases.empty(spark)).count() == 0
