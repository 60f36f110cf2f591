import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspark.llm import vector_codes as V
from tests.conftest import SF001


def plain(rows, parts=4, entries=256, rounds=4):
    """``rows`` of (vec_id, vector, label), one at a time, all distances measured."""
    kept = [(i, [min(max(math.floor(min(max(x, -V.BOUND), V.BOUND) * 1024), -V.BOUND), V.BOUND) for x in v], lab)
            for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    can = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0),
                 key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    if not can:
        return [(i, None, None, 0) for i, _, _ in kept], None
    w = len(can[0][1]) // parts
    own = [r for r in can if len(r[1]) == w * parts]
    books = [[r[1][p * w:p * w + w] for r in own[:entries]] for p in range(parts)]

    def codes(v):
        out = []
        for p in range(parts):
            d = [sum((a - b) ** 2 for a, b in zip(v[p * w:p * w + w], e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        found = [codes(r[1]) for r in own]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [r[1][p * w:p * w + w] for r, f in zip(own, found) if f[p][0] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out, total = [], {}
    for i, v, lab in kept:
        f = codes(v) if len(v) == w * parts else None
        out.append((i, "".join(f"{k:02x}" for k, _ in f) if f else None, sum(d for _, d in f) if f else None, lab))
        total[lab] = total.get(lab, 0) + (out[-1][2] or 0)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, c, e, total[lab]) for i, c, e, lab in out], sha


def run(spark, rows, entries=256, rounds=4):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, code int, `a.b` string").repartition(3)
    kept = V.points(df)
    books = V.train(kept, entries=entries, rounds=rounds)
    out = V.with_label_error(V.written(V.assign(kept, books), "codes"))
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str), books and books.sha256()


@pytest.mark.parametrize("scale", [4, 1 << 26])
def test_search_against_all_distances(scale):
    """Doubles and integers; small ranges make many ties and repeated entries."""
    @settings(max_examples=60, deadline=None, database=None)
    @given(st.integers(1, 80), st.integers(1, 4), st.integers(0, 10 ** 6))
    def run(entries, width, seed):
        rng = np.random.default_rng(seed)
        book = V.Codebook(rng.integers(-scale, scale + 1, (entries, width)))
        x = rng.integers(-scale, scale + 1, (200, width))
        apart = ((x[:, None].astype(object) - book.entries[None].astype(object)) ** 2).sum(2)
        at, dist = book.nearest(x)
        assert at.tolist() == apart.argmin(1).tolist() and dist.tolist() == apart.min(1).tolist()
    run()


def test_search_leaves_entries_out(monkeypatch):
    """On clustered vectors most entries of a list are never measured."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-20_000, 20_000, (256, 8))
    book = V.Codebook(centres)
    x = centres[rng.integers(0, 256, 4000)] + rng.integers(-200, 200, (4000, 8))
    measured = []
    measure = V.Codebook.measure
    monkeypatch.setattr(V.Codebook, "measure", lambda self, x, s, which: measured.append(len(x) * len(which)) or measure(self, x, s, which))
    at, _ = book.nearest(x)
    apart = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (at == apart.argmin(1)).all()
    assert sum(measured) < 0.35 * 256 * len(x)


def test_training_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 50)
    monkeypatch.setattr(V, "CHUNK", 20)
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, 0.01, 8).round(3).tolist(), int(i) % 3 or None) for i in rng.permutation(300)]
    rows += rows[:4] + [(None, rows[0][1], 1), (900, [1.0] * 4, 2), (901, [], 2), (902, [0.1] * 7, None), (903, None, 1),
                        (904, [0.1] * 7 + [None], 1), (905, [0.1] * 7 + [float("nan")], 1), (906, [0.1] * 7 + [float("-inf")], 9),
                        (907, [1e30, -1e30] * 4, 2)]
    for entries, rounds in ((256, 4), (7, 3), (1, 0)):
        want, sha = plain(rows, entries=entries, rounds=rounds)
        got, own = run(spark, rows, entries, rounds)
        assert own == sha and got == sorted(want, key=str)


def test_few_and_no_vectors(spark):
    few = [(5, [0.5] * 4, 1), (2, [0.25, -0.5, 1.0, 0.0], None), (2, [0.25, -0.5, 1.0, 0.0], None)]
    want, sha = plain(few)
    assert run(spark, few) == (sorted(want, key=str), sha)
    assert run(spark, [(1, None, 1)]) == ([], None)
    assert run(spark, [(1, [0.5], 1), (2, [0.5], None)]) == ([(1, None, None, 0), (2, None, None, 0)], None)


def test_totals_of_many_labels(spark, monkeypatch):
    """Beyond the broadcast bound, with one label on most rows and on null."""
    monkeypatch.setattr(V, "BROADCAST_ROWS", 2)
    codes = spark.createDataFrame([(i, None if i % 4 == 0 else min(i, 50), f"{i:02x}", i) for i in range(400)],
                                  "vec_id long, label int, code string, error long")
    out = V.with_label_error(V.written(codes, "codes")).collect()
    total = {}
    for r in out:
        total[r.label] = total.get(r.label, 0) + r.error
    assert len(out) == 400 and all(r.label_error == total[r.label] for r in out)


def test_approximation(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    kept = V.points(vectors)
    books = V.train(kept)
    out = V.assign(kept, books).join(vectors.select("vec_id", "embedding"), "vec_id")
    rows = out.select("embedding", "error", V.approximate(out.code, books).alias("back")).collect()
    for r in rows:
        x = np.floor(np.array(r.embedding) * 1024)
        assert ((x - np.array(r.back) * 1024) ** 2).sum() == r.error
    assert np.mean([r.error / 1024 ** 2 for r in rows]) < 0.5  # unit vectors


def test_query_against_plain_loops(spark):
    from seekspark.llm import queries
    out = queries.op12_orchard_codes(spark, SF001)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = plain(rows)
    assert sorted(map(tuple, out.collect())) == sorted((*r, sha) for r in want)
