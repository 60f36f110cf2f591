import math
import random
import re

import xxhash

from seekspark.llm import quality_rules as Q
from tests.llm import cases


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    words, text = words_of(text), text or ""
    seen, starts = {}, []
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    starts = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(starts))


def mix(h, k):
    """One 32-bit word of Murmur3."""
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = (k << 15 | k >> 17) & 0xFFFFFFFF
    h ^= k * 0x1B873593 & 0xFFFFFFFF
    h = (h << 13 | h >> 19) & 0xFFFFFFFF
    return (h * 5 + 0xE6546B64) & 0xFFFFFFFF


def murmur_longs(values):
    h = 42
    for v in values:
        v &= 2 ** 64 - 1
        h = mix(mix(h, v & 0xFFFFFFFF), v >> 32) ^ 8
        h ^= h >> 16
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        h = h * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
    return h


def buckets(text):
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words_of(text)]
    return [h >> 48 for h in hashes] + [murmur_longs(p) >> 16 for p in zip(hashes, hashes[1:])]


def scores(texts, trusted):
    raw, target = {}, {}
    for i, t in texts:
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i in trusted)
    n, m = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + Q.PRIOR * raw[b] / n) / (m + Q.PRIOR) / (raw[b] / n)) for b in raw}
    return [sum(weight[b] for b in buckets(t)) / max(1, len(buckets(t))) for _, t in texts]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = cases.TEXTS + [(100 + i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(30)))
                           for i in range(12)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100, 112)] + [(1, 1, 1), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = sorted(Q.score(cases.docs(spark, texts), labels).select("doc_id", "text", "__base.*").collect(), key=str)
    want = sorted(zip(texts, scores(texts, set(range(100, 112, 2)))), key=lambda x: str(x[0]))
    by_row = {}
    for (i, t), s in want:
        n, chars, symbols, lines, repeats = base(t)
        failed = n < Q.MIN_WORDS or 100 * repeats > 50 * n
        by_row.setdefault((i, t), []).append((n, chars, symbols, lines, repeats, failed, s))
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, lines, repeats, failed, s = by_row[r.doc_id, r.text][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            n, chars, symbols, lines, repeats, failed), r.doc_id
        assert abs(r.score - s) < 1e-9
        assert r.kept == (not failed and s >= Q.MIN_SCORE)


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(1)
    clean, junk = [f"good{i}" for i in range(300)], [f"BAD{i}!!" for i in range(300)]
    texts = [(i, " ".join(rng.choices(clean if i % 4 else junk, k=8000))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = Q.keep_good(cases.docs(spark, texts), labels)
    assert kept.columns == cases.docs(spark).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(120) if i % 4]


def test_verdict_holds_at_few_and_many_labels(spark):
    """Documents of 300 words: the same junk goes and the same clean ones stay with 5 labels and with 500."""
    rng = random.Random(5)
    clean, junk = [f"good{i}" for i in range(40)], [f"BAD{i}!!" for i in range(40)]
    texts = [(i, " ".join(rng.choices(junk if i >= 600 else clean, k=300))) for i in range(660)]
    docs = cases.docs(spark, texts)
    for n in (5, 500):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        assert sorted(r.doc_id for r in Q.keep_good(docs, labels).select("doc_id").collect()) == list(range(600)), n


def test_evidence_weights_against_brute_force(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=80))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    raw, target = {}, {}
    for i, t in texts:
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i < 7)
    share = sum(target.values()) / sum(raw.values())
    weight = {b: math.log((target[b] + Q.EVIDENCE) / (share * (raw[b] - 1) + Q.EVIDENCE)) for b in raw}
    want = {i: sum(weight[b] for b in buckets(t)) / len(buckets(t)) for i, t in texts}
    for r in Q.score(cases.docs(spark, texts), labels, evidence=Q.EVIDENCE).select("doc_id", "__base.*").collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and r.score >= Q.MIN_SCORE)


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score(cases.docs(spark), none).select("__base.*").collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in got) and len(got) == len(cases.TEXTS)
    assert Q.score(cases.empty(spark), none).count() == 0


def test_target_sample_is_bounded(spark):
    labels = spark.range(500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert Q.trusted_ids(labels, 50).count() == 50


def test_plan_has_no_python(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = Q.score(cases.docs(spark), labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
