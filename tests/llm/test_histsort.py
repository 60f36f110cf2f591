from pyspark.sql import functions as F

from seekspark.llm import histsort as H
from tests.llm import cases


def check(rows, shards, slack):
    """Slots without gaps, shards of near-equal bytes, the order that of the keys."""
    slots, size = {}, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = [size.get(s, 0) for s in range(shards)]
    assert set(size) <= set(range(shards)) and max(sizes) - min(sizes) <= slack


def test_shards_are_even(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    rows = H.shard(docs, shards=7).collect()
    assert len(rows) == 3000
    check(rows, 7, 2 * (50 + 16) + 0.002 * sum(r["size"] for r in rows) / 7)


def test_a_hot_text_is_divided(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGE_BYTES", 4000)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("hot text")).otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = H.shard(docs, shards=5).collect()
    check(rows, 5, 2 * 24 + 0.002 * sum(r["size"] for r in rows) / 5)
    keys = spark.createDataFrame([(r["row"]["doc_id"], r["row"]["text"], r["shard"], r["slot"]) for r in rows],
                                 "doc_id long, text string, shard int, slot long")
    keys = keys.select("shard", "slot", F.xxhash64("text").alias("a"), F.xxhash64("doc_id").alias("b")).collect()
    in_order = sorted(keys, key=lambda r: (r.shard, r.slot))
    assert [(r.a, r.b) for r in in_order] == sorted((r.a, r.b) for r in keys)


def test_awkward_rows(spark):
    rows = H.shard(cases.docs(spark), shards=3).collect()
    assert sorted(((r["row"]["doc_id"], r["size"]) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 16) for i, t in cases.TEXTS), key=str)
    check(rows, 3, 10 ** 9)
    assert rows[0]["row"].asDict().keys() == set(cases.docs(spark).columns)


def test_histogram_counts_below(spark):
    keys = [(-5, 3, 10), (-5, 4, 20), (0, -1, 30), (7, 7, 40), (7, 7, 50)]
    table = spark.createDataFrame(keys, "a long, b long, size long")
    flip = 1 << 63
    probes = sorted((a + flip << 64) + b + flip for a, b in ((-5, 4), (0, -1), (7, 7), (7, 8)))
    size, rows = H.histogram(table, probes)
    assert size.tolist() == [10, 30, 60, 150, 150] and rows.tolist() == [1, 2, 3, 5, 5]


def test_empty_and_few(spark):
    assert H.shard(cases.empty(spark)).count() == 0
    rows = H.shard(cases.docs(spark, [(1, "a"), (2, "b")]), shards=10).collect()
    assert len(rows) == 2
    check(rows, 10, 17)
