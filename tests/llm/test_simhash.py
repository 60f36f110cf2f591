import random

from pyspark.sql import functions as F

from seekspark.llm import common, components, simhash
from tests.llm import cases


def brute(texts):
    """Component id of each row by comparing all pairs."""
    prints = [(i, simhash.simhash(t) & (2 ** 64 - 1)) for i, t in texts]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= simhash.MAX_BITS:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, p, least.get(g)) for (i, p), g in zip(prints, group)), key=str)


def test_fingerprint_by_bits():
    import xxhash
    text = "One two  THREE four\tfive"
    grams = ["one two three", "two three four", "three four five"]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.simhash(text) & (2 ** 64 - 1) == want
    assert simhash.simhash("É x") != simhash.simhash("é x")  # only A-Z are lower-cased
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


def test_same_components_as_all_pairs(spark):
    found = simhash.near_duplicates(cases.docs(spark)).select("id", "fp", "component_id").collect()
    got = sorted(((r.id, r.fp & (2 ** 64 - 1), r.component_id) for r in found), key=str)
    assert got == brute(cases.TEXTS)


def test_links_connect_what_pairs_connect(spark):
    """Chains, crowded cells and lone fingerprints, the signs of 64-bit numbers included."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(300)} | {centre}
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        prints.add(chain)
        chain ^= 3 << b
    prints = sorted(prints)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all(bin(signed[e.u] ^ signed[e.v]).count("1") <= 2 for e in edges)
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p
    for e in edges:
        group[max(root(signed[e.u]), root(signed[e.v]))] = min(root(signed[e.u]), root(signed[e.v]))
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 2:
                assert root(a) == root(b)
    # a crowded cell costs links in proportion to its fingerprints, not to their pairs
    assert len(edges) < 70 * len(prints)


def test_popcounts_bound_the_distance(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(50)] + [0, -1, -(1 << 63)]
    got = spark.createDataFrame([(v,) for v in values], "fp long").select("fp", simhash.popcounts(F.col("fp")).alias("p")).collect()
    for r in got:
        assert [r.p >> i & 15 for i in range(0, 64, 4)] == [bin(r.fp >> i & 15).count("1") for i in range(0, 64, 4)]


def test_keep_one(spark):
    kept = simhash.keep_one(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    one_of_each = {c for _, _, c in brute(cases.TEXTS)}
    assert ids == sorted(one_of_each, key=str)


def test_empty(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.empty(spark)).count() == 0
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    out = {r.node: r.root for r in components.connected(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_exploded_cells_are_not_broadcast(spark, monkeypatch):
    """Spark takes an exploded table for as small as its file; a side that is not counted as small must be shuffled."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 10, raising=False)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 10)
    rng = random.Random(6)
    centre = rng.getrandbits(62)
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(20)}
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.links(fps)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    stars = components._stars(found, 11)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in stars and "Broadcast" not in stars
    assert {r.root for r in components.connected(found).collect()} == {min(prints)}


def test_a_side_with_too_many_rows_is_shuffled(spark):
    few = common.written(spark.range(5).toDF("k"), "few")
    assert "BroadcastHashJoin" in spark.range(100).toDF("k").join(common.small(few, 5), "k")._jdf.queryExecution().executedPlan().toString()
    joined = spark.range(100).toDF("k").join(common.small(few, 4), "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 5
