"""Benchmark decontamination by word windows, in DataFrame functions only.

Words are runs of ASCII digits, a-z (A-Z lower-cased) and all non-ASCII
characters. A window is ``WINDOW`` consecutive words of a benchmark text; a
shorter text is one window. Every document word inside an occurrence of a
window is hit.

A window of L words holds a run of k = (L + 1) // 2 words that starts at a
multiple of L - k + 1 in the document. So the scan looks at these runs alone,
one in six words for L = 10: their hashes are tested against the hash set of
all k-word runs of the benchmark, broadcast after its rows are counted (beyond
the bound the same join shuffles). What matches is verified on the words
around it: the run is extended to both sides while document and benchmark
agree, and a stretch of L words or more is hit. Each run of a document meets a
benchmark place once, whatever the number of windows over it.

Cases: a null text has no words and stays; a benchmark text without words has
no window; benchmark rows that repeat a text share its windows and each item
counts; an item of null id hits words, but isn't listed; document rows that
repeat doc_id and text are all kept, judged alike; empty tables on either side
give no hits; other columns of the documents, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, quoted, small, split_words, text_key, whole_row, written

WINDOW = 10
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Runs of the benchmark, and bytes of the words around them (of any length in texts without blanks), beyond
# which the join shuffles.
BROADCAST_RUNS = 200_000
BROADCAST_RUN_BYTES = 128 << 20


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _shape(length: int) -> tuple[int, int]:
    """Words of a run and words that it may extend to a side, for windows of ``length``."""
    k = (length + 1) // 2
    return k, length - k


def _run(words: Column, at: Column, length: int) -> list[Column]:
    """Fields of the run that starts at ``at``: window length, place, hash, place of
    the run among the words around it, those words."""
    k, side = _shape(length)
    first = F.greatest(at - side, F.lit(0))
    return [F.lit(length).alias("length"), at.alias("at"),
            F.xxhash64(F.array_join(F.slice(words, at + 1, k), " ")).alias("hash"),
            (at - first).alias("lead"),
            F.array_join(F.slice(words, first + 1, (at - first) + k + side), " ").alias("around")]


def _runs(words: Column, length: int, step: int) -> Column:
    k, _ = _shape(length)
    last = F.size(words) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.struct(*_run(words, at, length)))


def benchmark_texts(bench: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``(item_id, text_id, words, length)`` of the benchmark rows that have words."""
    rows = bench.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    return written(rows.select("item_id", F.md5(F.array_join("words", " ")).alias("text_id"), "words",
                               F.least(F.size("words"), F.lit(window)).alias("length")), "benchmark")


def hits(docs: DataFrame, texts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, key, n_words, copies, spans, text_ids)``, one row for each doc_id and text.

    ``spans`` are sorted word intervals [lo, hi), ``text_ids`` the benchmark texts
    hit, ``copies`` the rows of ``docs`` it stands for. A row of length 0 for each
    document, which matches one such row of the benchmark side, carries the
    documents without hits through the same join; where that join shuffles, they
    would all meet at one key, so they are added after it."""
    lengths = sorted(r["length"] for r in texts.select("length").distinct().collect())  # WINDOW values at most
    distinct = texts.select("text_id", "words", "length").dropDuplicates(["text_id"])
    runs = [distinct.filter(F.col("length") == n).select("text_id", F.explode_outer(_runs(F.col("words"), n, 1)).alias("run"))
            for n in lengths]
    blank = [F.lit(0).alias("length"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("hash"),
             F.lit(0).alias("lead"), F.lit("").alias("around")]
    places = docs.sparkSession.range(1).select(F.lit("").alias("text_id"), F.struct(*blank).alias("run"))
    for r in runs:
        places = places.unionByName(r)
    places = written(places.select("text_id", "run.length", "run.hash", F.col("run.lead").alias("b_lead"),
                                   F.col("run.around").alias("b_around")), "benchmark-runs")

    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))
    size = places.agg(F.count("*").alias("runs"), F.sum(F.octet_length("b_around") + 40).alias("bytes")).first()
    shuffled = size["runs"] > BROADCAST_RUNS or size["bytes"] > BROADCAST_RUN_BYTES
    first = F.array(F.struct(*blank))
    own = F.concat(F.slice(first, 1, 0) if shuffled else first, *[_runs(F.col("words"), n, _shape(n)[1] + 1) for n in lengths])
    own = rows.select("id", "key", F.size("words").cast("long").alias("n_words"), own.alias("runs"))
    met = (own.select("id", "key", "n_words", F.explode_outer("runs").alias("run"))  # never empty; explode would test that with the runs built twice
           .select("id", "key", "n_words", "run.*")
           .join(places if shuffled else F.broadcast(places), ["length", "hash"]))

    k = F.expr("(length + 1) DIV 2").cast("int")
    side = F.col("length") - k
    met = met.withColumn("d", F.split("around", " ")).withColumn("b", F.split("b_around", " "))

    def agree(d_at: Column, b_at: Column, step: int) -> Column:
        """Words on which both sides agree from these places on, ``side`` at most."""
        same = F.transform(F.sequence(F.lit(0), side), lambda j: (j < side) & F.coalesce(
            F.get("d", d_at + step * j) == F.get("b", b_at + step * j), F.lit(False)))
        return (F.array_position(same, F.lit(False)) - 1).cast("int")
    left, right = agree(F.col("lead") - 1, F.col("b_lead") - 1, -1), agree(F.col("lead") + k, F.col("b_lead") + k, 1)
    equal = F.slice("d", F.col("lead") + 1, k) == F.slice("b", F.col("b_lead") + 1, k)
    met = met.withColumn("left", F.when(F.col("length") > 0, left)).withColumn("right", F.when(F.col("length") > 0, right))
    hit = F.when((F.col("length") > 0) & equal & (F.col("left") + k + F.col("right") >= F.col("length")),
                 F.struct((F.col("at") - F.col("left")).alias("lo"), (F.col("at") + k + F.col("right")).alias("hi")))
    met = met.select("id", "key", "n_words", "text_id", (F.col("length") == 0).cast("long").alias("one"), hit.alias("hit"))
    met = met.filter((F.col("one") == 1) | F.col("hit").isNotNull())
    if shuffled:
        met = met.unionByName(rows.select("id", "key", F.size("words").cast("long").alias("n_words"), F.lit("").alias("text_id"),
                                          F.lit(1).cast("long").alias("one"), F.lit(None).cast(met.schema["hit"].dataType).alias("hit")))
    return met.groupBy("id", "key", "n_words").agg(
        F.sum("one").alias("copies"), F.sort_array(F.collect_set("hit")).alias("spans"),
        F.collect_set(F.when(F.col("hit").isNotNull(), F.col("text_id"))).alias("text_ids"))


def words_hit(spans: Column) -> Column:
    """Words in the union of sorted intervals."""
    def add(a: Column, s: Column) -> Column:
        return F.struct(F.greatest(a["end"], s["hi"]).alias("end"),
                        (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda a: a["n"]).cast("long")


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, key, n_words, n_hit, spans, item_ids)`` for each row of ``docs``;
    ``item_ids`` are sorted strings."""
    texts = benchmark_texts(bench, window=window)
    found = written(hits(docs, texts), "hits")
    items = texts.select("text_id", F.col("item_id").cast("string").alias("item"))
    listed = (found.filter(F.size("text_ids") > 0).select("id", "key", F.explode("text_ids").alias("text_id"))
              .join(small(items), "text_id").groupBy("id", "key").agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    f, n = found.alias("f"), listed.alias("n")
    both = f.join(n, F.col("f.id").eqNullSafe(F.col("n.id")) & (F.col("f.key") == F.col("n.key")), "left")
    return both.select("f.id", "f.key", "n_words", words_hit(F.col("spans")).alias("n_hit"), "spans",
                       F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                       F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, bench: DataFrame, how: str = "documents") -> DataFrame:
    """``docs`` without the documents that hold a window (``how="documents"``) or
    without the words hit and the separators before them (``how="spans"``)."""
    texts = benchmark_texts(bench)
    found = written(hits(docs, texts).filter(F.size("spans") > 0).select("id", "key", "spans"), "contaminated")
    rows = docs.select(whole_row(docs))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), text_key(F.col("row.text")).alias("key")).alias("r")
    match = F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.key") == F.col("c.key"))
    if how == "documents":
        return rows.join(small(found).alias("c"), match, "left_anti").select("row.*")
    cut = rows.join(found.alias("c"), match, "left")
    body = F.col("row.text")
    parts = F.regexp_extract_all(body, F.lit("([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"
                                             "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), 1)
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"] - 1)))
    tail = F.regexp_extract(body, "([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)$", 1)
    clean = F.concat(let(parts, lambda p: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), hit), lambda i: F.get(p, i)), "")), tail)
    return cut.select(*[F.when(F.col("spans").isNull(), body).otherwise(clean).alias(c) if c == "text"
                        else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
