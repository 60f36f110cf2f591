"""Quality rules: surface counts and an n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed word n-grams (one and two words, ``BUCKETS``
buckets) are counted: one over every document (raw), one over a bounded
sample of trusted documents (target). The weight of a bucket is

    log((target + EVIDENCE) / (expected + EVIDENCE)),  expected = target_total * (raw - 1) / raw_total

that is, the target count is held against the count that the trusted documents
would have if they wrote like all others; the place that is scored is not
counted against itself. ``EVIDENCE`` counts on both sides let a bucket speak as
far as its own numbers go, so no size of the trusted sample or of the input
switches the rule off: without trusted documents every weight is 0, a bucket
expected once says little, and one expected often and never met says much.
(``evidence=None`` gives the fixed Dirichlet prior of ``PRIOR`` pseudo-counts in
all, by which a small sample rejects nothing.) A document's score is the mean
weight of its n-grams; it is kept if no base rule failed and the score is at
least ``MIN_SCORE``. One threshold holds for every document, whatever its
length or place.

Cases: a null or empty text has no words, fails the base rule and scores 0;
rows that repeat are judged alike, each on its own text; an empty table gives
an empty result; columns of the input, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, space_words, whole_row, written

BUCKETS = 1 << 16
PRIOR = 16 * BUCKETS
EVIDENCE = 8.0
# Trusted documents beyond this many (by the hash of their id) don't add to the
# target model: the sample that the classifier is fitted on is bounded.
TARGET_DOCS = 20_000
MIN_SCORE = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50



def _covered(found: Column) -> Column:
    """Words inside windows that start at the sorted positions ``found``."""
    steps = F.transform(found, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(found, j + 1), p + 3) - p))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    ``hashes`` has a 64-bit hash for each word. Most texts repeat no window,
    which a hash set tells; only the others are sorted by (window hash,
    position), so that equal windows are neighbours."""
    last = F.size(hashes) - 2

    def sorted_case(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, lambda s: let(
            F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(
                (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"])), lambda p: p.isNotNull())),
            _covered))
    grams = F.transform(F.slice(hashes, 1, F.greatest(last, F.lit(0))),
                        lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(sorted_case(g)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(row, hashes, base)``: each row of ``docs`` as a struct, the hashes of its words and the struct of the surface counts."""
    rows = docs.select(whole_row(docs), F.col(text).alias("body"))
    body = F.coalesce(F.col("body"), F.lit(""))
    symbols = sum((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit(""))) for c in "#*$%&|<>"),
                  F.lit(0))
    return (rows.withColumn("words", space_words(F.col("body")))
            .withColumn("hashes", word_hashes(F.col("words")))
            .withColumn("chars", F.length(F.array_join("words", ""))).drop("words")
            .select("row", "hashes", F.struct(
                F.size("hashes").cast("long").alias("n_words"),
                F.col("chars").cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                duplicate_lines(F.col("body")).cast("long").alias("n_dup_lines"),
                repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words")).alias("base")))


def gram_buckets(hashes: Column) -> Column:
    """Bucket (16 bits of a hash) of every word and of every pair of neighbouring words."""
    one = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 48).cast("int"))
    two = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
                     lambda a, b: F.when(b.isNotNull(), F.shiftrightunsigned(F.hash(a, b), 16)))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """At most ``most`` ids of documents labelled good and not toxic, by the hash of the id."""
    ids = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
                        & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def gram_weights(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 evidence: float | None = None) -> DataFrame:
    """``(bucket, weight)``, one row for each bucket that some document fills.

    Every document counts. The exchange carries one partial count for each
    bucket and task, so a frequent word is never a hot group."""
    ids = trusted_ids(labels).select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted"))
    grams = (docs.select(F.col(doc_id).alias("__id"), word_hashes(space_words(F.col(text))).alias("hashes"))
             .join(F.broadcast(ids), "__id", "left")  # at most TARGET_DOCS rows
             .select("__trusted", F.explode_outer(gram_buckets(F.col("hashes"))).alias("bucket"))  # explode would test for emptiness with all built twice
             .filter("bucket IS NOT NULL"))
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("target")),
                     "gram-counts")
    total = counts.agg(F.sum("raw").cast("double").alias("r"), F.sum("target").cast("double").alias("t")).first()
    raw, target = total["r"] or 1.0, total["t"] or 0.0
    if evidence is not None:
        expected = (F.col("raw") - 1) * F.lit(target / raw)
        return counts.select("bucket", F.log((F.col("target") + evidence) / (expected + evidence)).alias("weight"))
    p = F.col("raw") / F.lit(raw)
    return counts.select("bucket", F.log((F.col("target") / p + PRIOR) / F.lit(target + PRIOR)).alias("weight"))


def verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
             evidence: float | None = None) -> DataFrame:
    """``(row, verdict)``: each row of ``docs`` as a struct, and the struct of its surface counts, ``base_failed``, ``score`` and ``kept``.

    The weights, at most ``BUCKETS`` numbers, reach the tasks as a scalar
    subquery: an array that each n-gram indexes by its bucket."""
    weights = gram_weights(docs, labels, text, doc_id, evidence)
    every = (docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
             .join(weights, "bucket", "left")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("w")))),
                              lambda e: e["w"]).alias("w")))
    out = base_counts(docs, text).withColumn("weights", every.scalar())
    total = F.aggregate(gram_buckets(F.col("hashes")), F.lit(0.0), lambda a, b: a + F.get(F.col("weights"), b))
    out = out.withColumn("total", total).drop("weights")
    base = F.col("base")
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    ratio = F.col("total") / F.greatest(2 * base["n_words"] - 1, F.lit(1))
    verdict = F.struct("base.*", failed.alias("base_failed"), ratio.alias("score"),
                       (~failed & (ratio >= MIN_SCORE)).alias("kept"))
    # a generator of one row: a filter on the verdict stays above it, and the counts are made once
    return out.select("row", F.explode_outer(F.array(verdict)).alias("verdict"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          evidence: float | None = None) -> DataFrame:
    """``docs`` with the struct of ``verdicts`` as ``__base`` (in place of a column of that name, if there is one)."""
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() != "__base"]
    return verdicts(docs, labels, text, doc_id, evidence).select(*kept, F.col("verdict").alias("__base"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns that came."""
    return verdicts(docs, labels, evidence=EVIDENCE).filter("verdict.kept").select("row.*")
