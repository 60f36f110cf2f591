"""Term-clustered postings in blocks, and exact top-k that skips blocks (RNK-3, JOI-5, JOI-12, REL-2).

The postings of a term stand in blocks of ``BLOCK`` documents, those with the largest
BM25F part first, and every block carries the largest part in it. The table is
range-partitioned and sorted by term, so a filter on terms skips whole row groups. Lists of very
frequent terms are cut into shards by document, each with its own order of parts, so no
list is ever sorted in one task.

``top_by_parts`` finds, for a whole table of weighted questions, the documents with the
largest sum of weight x part over the question's terms:

1. A question's rarest terms, up to a share of its postings, are paired with it and summed. If a least score is
   wanted, they are as many as leave others that stay below it together.
2. The first documents by these sums are scored in full. The k-th of their scores is a bound: no
   document below it can be among the best.
3. A document is dropped if its sum and the largest parts of all other terms stay below the bound; for the others
   the remaining parts are looked up, those of the rarest words first: after each few words the documents
   that can no longer reach the bound are dropped.
4. A document without any of the rare terms can reach the bound only if the largest parts of
   the common ones do. Where that is so, the blocks of these terms are read, largest parts first, down to the
   block whose largest part with those of the other common terms stays below the bound.

So a frequent word is not paired with all its documents, and the result is that of scoring all.
Questions whose rarest terms make more than ``GROUP_PAIRS`` pairs together are answered in groups, one after the
other; the tables of a group are deleted when its answers are written, so disk does not grow with questions x documents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_path
from ..util import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, broadcast_if_small, materialize, top_k
from .index import CorpusIndex

BLOCK = 128            # documents of a block
SHARD_DOCS = 1 << 20   # documents of a term that are ordered in one task, on average
SEEDS = 2              # documents scored first, for each wanted one
SLACK = 1e-8           # bounds this close to the k-th score are kept: orders round to 9 digits
PAIRED_SHARE = 0.25    # of a question's postings that are paired with it, those of its rarest terms
TASK_PAIRS = 1 << 20   # pairs of question and document that a task sums up, on average
PLAIN_PAIRS = 20_000_000   # postings that may be paired with questions outright: cheaper than the rounds below it
GROUP_PAIRS = 150_000_000  # pairs of question and document that are on disk at once, on average
LOOKUPS = (1, 3, 9)    # common words of a question that are looked up before documents are dropped again
PUSHED_TERMS = 1000    # at most so many terms go to the scan as a filter


# Fixed values of the text index the reference queries: BM25F weighting with its default constants.
BM25F_B = 0.75
BM25F_K1 = 1.2


def bm25f_term(tf, dl, avgdl, df, n_docs) -> F.Column:
    """Per-term BM25F of one field: idf ``ln(N/(df+1))+1``."""
    idf = F.log(n_docs / (df + 1.0)) + 1.0
    return idf * (tf * (BM25F_K1 + 1)) / (tf + BM25F_K1 * ((1 - BM25F_B) + BM25F_B * dl / avgdl))


def store_term(store, term) -> F.Column:
    """A term as one of several stores knows it."""
    return F.concat_ws(":", store.cast("string"), term)


@dataclass
class TermBlocks:
    blocks: DataFrame   # term, shard, block, size, top, docs, parts
    stats: DataFrame    # term, df, top

    @classmethod
    def build(cls, index: CorpusIndex, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> "TermBlocks":
        avgdl = index.lengths.select(F.avg("dl")).scalar()
        part = bm25f_term(F.col("tf"), F.col("dl"), avgdl, F.col("df"), index.n_docs)
        return cls.of_rows(index.postings.select("term", "doc_id", "tf", "dl"),
                           index.dfs.filter(F.col("df") > shard_docs).select("term", "df"), part, block, shard_docs)

    @classmethod
    def by_store(cls, index: CorpusIndex, store_of: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> "TermBlocks":
        """RNK-2: the blocks of several stores in one table. ``store_of``: ``(doc_id, store)``. A term is
        ``<store>:<term>``; df, number of documents and mean length are those of the store."""
        stores = broadcast_if_small(store_of)
        sizes = index.lengths.join(stores, "doc_id").groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        post = index.postings.select("doc_id", "term", "tf", "dl").join(stores, "doc_id")
        own = store_term(F.col("store"), F.col("term")).alias("term")
        # a term is frequent in a store only if it is in the whole corpus
        frequent = post.join(F.broadcast(index.dfs.filter(F.col("df") > shard_docs).select("term")), "term").select(own) \
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > shard_docs)
        rows = post.join(F.broadcast(sizes), "store").select(own, "doc_id", "tf", "dl", "avgdl", "n")     # a row for each store
        part = bm25f_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("df"), F.col("n").cast("double"))
        return cls.of_rows(rows, frequent, part, block, shard_docs)

    @classmethod
    def of_rows(cls, rows: DataFrame, frequent: DataFrame, part: F.Column, block: int, shard_docs: int) -> "TermBlocks":
        """The store of ``rows (term, doc_id, ..)``; ``part`` is made of their columns and the term's ``df``. ``frequent``:
        ``(term, df)`` of the terms with more than ``shard_docs`` documents, so no more than one for as many rows.

        The rows are dealt out once, by ranges of term and shard: counts, places and blocks are made where they lie."""
        shard = F.when(F.col("df").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / shard_docs)).cast("int"))
        dealt = rows.join(F.broadcast(frequent), "term", "left").withColumn("shard", shard).repartitionByRange("term", "shard")
        own = Window.partitionBy("term", "shard")
        dealt = dealt.withColumn("df", F.coalesce("df", F.count(F.lit(1)).over(own))).select("term", "shard", "doc_id", part.alias("part"))
        place = F.row_number().over(own.orderBy(F.col("part").desc(), "doc_id")) - 1
        made = dealt.withColumn("block", F.floor(place / block).cast("int")).groupBy("term", "shard", "block").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("p"), "doc_id"))).alias("x")).select(
            "term", "shard", "block", F.size("x").alias("size"), (-F.col("x")[0]["p"]).alias("top"),
            F.transform("x", lambda s: s["doc_id"]).alias("docs"), F.transform("x", lambda s: -s["p"]).alias("parts"))
        stored = materialize(made, sort_by=["term", "shard", "block"])
        stats = materialize(stored.groupBy("term").agg(F.sum("size").alias("df"), F.max("top").alias("top")))
        return cls(stored, stats)

    def write(self, path: str, mode: str = "overwrite") -> None:
        self.blocks.repartitionByRange("term", "shard", "block").sortWithinPartitions("term", "shard", "block") \
            .write.mode(mode).parquet(f"{path}/blocks")
        self.stats.write.mode(mode).parquet(f"{path}/block_stats")

    @classmethod
    def read(cls, spark, path: str) -> "TermBlocks":
        return cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/block_stats"))

    def of_terms(self, terms: DataFrame, n: int) -> DataFrame:
        """The blocks of ``terms`` (one column, ``n`` distinct rows). A few terms go to the scan as a filter."""
        if n <= PUSHED_TERMS:
            return self.blocks.filter(F.col("term").isin([r["term"] for r in terms.collect()]))
        return self.blocks.join(F.broadcast(terms) if n <= BROADCAST_MAX_ROWS else terms, "term", "left_semi")


def pairs(blocks: DataFrame, *cols: str) -> DataFrame:
    """One row for each document of each block, with its part."""
    return blocks.select(*cols, F.explode(F.arrays_zip("docs", "parts")).alias("x")).select(
        *cols, F.col("x.docs").alias("doc_id"), F.col("x.parts").alias("part"))


def _in_tasks(lists: DataFrame, n_pairs: int | None) -> DataFrame:
    """Blocks dealt out so that a task sums up about ``TASK_PAIRS`` of their ``n_pairs`` pairs, however large the files are."""
    tasks = -(-(n_pairs or 0) // TASK_PAIRS)
    return lists.repartition(tasks, "term", "shard", "block") if tasks > 1 else lists


def top_by_parts(weights: DataFrame, store: TermBlocks, k: int, parts: bool = True, plain_pairs: int = PLAIN_PAIRS,
                 counts: dict | None = None, least: float | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: the ``k`` best documents of every question by ``sum(weight * part)`` over
    its terms, ties (at 9 digits) by id. ``weights``: ``(query_id, term, w)``, w >= 0, a term once in a question.

    ``parts=False`` counts every part as 1: the score is then the sum of the weights of the words a
    document holds. Batches of at most ``plain_pairs`` postings are paired outright, with the same result.
    ``least``: documents with a lower score are not wanted; those that can't reach it by a question's rarest words are
    not met. ``counts``, if given, receives ``all`` (postings of the questions' words, once for every
    question) and ``paired`` (those that were paired with a question)."""
    value = F.col("part") if parts else F.lit(1.0)
    highest = F.col("top") if parts else F.lit(1.0)
    own = Window.partitionBy("query_id")
    rarest = own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    words = weights.select("query_id", "term", F.col("w").cast("double").alias("w")).join(store.stats, "term") \
        .withColumn("bound", F.col("w") * highest)
    lowest = float("-inf") if least is None else float(least) - SLACK * (1 + abs(least))
    words = words.withColumn("upto", F.sum("df").over(rarest))
    if least is None:
        rare = (F.col("upto") <= PAIRED_SHARE * F.sum("df").over(own)) | (F.col("upto") == F.col("df"))
    else:      # the bounds of a word and all commoner ones
        rare = F.sum("bound").over(own) - F.sum("bound").over(rarest) + F.col("bound") >= F.lit(lowest)
    words = words.withColumn("rare", rare)
    words = materialize(words.select("query_id", "term", "w", "df", "bound", "rare"))
    size = words.agg(F.count("*").alias("rows"), F.countDistinct("term").alias("terms"), F.sum(F.octet_length("term") + 40).alias("bytes"),
                     F.sum("df").alias("all"), F.sum(F.when(F.col("rare"), F.col("df"))).alias("paired")).first()
    # the question side: tables made from ``words``, never larger than it
    side = F.broadcast if size["rows"] <= BROADCAST_MAX_ROWS and (size["bytes"] or 0) <= BROADCAST_MAX_BYTES else lambda df: df
    lists = store.of_terms(words.select("term").distinct(), size["terms"]).withColumn("highest", highest)
    best = [F.round("score", 9).desc(), F.col("doc_id")]
    if (size["all"] or 0) <= plain_pairs:
        if counts is not None:
            counts["all"] = counts["paired"] = size["all"] or 0
        score = _summed(words, lists, size["all"], value, side).withColumnRenamed("sum", "score")
        return top_k(score, ["query_id"], best, k, "n").drop("n")
    if counts is not None:
        counts["all"], counts["paired"] = size["all"] or 0, size["paired"] or 0
    groups = max(1, -(-(size["paired"] or 0) // GROUP_PAIRS))
    if groups == 1:
        return top_k(_scored(words, lists, size["paired"], k, value, side, least is not None, lowest, counts), ["query_id"], best, k, "n").drop("n")
    spark, out = words.sparkSession, None
    for g in range(groups):
        folder = scratch_path(spark, f"group-{uuid.uuid4().hex}")
        mine = materialize(words.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), folder=folder)
        score = _scored(mine, lists, (size["paired"] or 0) // groups, k, value, side, least is not None, lowest, counts, folder)
        found = materialize(top_k(score, ["query_id"], best, k, "n").drop("n"))
        out = found if out is None else out.unionByName(found)
        drop_folder(spark, folder)
    return out


def _summed(some: DataFrame, lists: DataFrame, n_pairs: int | None, value, side) -> DataFrame:
    """``(query_id, doc_id, sum)`` of all documents that hold a word of ``some (query_id, term, w)``."""
    held = _in_tasks(lists.join(side(some.select("term").distinct()), "term", "left_semi"), n_pairs)
    met = pairs(held.join(side(some.select("query_id", "term", "w")), "term"), "query_id", "w")
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * value).alias("sum"))


def _scored(words: DataFrame, lists: DataFrame, n_pairs: int | None, k: int, value, side, wanted: bool, lowest: float,
            counts: dict | None, folder: str | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: the whole scores of all documents that may be among the ``k`` best of their question and
    reach ``lowest``. Intermediate tables are written to ``folder``."""
    own = Window.partitionBy("query_id")
    rare, common = words.filter("rare"), words.filter("NOT rare")
    first = words.groupBy("query_id").agg(F.sum(F.when(F.col("rare"), 0.0).otherwise(F.col("bound"))).alias("open"))
    sums = _summed(rare, lists, n_pairs, value, side)
    if wanted:
        sums = sums.join(side(first), "query_id").filter(F.col("sum") + F.col("open") >= lowest).select("query_id", "doc_id", "sum")
    sums = materialize(sums, folder=folder)

    # no wanted document scores less than kth: the first SEEDS * k by their sums are scored in full
    seeds = materialize(top_k(sums, ["query_id"], [F.col("sum").desc(), F.col("doc_id")], SEEDS * k, "n").drop("n"), folder=folder)
    kth = top_k(_complete(seeds, lists, common, value, side), ["query_id"], [F.col("score").desc()], k, "n").filter(F.col("n") == k).select(
        "query_id", (F.col("score") - SLACK * (1 + F.abs("score"))).alias("kth"))
    state = materialize(first.join(kth, "query_id", "left").select(
        "query_id", "open", F.greatest(F.lit(lowest), F.coalesce("kth", F.lit(lowest))).alias("least")), folder=folder)
    near = sums.join(side(state), "query_id").filter(F.col("sum") + F.col("open") >= F.col("least")) \
        .select("query_id", "doc_id", "sum")

    # documents that hold common terms only
    wide = materialize(common.join(state.filter("open >= least"), "query_id").withColumn("upto", F.sum("bound").over(
        own.orderBy("bound", F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("upto") >= F.col("least")).select("query_id", "term", "w", "bound", "open", "least"), folder=folder)
    if not wide.isEmpty():
        reach = F.col("w") * F.col("highest") + F.col("open") - F.col("bound") >= F.col("least")
        more = pairs(lists.join(side(wide), "term").filter(reach), "query_id").select("query_id", "doc_id")
        if counts is not None:
            counts["paired"] += more.count()
        near = near.unionByName(more.distinct().join(sums, ["query_id", "doc_id"], "left_anti").withColumn("sum", F.lit(0.0)))

    return _complete(_narrowed(materialize(near, folder=folder), common, state, lists, value, side, folder), lists, common, value, side)


def _narrowed(near: DataFrame, common: DataFrame, state: DataFrame, lists: DataFrame, value, side, folder: str | None) -> DataFrame:
    """``near (query_id, doc_id, sum)`` without documents that can't reach their question's ``least`` any more. Their
    common words are looked up from the rarest on, a few in each step: most documents lack one of the first."""
    order = Window.partitionBy("query_id").orderBy("df", "term")
    left = F.sum("bound").over(order.rowsBetween(1, Window.unboundedFollowing))
    words, at = None, 0
    near = near.withColumn("rare", F.col("sum"))
    for step in LOOKUPS:
        if near.count() <= TASK_PAIRS:
            break
        if words is None:
            words = materialize(common.join(state.select("query_id", "least"), "query_id").select(
                "query_id", "term", "w", F.row_number().over(order).alias("nth"), F.coalesce(left, F.lit(0.0)).alias("left"), "least"),
                folder=folder)
        now = words.filter(F.col("nth").between(at + 1, at + step))
        # a question with no word in this step has been looked up whole
        after = now.groupBy("query_id").agg(F.min("left").alias("left"), F.first("least").alias("least"))
        met = _complete(near, lists, now, value, side, ("rare",)).join(side(after), "query_id", "left")
        near = materialize(met.filter(F.col("least").isNull() | (F.col("score") + F.col("left") >= F.col("least")))
                           .select("query_id", "doc_id", F.col("score").alias("sum"), "rare"), folder=folder)
        at += step
    return near.select("query_id", "doc_id", F.col("rare").alias("sum"))


def _complete(sums: DataFrame, lists: DataFrame, common: DataFrame, value, side, carry: tuple = ()) -> DataFrame:
    """``(query_id, doc_id, score, *carry)``: the sums over rare terms (a written table) with the parts of the common ones.
    A list is read once for all questions and cut to these documents before a question meets it."""
    docs = sums.select("doc_id").distinct()
    docs = F.broadcast(docs) if sums.count() <= BROADCAST_MAX_ROWS else docs     # ids only
    held = pairs(lists.join(side(common.select("term").distinct()), "term", "left_semi"), "term").join(docs, "doc_id", "left_semi")
    wanted = sums.select("query_id", "doc_id").join(side(common.select("query_id", "term", "w")), "query_id")
    found = wanted.join(held, ["doc_id", "term"]).select("query_id", "doc_id", (F.col("w") * value).alias("sum"))
    return sums.unionByName(found, allowMissingColumns=True).groupBy("query_id", "doc_id").agg(
        F.sum("sum").alias("score"), *[F.max(c).alias(c) for c in carry])
