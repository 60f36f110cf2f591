"""Line dedup by distinct-site spread.

A line (of at least ``MIN_WORDS`` words, white space normalised) that stands on
``MIN_SITES`` or more distinct sites is boilerplate; with ``long_sites`` (the
pipeline) so is one of ``LONG_WORDS`` words or more on that many sites, if as
many documents that are no near duplicates of each other hold it. It stays where it occurs
first, at the smallest (doc_id, text key, line number), and goes everywhere
else, so that no line leaves the corpus altogether.

The spread of every line hash is a HyperLogLog sketch of its sites: tasks build
partial sketches, the exchange carries one small sketch for each task and hash,
and they merge by aggregation; a line that a third of all documents hold is no
hot group. Sketches decide only where they are sure: an estimate within
``BAND`` of the threshold gets an exact distinct count over (hash, site) pairs.
``BAND`` is five standard errors of a sketch of 2**LG_K registers.

Cases: a null text stays null and has no lines; a null site counts as one more
site; lines of fewer words never count; rows that repeat both doc_id and text are
treated alike; an empty table gives an empty result; other columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import SPACE, let, quoted, small, text_key, whole_row, written

MIN_WORDS = 4
MIN_SITES = 8
LONG_WORDS = 50
LONG_SITES = 2
LG_K = 12
BAND = 5 * 1.04 / math.sqrt(1 << LG_K)


def line_table(docs: DataFrame, text: str, doc_id: str, site: str, min_words: int,
               counted: bool = False) -> DataFrame:
    """``(id, key, pos, hash, site)`` of every line that counts, as a written table: a few numbers a line; ``counted`` adds ``words``."""
    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"),
                       F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
                       F.posexplode_outer(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", SPACE, " ")))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return written(rows.filter((F.col("line") != "") & (blanks + 1 >= min_words))
                   .select("id", "key", "pos", F.xxhash64("line").alias("hash"), "site",
                           *[(blanks + 1).alias("words")] * counted), "lines")


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(hash, first)`` of the lines on ``min_sites`` or more sites; ``first``
    is the struct of id, key and pos of the first occurrence."""
    low, high = math.floor(min_sites * (1 - BAND)), math.ceil(min_sites * (1 + BAND))
    sketched = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.min(F.struct("id", "key", "pos")).alias("first"))
    likely = written(sketched.filter(F.col("sites") >= low), "line-spread")
    near = likely.filter(F.col("sites") <= high)
    exact = (lines.select("hash", "site").join(small(near.select("hash")), "hash", "left_semi")
             .groupBy("hash", "site").agg(F.lit(1).alias("one"))
             .groupBy("hash").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites))
    return written(likely.filter(F.col("sites") > high).select("hash", "first")
                   .unionByName(near.join(exact, "hash").select("hash", "first")), "boilerplate")


def spread_long_lines(docs: DataFrame, lines: DataFrame, long_sites: int, text: str) -> DataFrame:
    """``(hash, first)`` of the lines of ``LONG_WORDS`` words or more that ``long_sites`` sites and as many groups of
    near duplicates hold. Only documents with a line on that many sites are compared."""
    long = lines.filter(F.col("words") >= LONG_WORDS)
    wide = written(long.select("hash", "site").distinct().groupBy("hash").count().filter(F.col("count") >= long_sites)
                   .select("hash"), "long-lines")
    places = written(long.join(small(wide), "hash").select("hash", "key", "site").distinct(), "long-places")
    keys = written(places.select("key").distinct(), "long-texts")
    texts = (docs.select(text_key(F.col(text)).alias("doc_id"), F.col(text).alias("text"))
             .join(small(keys.withColumnRenamed("key", "doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    groups = simhash.near_duplicates(texts).select(F.col("id").alias("key"), "component")
    spread = (places.join(groups, "key").select("hash", "component").distinct()
              .groupBy("hash").count().filter(F.col("count") >= long_sites).select("hash"))
    return written(long.join(small(written(spread, "long-spread")), "hash").groupBy("hash")
                   .agg(F.min(F.struct("id", "key", "pos")).alias("first")), "long-boilerplate")


def strip_boilerplate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str = "source",
                      min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, long_sites: int | None = None) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: each row of ``docs`` as a struct, its text
    without the boilerplate lines, its lines and how many of them went."""
    lines = line_table(docs, text, doc_id, site, min_words, counted=long_sites is not None)
    boilerplate = spread_lines(lines, min_sites)
    if long_sites is not None:
        boilerplate = written(boilerplate.unionByName(spread_long_lines(docs, lines, long_sites, text))
                              .dropDuplicates(["hash"]), "all-boilerplate")
    gone = (lines.join(small(boilerplate), "hash")
            .filter(~F.struct("id", "key", "pos").eqNullSafe(F.col("first")))
            .groupBy("id", "key").agg(F.collect_set("pos").alias("gone")))
    rows = docs.select(whole_row(docs))
    rows = rows.select("row", F.col(f"row.{doc_id}").alias("id"), text_key(F.col(f"row.{text}")).alias("key"))
    rows = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id"))
                                & (F.col("r.key") == F.col("g.key")), "left")
    body, parts = F.col(f"row.{text}"), F.split(F.col(f"row.{text}"), "\n")
    stripped = let(parts, lambda p: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: F.get(p, i)), "\n"))
    body = F.when(F.col("gone").isNull(), body).otherwise(stripped)
    return rows.select("row", body.alias("text"),
                       F.when(F.col(f"row.{text}").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines gone (``n_chars`` follows the text); a document
    of which nothing is left goes too."""
    out = strip_boilerplate(docs, long_sites=LONG_SITES).filter((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(
        F.col("row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
