"""EVA-7 / JOI-8 / JOI-9: the relevance dataset, pairs of question and article text.

Every question of a file gives its own article as a relevant pair, and its article with a question drawn
from another file, ``shift`` files on, as an irrelevant one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import broadcast_if_small, materialize
from .ingest import dense_ids

SEED = 1337       # fixed: the seed of the draw


def last_articles(articles: DataFrame, order: str = "row_no") -> DataFrame:
    """JOI-8: one text for each url, of several the last in ``order`` (then the larger text)."""
    return articles.groupBy("url").agg(F.max_by("article", F.struct(order, "article")).alias("article"))


def relevance_pairs(questions: DataFrame, articles: DataFrame, n_files: int = 9, shift: int = 5, seed: int = SEED) -> DataFrame:
    """``(url, query, article, relevant)``. ``questions``: ``(file, row_no, url, query)``, files numbered from 0 and
    ``(file, row_no)`` unique; ``articles``: ``(url, article)``, one for each url. A question whose url has no article gives no pair.

    The draw for the i-th question of all takes row ``h mod (n - 1)`` of the other file's ``n`` rows, h being the first
    48 bits of the md5 of seed, file and row: the last row is never drawn, as in the reference, unless it is
    the only one. Rows are numbered over all files by ranges, not file by file, so a file with most of the rows
    is spread like any other; a file starts at the number of its first row."""
    rows = materialize(dense_ids(questions.select("file", "row_no", "url", "query"), ["file", "row_no"], id_col="n"))
    files = rows.groupBy("file").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "file", "row_no")), 1, 12), 16, 10).cast("bigint")
    drawn = rows.select("url", F.pmod(F.col("file") + shift, F.lit(n_files)).alias("file"), h.alias("h")) \
        .join(broadcast_if_small(files), "file") \
        .select("url", (F.col("first") + F.when(F.col("size") > 1, F.col("h") % (F.col("size") - 1)).otherwise(0)).alias("n"))
    foreign = drawn.join(rows.select("n", "query"), "n").select("url", "query", F.lit(0).alias("relevant"))
    pairs = rows.select("url", "query", F.lit(1).alias("relevant")).unionByName(foreign)
    return pairs.join(articles.select("url", "article"), "url").select("url", "query", "article", "relevant")
