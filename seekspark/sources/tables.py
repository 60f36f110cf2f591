"""Readers for the parquet tables the library works on.

``documents`` stands for the section store, ``benchmark`` for the question
set, ``embeddings`` for the vector store, ``pages`` for raw HTML, ``labels``
for binary truth, ``conversations`` for question batches and ``events`` for
stage timings. Only the columns a query selects are read (column pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD_BYTES = 8 << 20     # of text in a partition, on average: its tokens are sorted in memory
LEAST_BYTES = 1 << 18       # smaller inputs are not dealt out further


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by document, at every size, into parts of ``SPREAD_BYTES`` of text: a given
    number, since parts merged by their compressed size hold far more tokens than a task can sort.

    The raw text crosses the network once; grouping its tokens by (document,
    term) then needs no exchange, while a scan left as it is would send every
    token occurrence. It also gives a small file with one row group to all
    cores."""
    texts = [F.sum(F.octet_length(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = sum(x or 0 for x in df.agg(*texts).first()) if texts else 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-size // SPREAD_BYTES), min(cores, -(-size // LEAST_BYTES))), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions: ``(query_id, query)``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                    F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-1 metadata store: ``(doc_id, url, lang, n_chars, article)``; the
    url is ``source/doc_id`` (the test table has no url column)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"), "lang", "n_chars",
        F.col("text").alias("article"))
