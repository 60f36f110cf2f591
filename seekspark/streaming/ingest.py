"""STR-1: incremental ingestion of new page files with Structured Streaming.

Each micro-batch of new pages becomes sections (the batch pipeline of
``operators.ingest``), loses the sections that the store already holds, gets
dense ids continuing from the store size and is appended to the metadata
store. A section is known by its page key, a hash of the whole page row, and
its number: pages that share a url or an id but differ are all stored, a page
that comes again is stored once, in whatever batches they arrive. Progress
lives in the checkpoint folder that the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stop_words, toc_headings
from ..operators.ingest import dense_ids, page_lines, sections
from ..session import has_table
from ..util import materialize

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def new_sections(pages: DataFrame) -> DataFrame:
    """The sections of ``pages``, each with the ``page_key`` of its page: 128 bits of the whole page row, so
    that among any number of pages two different ones don't share a key."""
    key = F.md5(F.to_json(F.struct("page_id", "url", "html")))
    keyed = materialize(pages.select("page_id", "url", "html").distinct().withColumn("page_key", key))
    # the section pipeline groups lines by page_id: here by the page's key
    body = keyed.select(F.col("page_key").alias("page_id"), "url", "html")
    heads = body.select("page_id", toc_headings("html").alias("headings")).filter(F.col("headings").isNotNull())
    sec = sections(page_lines(body), heads, stop_list=stop_words("russian")).withColumnRenamed("page_id", "page_key")
    return sec.join(keyed.select("page_key", "page_id"), "page_key")


def ingest_pages(pages: DataFrame, store_path: str) -> int:
    """Batch step shared by the stream: pages -> new sections appended to
    ``store_path`` (parquet). Returns the number of rows appended."""
    spark = pages.sparkSession
    sec, start = new_sections(pages), 0
    if has_table(spark, store_path):
        store = spark.read.parquet(store_path)
        start = store.select(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
        sec = sec.join(store.select("page_key", "section_no"), ["page_key", "section_no"], "left_anti")
    new = dense_ids(sec, ["page_id", "page_key", "section_no"], start=start)
    n = new.count()
    if n:
        new.write.mode("append").parquet(store_path)
    return n


def start_page_ingestion(spark: SparkSession, input_dir: str, store_path: str, checkpoint: str,
                         available_now: bool = True):
    """Start the stream over parquet page files arriving in ``input_dir``.
    ``checkpoint``: folder of the stream's progress, on storage that outlives the job."""
    src = spark.readStream.schema(PAGES_SCHEMA).parquet(input_dir)
    w = src.writeStream.foreachBatch(lambda df, epoch: ingest_pages(df, store_path)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
