"""STR-2: continuous question answering with Structured Streaming.

Question files ``(query_id, query)`` arriving in a folder are answered in
micro-batches against the static stores. A text is searched once per batch,
and every question that has this text gets its answers, whatever its id. A
batch writes ``(query_id, doc_id, rank, score)`` to the folder ``batch=<id>`` of
the answers table and replaces it when it is run again, so a replayed batch
leaves no answer twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import CorpusIndex
from ..plans.search import SearchOptions, search
from ..util import materialize

QUESTIONS_SCHEMA = "query_id BIGINT, query STRING"


def answer_batch(questions: DataFrame, index: CorpusIndex, doc_vectors: DataFrame, out_path: str,
                 opt: SearchOptions | None = None) -> None:
    asked = materialize(questions.select("query_id", "query").distinct())
    texts = asked.groupBy("query").agg(F.min("query_id").alias("asked_id"))
    found = search(texts.select(F.col("asked_id").alias("query_id"), "query"), index, doc_vectors, opt)
    every = asked.join(texts, "query").select("query_id", "asked_id")
    found.withColumnRenamed("query_id", "asked_id").join(every, "asked_id") \
        .select("query_id", "doc_id", "rank", "score").write.mode("overwrite").parquet(out_path)


def start_answering(spark: SparkSession, input_dir: str, index: CorpusIndex, doc_vectors: DataFrame,
                    out_path: str, checkpoint: str, opt: SearchOptions | None = None, available_now: bool = True):
    """``checkpoint``: folder of the stream's progress, on storage that outlives the job."""
    src = spark.readStream.schema(QUESTIONS_SCHEMA).json(input_dir)
    w = src.writeStream.foreachBatch(
        lambda df, batch: answer_batch(df, index, doc_vectors, f"{out_path}/batch={batch}", opt)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
