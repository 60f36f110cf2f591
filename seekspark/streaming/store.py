"""ING-3 / SNK-1: one append to two stores, metadata and vectors under the same ids.

A store is a folder with ``meta/batch=<n>``, ``vectors/batch=<n>`` and ``manifest/batch=<n>``. A
batch is appended in three steps: its new sections get ids that run on from the manifest
and are written to ``meta``; their vectors are made from the rows just written, under the same ids, and
written to ``vectors``; the row ``(batch, first_id, n)`` in ``manifest`` commits both. Readers see
committed batches only, so they never find a section without its vector.

A batch that died on the way is finished when it is run again: if its metadata were written whole,
the vectors are made from those rows, ids and all; if not, the batch starts anew. A committed batch
that comes again does nothing. So a replay neither doubles nor loses a row. There is one
writer at a time (a stream, or a job that numbers its batches).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import doc_tokens, postings
from ..operators.ingest import dense_ids, store_consistency
from ..operators.vector import hashed_tf_vectors
from ..session import has_table, is_complete
from ..util import materialize
from .ingest import PAGES_SCHEMA, new_sections

MANIFEST = "batch BIGINT, first_id BIGINT, n BIGINT"
DIM = 64


def hashed_vectors(meta: DataFrame, dim: int = DIM) -> DataFrame:
    """ING-4 for every row of ``meta``: ``(doc_id, embedding)``; a section without words has the zero vector."""
    made = hashed_tf_vectors(postings(doc_tokens(meta, "article", "doc_id"), with_positions=False), dim=dim)
    zero = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda _: F.lit(0.0))
    return meta.select("doc_id").join(made, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", zero))


class SectionStore:
    """``encode`` makes ``(doc_id, embedding)`` from metadata rows; by default hashed term counts."""

    def __init__(self, spark: SparkSession, path: str, encode: Callable[[DataFrame], DataFrame] = hashed_vectors):
        self.spark, self.path, self.encode = spark, path.rstrip("/"), encode

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def manifest(self) -> DataFrame:
        """One row for each committed batch."""
        where = f"{self.path}/manifest"
        if not has_table(self.spark, where):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(where)

    def written(self, name: str) -> DataFrame | None:
        """All rows of ``meta`` or ``vectors``, committed or not; none if nothing was written yet."""
        where = f"{self.path}/{name}"
        return self.spark.read.parquet(where) if has_table(self.spark, where) else None

    def _committed(self, name: str) -> DataFrame | None:
        rows = self.written(name)
        return rows and rows.join(F.broadcast(self.manifest().select("batch")), "batch", "left_semi")

    @property
    def meta(self) -> DataFrame | None:
        return self._committed("meta")

    @property
    def vectors(self) -> DataFrame | None:
        return self._committed("vectors")

    def consistency(self, committed: bool = True) -> DataFrame:
        """JOI-13 on the two stores as readers see them, or as they lie on disk."""
        vectors, meta = (self.vectors, self.meta) if committed else (self.written("vectors"), self.written("meta"))
        none = self.spark.createDataFrame([], "doc_id BIGINT")
        return store_consistency(none if vectors is None else vectors, none if meta is None else meta)

    def write_meta(self, pages: DataFrame, batch: int) -> None:
        """Step 1: the sections of ``pages`` that no committed batch holds, with ids that run on."""
        sections = new_sections(pages)
        held = self.meta
        if held is not None:
            sections = sections.join(held.select("page_key", "section_no"), ["page_key", "section_no"], "left_anti")
        first = self.manifest().select(F.coalesce(F.max(F.col("first_id") + F.col("n")), F.lit(0))).first()[0]
        dense_ids(sections, ["page_id", "page_key", "section_no"], start=first) \
            .write.mode("overwrite").parquet(self._part("meta", batch))

    def write_vectors(self, batch: int) -> None:
        """Step 2: vectors of the batch's metadata, under their ids."""
        meta = self.spark.read.parquet(self._part("meta", batch))
        self.encode(meta).write.mode("overwrite").parquet(self._part("vectors", batch))

    def commit(self, batch: int) -> int:
        """Step 3: the manifest row; returns the number of sections of the batch."""
        row = self.spark.read.parquet(self._part("meta", batch)) \
            .agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("bigint").alias("first_id"), F.count(F.lit(1)).alias("n"))
        row = materialize(row)
        row.coalesce(1).write.mode("overwrite").json(self._part("manifest", batch))
        return row.first()["n"]

    def append(self, pages: DataFrame, batch: int) -> int:
        """Add the sections of ``pages`` as batch number ``batch``; returns how many were added now."""
        if not self.manifest().filter(F.col("batch") == batch).isEmpty():
            return 0
        if not is_complete(self.spark, self._part("meta", batch)):
            self.write_meta(pages, batch)
        self.write_vectors(batch)
        return self.commit(batch)


def start_store_ingestion(spark: SparkSession, input_dir: str, store: SectionStore, checkpoint: str, available_now: bool = True,
                          files_per_batch: int | None = None):
    """STR-1 into both stores: a stream over parquet page files arriving in ``input_dir``; the number of a
    micro-batch is that of its append."""
    source = spark.readStream.schema(PAGES_SCHEMA)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    w = source.parquet(input_dir).writeStream.foreachBatch(lambda pages, batch: store.append(pages, batch) and None) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
