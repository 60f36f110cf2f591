"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``seekspark.llm``. Its result is written as
Parquet in the shared checkpoint folder and read again as the next one's input.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekspark.llm import decontam, line_spread, packing, quality_rules, simhash, tokens
from seekspark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines gone, each but for its first place."""
    return line_spread.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a training sequence."""
    return packing.pack(docs, tokens.vocabulary(packing.VOCABULARY))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_neardup", near_duplicates),
          ("decontamination", benchmark), ("best_fit_packing", pack)]

# Hashed n-gram weights, XXH64 fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
