"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only when a bounded scan proves it holds at most so many
# rows and bytes; otherwise the join stays a shuffle join (AQE may still turn it
# into a broadcast from runtime statistics, and splits skewed partitions).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: its strings and arrays as they are, 8 for any other column."""
    total = F.lit(8)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            total = total + F.coalesce(F.octet_length(F.array_join(c, " ")) if f.dataType.elementType.typeName() == "string"
                                       else 16 * F.size(c), F.lit(0))
        else:
            total = total + 8
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The check reads at most ``max_rows + 1`` rows, so it is cheap for the
    small side it is meant for and never scans a big table to the end.
    """
    n = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if n["rows"] <= max_rows and (n["bytes"] or 0) <= max_bytes else df


def top_k(df: DataFrame, partition_cols, order_cols, k: int | None,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group and number them from 1.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle and a final one after it, so a hot group never ships more than
    ``k`` rows per input partition.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    out = df.withColumn(rank_col, F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col(rank_col) <= k)
    return out


def materialize(df: DataFrame, sort_by=None, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder (or ``folder``, a folder in it) and
    read it back. Its shuffle files are dropped as soon as it is written, not when the driver next collects its garbage.

    Used for the stores the reference keeps on disk (postings, df table,
    query terms, candidates): later plans start from the written rows with
    column pruning and pushed filters, a lost executor does not force
    recomputing the tokenizer, and the optimizer cannot inline the token
    expressions into filters of the queries that use them.
    """
    import uuid

    from .session import scratch_path
    spark = df.sparkSession
    path = f"{folder or scratch_path(spark, '')}/table-{uuid.uuid4().hex}".replace("//table", "/table")
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        out.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)
