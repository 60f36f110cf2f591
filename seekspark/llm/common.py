"""Column and table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# A side is broadcast only after its rows have been counted up to this bound;
# its rows hold a few numbers each, so the bound also bounds the bytes.
BROADCAST_ROWS = 500_000

# Words between ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column, separators: str = SPACE) -> Column:
    """The parts of ``text`` between runs of ``separators``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def space_words(text: Column) -> Column:
    """As ``split_words``, for white space: split at single blanks, which needs no regular expression."""
    body = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        body = F.replace(body, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(body, " "), "")


def lower_ascii(text: Column) -> Column:
    """``text`` with only A-Z lower-cased. Texts of ASCII alone take the fast path."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``row``: whatever their names, they meet no other column."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def text_key(text: Column) -> Column:
    """64-bit key of a text; with doc_id it tells rows apart whose doc_id is repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``rows`` rows, else ``df`` for a shuffle join.

    ``df`` should be a written table: the count then reads no data column."""
    return joined_as(df, df.count() <= rows)


def joined_as(df: DataFrame, few: bool) -> DataFrame:
    """``broadcast(df)`` if it has few rows, else ``df`` marked for a shuffle join: Spark's estimate goes by
    compressed files and takes no account of exploded rows, so left to itself it may send millions of them through the driver."""
    return F.broadcast(df) if few else df.hint("merge")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts lineage: a lost executor costs only the tasks that were running."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
