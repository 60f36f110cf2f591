"""SRC-3: rows of a headerless multi-line CSV by their position.

A record of such a file may hold line ends inside quotes, so neither byte nor line numbers tell where record
``n`` is. One pass over the files cuts them into byte ranges ("splits") and counts, in each on its own, the
quotes and the line ends that close a record if the split starts outside quotes, and if it starts inside.
Prefix sums over the splits of a file, a small row for each, then tell how every split starts and which record
is the first to start in it. That index is a table; a lookup joins positions with it and opens only
the splits that hold a wanted record, each once.

A record belongs to the split where it starts, and is read on past the split's end. Quotes in quoted fields
are doubled, as the library's writer does it, so quotes outside and inside a field count alike.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import prefix_sums
from ..util import broadcast_if_small, materialize

SPLIT_BYTES = 32 << 20
READ_ON = 1 << 16        # bytes read at a time past a split's end


def _ends(data: bytes, quoted: bool) -> np.ndarray:
    """Where records end: places of line ends outside quotes."""
    raw = np.frombuffer(data, np.uint8)
    inside = (np.cumsum(raw == 34) + quoted) % 2 == 1
    return np.flatnonzero((raw == 10) & ~inside)


def position_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The index of all files under ``path`` (in name order), a row for each split: where it starts, whether inside quotes, the number of
    the first record that starts in it, how many do, and that record's position over all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length") \
        .filter(F.col("length") > 0)
    n = F.ceil(F.col("length") / split_bytes)
    cuts = files.select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("split"))
    cuts = cuts.select("file", "split", (F.col("split").cast("long") * split_bytes).alias("offset"),
                       F.least(F.lit(split_bytes).cast("long"), F.col("length") - F.col("split").cast("long") * split_bytes).alias("length"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = _read(r["file"], r["offset"], r["length"])
                out, inside = len(_ends(data, False)), len(_ends(data, True))
                rows.append({**r, "quotes": data.count(b'"') % 2, "ends_out": out, "ends_in": inside, "last": data[-1:] == b"\n"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("file", pa.string()), ("split", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("quotes", pa.int32()),
                ("ends_out", pa.int64()), ("ends_in", pa.int64()), ("last", pa.bool_())]))
    counted = cuts.repartition("file", "split").mapInArrow(
        count, "file STRING, split INT, offset BIGINT, length BIGINT, quotes INT, ends_out BIGINT, ends_in BIGINT, last BOOLEAN")
    own = Window.partitionBy("file").orderBy("split")                   # a row for each split
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    state = counted.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1) \
        .withColumn("ends", F.when(F.col("quoted"), F.col("ends_in")).otherwise(F.col("ends_out"))) \
        .withColumn("closed", F.col("last") & (((F.col("quoted").cast("int") + F.col("quotes")) % 2) == 0))
    # records that start in a split: its ends, but for one on its last byte, and the first record of a file
    # or the one that starts right behind the split before
    starts = F.col("ends") - F.col("closed").cast("int") + F.when(F.lag("closed").over(own).isNull(), 1).otherwise(
        F.lag("closed").over(own).cast("int"))
    state = state.withColumn("n_records", starts).withColumn("first_record", F.coalesce(F.sum("n_records").over(before), F.lit(0)))
    state = materialize(state)
    per_file = prefix_sums(state.groupBy("file").agg(F.sum("n_records").alias("n")), "file", ["n"])
    base = per_file.select("file", (F.col("cum_n") - F.col("n")).alias("base"))
    return materialize(state.join(broadcast_if_small(base), "file").select(
        "file", "split", "offset", "length", "quoted", "first_record", "n_records", (F.col("base") + F.col("first_record")).alias("first_position")))


def _read(uri: str, offset: int, length: int) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def _records(uri: str, offset: int, length: int, quoted: bool, wanted: list[int]) -> Iterator[bytes]:
    """The wanted records of a split, by their number among those that start in it, ascending."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        data = f.read_at(length, offset)
        ends = _ends(data, quoted)
        opened = offset == 0 or (not quoted and f.read_at(1, offset - 1) == b"\n")   # a record starts on the first byte
        starts = ends + 1 if not opened else np.concatenate(([0], ends + 1))
        starts = starts[starts < length]
        tail, state = b"", (data.count(b'"') + quoted) % 2 == 1
        if wanted and wanted[-1] == len(starts) - 1 and not (len(ends) and ends[-1] == length - 1):
            at = offset + length                       # the last record goes on behind the split
            while True:
                more = f.read_at(READ_ON, at)
                found = _ends(more, state)
                tail += more[:found[0] + 1] if len(found) else more
                if len(found) or not more:
                    break
                state, at = (more.count(b'"') + state) % 2 == 1, at + len(more)
        for n in wanted:
            end = starts[n + 1] if n + 1 < len(starts) else length
            yield data[starts[n]:end] + (tail if n + 1 == len(starts) else b"")


def rows_at(index: DataFrame, positions: DataFrame, schema: str, position: str = "position") -> DataFrame:
    """The rows at ``positions`` (one column; repeats count once), with their ``position`` over all files, as strings cast to
    ``schema``. Positions beyond the last row give none. A split without a wanted row isn't opened."""
    spark = index.sparkSession
    wanted = positions.select(F.col(position).cast("long").alias("position")).distinct()
    size = index.agg(F.sum("n_records").alias("rows"), F.count(F.lit(1)).alias("splits")).first()
    step = max(1, (size["rows"] or 0) // max(1, size["splits"]))      # positions of an average split
    end = F.col("first_position") + F.col("n_records")
    cells = index.filter("n_records > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"first_position DIV {step}"), F.floor((end - 1) / step))))
    inside = (F.col("position") >= F.col("first_position")) & (F.col("position") < end)
    met = wanted.withColumn("cell", F.expr(f"position DIV {step}")).join(cells, "cell").filter(inside)
    met = met.groupBy("file", "offset", "length", "quoted", "first_position").agg(
        F.array_sort(F.collect_list((F.col("position") - F.col("first_position")).cast("int"))).alias("wanted"))   # at most the rows of a split
    fields = spark.createDataFrame([], schema).schema.fields

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for n, record in zip(r["wanted"], _records(r["file"], r["offset"], r["length"], r["quoted"], r["wanted"])):
                    values = next(csv.reader(io.StringIO(record.decode(), newline=""), quoting=csv.QUOTE_NOTNULL), [])
                    values = values[:len(fields)] + [None] * (len(fields) - len(values))
                    out.append([r["first_position"] + n, *values])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*out))],
                                                     names=["position", *[f.name for f in fields]])
    text = met.repartition("file", "offset").mapInArrow(read, "position BIGINT, " + ", ".join(f"`{f.name}` STRING" for f in fields))
    return text.select("position", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
