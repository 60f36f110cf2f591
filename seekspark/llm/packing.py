"""Best-fit decreasing packing of token sequences.

Documents are encoded, closed with an end id and, only where longer than a
sequence, cut into pieces of its length. Best-fit decreasing then places every
piece, longest first, into the open sequence with the least room that holds
it. Pieces of one length are alike, so the whole corpus is packed from its
length histogram (one number for each length up to the capacity): a segment
tree over remaining capacities finds the tightest open room in logarithmic
time, and sequences with the same room stand in it as ranges of numbers. The
result is a plan of runs: "of length l, the pieces from rank a on go q to a
sequence, from sequence s on, at offset o". The plan is as large as the number
of runs, which depends on lengths and capacity; tasks look pieces up in it by
(length, rank). Neither pieces nor sequences pass through the driver, and the
packing equals that of one sequential best-fit decreasing pass over all pieces.

The rank of a piece among those of its length is its place in its task plus
the counts of earlier tasks, so no group of equal lengths meets in one task.

Cases: a null or empty text is its end id alone; rows that repeat are packed
each; an empty table gives an empty result; ties (equal lengths, equal rooms)
go by rank and by lowest sequence number; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import small, written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
FLUSH_BYTES = 4 << 20  # ids that a task holds before it hands them on


def encode_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY,
                  text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids, task, place)`` as a written table; ``place``
    counts the pieces of the same length in the same task."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("task", T.IntegerType()),
                           T.StructField("place", T.LongType())])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokens.pieces(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)

        def out(batch, rows):
            at, piece, start, length, ids, place = map(list, zip(*rows))
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array([task] * len(rows), pa.int32()),
                pa.array(place, pa.int64())], names=[f.name for f in schema])
        for batch in batches:
            rows, held = [], 0
            for i, ids in enumerate(coder.all_ids(t.as_py() for t in batch.column(1))):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    size = len(part) // 4
                    rows.append((i, n, at // 4, size, part, seen[size]))
                    seen[size] += 1
                held += len(ids)
                if held >= FLUSH_BYTES:
                    yield out(batch, rows)
                    rows, held = [], 0
            if rows:
                yield out(batch, rows)
    return written(docs.select(doc_id, text).mapInArrow(encode, schema), "pieces")


class Rooms:
    """Segment tree over remaining capacities; a leaf holds ranges of sequences with that room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)  # ranges below each node
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            self.ranges[room].append((first, n))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.ranges[room].pop()

    def tightest(self, length: int) -> int | None:
        """Least room of ``length`` or more among open sequences."""
        node = length + self.width
        if self.open[node]:
            return length
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return None
        while node < self.width:
            node *= 2
            if not self.open[node]:
                node += 1
        return node - self.width


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs ``(length, first rank, first sequence, pieces in each, first offset)`` by length and rank."""
    rooms, runs, fresh = Rooms(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                rooms.add(capacity, fresh, n)
                fresh += n
                continue
            first, n = rooms.take(room)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                rooms.add(room - each * length, first, full)
            rest = left if full < n and left < each else 0
            if rest:
                runs.append((length, rank, first + full, each, capacity - room))
                rank, left = rank + rest, 0
                rooms.add(room - rest * length, first + full, 1)
            used = full + bool(rest)
            rooms.add(room, first + used, n - used)
    return np.array(runs, np.int64).reshape(-1, 5)


def place(runs: np.ndarray):
    """UDF ``(length, rank) -> (sequence_id, offset)``."""
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = (runs[:, 0] << 45) | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(key, (n << 45) | r, side="right") - 1]
        each, at = run[:, 3], r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + at // each, "offset": run[:, 4] + at % each * n})
    return look_up


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)`` for every piece; ``ids``
    are little-endian unsigned 32-bit integers."""
    cut = encode_pieces(docs, path, end_id, capacity, text, doc_id)
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
                     "piece-ranks")
    ranked = cut.join(small(before), ["length", "task"])
    found = place(best_fit_decreasing(histogram, capacity))(F.col("length"), F.col("place") + F.col("before"))
    return ranked.withColumn("found", found).select("doc_id", "piece", "start", "length", "ids", "found.sequence_id",
                                                    "found.offset")
