"""Compression of vectors to codes by product quantisation with Orchard's search.

Components become integers (``floor(SCALE * x)``), vectors are cut into equal parts,
and each part position has a codebook, which starts as that part of the vectors of
smallest id. In every round each part goes to the nearest entry of its codebook,
and each entry becomes the floor of the mean of its parts.

The nearest entry is found by Orchard's search. For every entry all others are
listed by their distance from it. A search holds the best entry found so far and
reads that entry's list; it jumps to the list of a better entry as soon as one is
found, marks what it has visited so that nothing is measured twice, and stops where
the list goes beyond twice the current distance: by the triangle inequality no entry
further on can be as near. That holds for ties too, so of equal distances the lowest index
wins. Many searches run side by side: those that read the same list measure the same
next entries in one step. Distances are exact integers.

The codebooks are the only state: ``entries`` x dimensions numbers on the driver and in every
task. A round is one pass in which a task sends one row of sums for each entry it used.

Cases: rows whose vector is null or holds a null, NaN or infinite component are
dropped. The dimension is that of the kept vector of smallest id (null ids last; ties in id by
the components) whose length the parts divide; a kept vector of another length has a null
code and error and takes no part in training. Components beyond +-2**26 after scaling count as
that bound; a part has at most ``MOST_WIDTH`` components. With fewer kept vectors than entries, there are as many entries as vectors; an entry that no part
goes to stays as it is. Repeated rows count each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BOUND = 1 << 26  # of a component after scaling
MOST_WIDTH = 256  # components of a part: squared distances then fit 63 bits
CHUNK = 1 << 16  # vectors that are searched side by side
STEP = 32  # entries of a list that are measured together at first, then twice as many each time
STARTS = 16  # entries of which the nearest starts a search
TASK_ROWS = 1 << 14  # vectors that a task has at least
SALTS = 16


class Codebook:
    """Entries of one part position, and for each of them the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n = len(entries)
        apart = np.array([((self.entries - e) ** 2).sum(1) for e in self.entries]).reshape(n, n)
        self.near = np.argsort(apart, axis=1, kind="stable")  # an entry's own list starts with itself or an equal one
        self.reach = -(-np.take_along_axis(apart, self.near, 1) // 4)  # to be compared with a distance, both squared
        self.square = (self.entries ** 2).sum(1)
        starts = [0]  # each next one is the entry farthest from those before
        far = apart[0].copy() if n else apart
        while len(starts) < min(STARTS, n):
            starts.append(int(far.argmax()))
            far = np.minimum(far, apart[starts[-1]])
        self.starts = np.unique(starts)

    def measure(self, x: np.ndarray, square: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of ``x`` from some entries; floats where these are exact."""
        cross = x @ self.entries[which].astype(x.dtype).T
        return square[:, None] - 2 * cross + self.square[which].astype(x.dtype)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equals, and its squared distance."""
        most = max(int(np.abs(parts).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = 4 * parts.shape[1] * most * most < 1 << 53  # then doubles hold every sum exactly
        x = parts.astype(np.float64 if exact else np.int64)
        square = (x * x).sum(1)
        n = len(x)
        seen = np.zeros((n, len(self.entries)), bool)
        first = self.measure(x, square, self.starts)
        at = first.argmin(1)
        best, dist = self.starts[at], first[np.arange(n), at]
        seen[:, self.starts] = True
        reading = np.arange(n)
        while len(reading):
            reading = reading[np.argsort(best[reading], kind="stable")]
            lists, cut = np.unique(best[reading], return_index=True)
            jumped = []
            for entry, rows in zip(lists.tolist(), np.split(reading, cut[1:])):
                i, step = 0, STEP
                while i < len(self.entries):
                    rows = rows[self.reach[entry, i] <= dist[rows]]
                    if not len(rows):
                        break
                    which = np.sort(self.near[entry, i:i + step])
                    i, step = i + step, 2 * step
                    done = seen[rows[:, None], which]
                    open_ = ~done.all(0)
                    if not open_.any():
                        continue
                    which, done = which[open_], done[:, open_]
                    found = np.where(done, np.inf if exact else np.iinfo(np.int64).max, self.measure(x[rows], square[rows], which))
                    seen[rows[:, None], which] = True
                    at = found.argmin(1)
                    least, to = found[np.arange(len(rows)), at], which[at]
                    better = (least < dist[rows]) | (least == dist[rows]) & (to < best[rows])
                    moved = rows[better]
                    best[moved], dist[moved] = to[better], least[better]
                    jumped.append(moved)
                    rows = rows[~better]
            reading = np.concatenate(jumped) if jumped else reading[:0]
        return best, dist.astype(np.int64)


class Codebooks:
    """The codebooks of all part positions; ``entries`` has the shape (parts, entries, components)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.books = [Codebook(e) for e in self.entries]
        self.dims = entries.shape[0] * entries.shape[2]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, a column for each part."""
        cut = points.reshape(len(points), len(self.books), -1).astype(np.int64)
        found = [b.nearest(np.ascontiguousarray(cut[:, p])) for p, b in enumerate(self.books)]
        return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)

    def sha256(self) -> str:
        """Digest of all components in order, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def points(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """Kept rows as a written table ``(vec_id, label, size, point)``; ``point`` holds little-endian 32-bit integers."""
    v = F.col(f"`{vector}`")
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    schema = T.StructType([*kept.select("vec_id", "label").schema.fields, T.StructField("size", T.IntegerType()),
                           T.StructField("point", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False), -BOUND, BOUND) * SCALE)  # no overflow
            whole = np.clip(flat, -BOUND, BOUND).astype("<i4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            out = [whole[a:b].tobytes() for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(o) // 4 for o in out], pa.int32()),
                                              pa.array(out, pa.binary())], names=[f.name for f in schema])
    return written(kept.mapInArrow(run, schema), "points")


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The rows in tables of ``CHUNK`` rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims)


def _dealt(kept: DataFrame) -> DataFrame:
    """At least ``TASK_ROWS`` rows a task: searches side by side pay for a list once."""
    tasks = -(-kept.count() // TASK_ROWS)
    return kept.coalesce(max(1, tasks))


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of smallest id; none if no vector can be cut."""
    can = kept.filter((F.col("size") > 0) & (F.col("size") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("point")]
    one = can.orderBy(*order).select("size").first()
    if one is None:
        return None
    if one["size"] // parts > MOST_WIDTH:
        raise ValueError(f"parts of more than {MOST_WIDTH} components")
    rows = can.filter(F.col("size") == one["size"]).orderBy(*order).select("point").limit(entries).collect()
    start = np.frombuffer(b"".join(bytes(r["point"]) for r in rows), "<i4").reshape(len(rows), parts, -1)
    return Codebooks(start.transpose(1, 0, 2))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows of a table made by ``points``."""
    books = first_codebooks(kept, parts, entries)
    if books is None:
        return None
    width = books.entries.shape[2]
    sums = [f"s{j}" for j in range(width)]
    own = _dealt(kept.filter(F.col("size") == books.dims).select("point"))
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = np.zeros(now.entries.shape, np.int64)
            count = np.zeros(now.entries.shape[:2], np.int64)
            for chunk in _chunks(batches, 0):
                x = _matrix(chunk.column(0), now.dims)
                codes, _ = now.assign(x)
                cut = x.reshape(len(x), len(now.books), -1).astype(np.int64)
                for p in range(len(now.books)):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(cut[order, p], first, axis=0)
                    count[p] += np.bincount(codes[:, p], minlength=count.shape[1])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, count[part, entry], *total[part, entry].T)],
                                             names=["part", "entry", "n", *sums])
        rows = own.mapInArrow(add_up, "part long, entry long, n long, " + ", ".join(f"{s} long" for s in sums)) \
            .groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect()  # a row for each entry at most
        new = books.entries.copy()
        for r in rows:
            new[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
        books = Codebooks(new)
        shared.unpersist()
    return books


def assign(kept: DataFrame, books: Codebooks | None) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits for each part (more if there are over 256 entries) and the squared distance."""
    schema = T.StructType([*kept.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    other = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        return other
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        digits = max(2, -(-(now.entries.shape[1] - 1).bit_length() // 4))
        text = np.array([f"{i:0{digits}x}" for i in range(now.entries.shape[1])], dtype=object)
        for chunk in _chunks(batches, 2):
            codes, dist = now.assign(_matrix(chunk.column(2), now.dims))
            yield from pa.table([chunk.column(0), chunk.column(1), pa.array(text[codes].sum(1), pa.string()),
                                 pa.array(dist.sum(1))], names=[f.name for f in schema]).combine_chunks().to_batches()
    own = _dealt(kept.filter(F.col("size") == books.dims).select("vec_id", "label", "point")).mapInArrow(run, schema)
    return own.unionByName(other.filter(F.col("size") != books.dims))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` (a written table) with ``label_error``, the errors summed over equal labels, nulls together.

    Beyond the broadcast bound the totals are dealt out in copies, one for each salt, so
    that the rows of a hot label spread over as many join keys."""
    sums = written(codes.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"))
                   .withColumnRenamed("label", "of_label"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= BROADCAST_ROWS:
        return codes.join(F.broadcast(sums), same).drop("of_label")
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.hash("vec_id", "code", "error"), F.lit(SALTS)))
    return salted.join(sums, same & (F.col("salt") == F.col("of_salt"))).select(*codes.columns, "label_error")


def approximate(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for; null has none."""
    entries = books.entries
    parts, n, _ = entries.shape
    digits = max(2, -(-(n - 1).bit_length() // 4))

    @F.pandas_udf("array<double>")
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else np.concatenate(
            [entries[p, int(c[p * digits:(p + 1) * digits], 16)] for p in range(parts)]) / SCALE for c in codes], dtype=object)
    return run(code)
