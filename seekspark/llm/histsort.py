"""Sharding by histogram sort.

Rows are ordered by a 128-bit key, the hash of the text and then that of the
id: equal texts stand together, and a group of any size can be divided. The
boundaries of the shards are found without sorting: candidate keys ("probes")
are spread over the key range, every task counts the exact bytes of its rows
between neighbouring probes, the counts are added up, and each boundary keeps
the interval its target lies in, with new probes inside, until a probe is
within tolerance of the target or the interval has one key left. Only then are
the rows exchanged, once, into ranges of bounded size, each sorted; the ranges
of a shard, in order, are its sorted content.

Law ``bytes``: the bytes of any two shards differ by the tolerance and the
largest row at most. The driver holds probes and their counts, whose number
depends on the shards and ``MOST_RANGES``, not on the rows.

Cases: a null text has the size of a row alone and hashes as an empty one; a
null id hashes as one value; rows that repeat both are one key, which is not
divided, and each gets a slot of its own; empty shards are allowed (fewer keys
than shards); an empty table gives an empty result; other columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_row, written

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.001  # of the mean bytes of a shard
RANGE_BYTES = 8 << 20  # aimed at in a range, the unit that one task sorts
MOST_RANGES = 1 << 14
PROBES = 32  # inside each open interval
TOP = 1 << 128


def _image(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare like the pair of signed integers."""
    flip = np.uint64(1 << 63)
    pair = np.empty((len(a), 2), ">u8")
    pair[:, 0], pair[:, 1] = a.view(np.uint64) ^ flip, b.view(np.uint64) ^ flip
    return pair.reshape(-1).view("S16")


def _probes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def histogram(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of ``keys (a, b, size)`` below each probe, and in all as last entry."""
    edges, n = _probes(probes), len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            a, b, size = (c.to_numpy() for c in batch.columns)
            cell = np.searchsorted(edges, _image(a, b), side="right")
            rows += np.bincount(cell, minlength=n)
            np.add.at(total, cell, size)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"cell": used, "bytes": total[used], "rows": rows[used]})
    found = (keys.select("a", "b", "size").mapInArrow(count, "cell long, bytes long, rows long")
             .groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect())
    total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in found:
        total[r["cell"]], rows[r["cell"]] = r["bytes"], r["rows"]
    return np.cumsum(total), np.cumsum(rows)


def splitters(keys: DataFrame, shards: int, tolerance: float, total: int, per_shard: int) -> list[int]:
    """Keys that part the rows into ``shards * per_shard`` ranges of near-equal bytes.
    Only the boundaries of shards need the tolerance; those inside may be a quarter of a range off."""
    n = shards * per_shard
    target = [total * j // n for j in range(1, n)]
    slack = [tolerance * total / shards if j % per_shard == 0 else total / n / 4 for j in range(1, n)]
    low, high = [(0, 0, 0)] * (n - 1), [(TOP, total, None)] * (n - 1)  # key, bytes and rows below
    done: dict[int, int] = {}
    while len(done) < n - 1:
        inside = {(low[j][0], high[j][0]) for j in range(n - 1) if j not in done}
        probes = sorted({a + (b - a) * i // (PROBES + 1) for a, b in inside for i in range(1, PROBES + 1)}
                        - {a for a, _ in inside} - {0})
        if probes:
            total_below, rows_below = histogram(keys, probes)
        points = [(p, int(total_below[i]), int(rows_below[i])) for i, p in enumerate(probes)]
        at = [p[1] for p in points]
        for j in range(n - 1):
            if j in done:
                continue
            i = int(np.searchsorted(at, target[j], side="right"))
            if i and points[i - 1][0] > low[j][0]:
                low[j] = points[i - 1]
            if i < len(points) and points[i][0] < high[j][0]:
                high[j] = points[i]
            near = min((low[j], high[j]), key=lambda p: (abs(p[1] - target[j]), p[0]))
            one_row = high[j][2] is not None and high[j][2] - low[j][2] <= 1
            if abs(near[1] - target[j]) <= slack[j] or one_row or high[j][0] - low[j][0] <= 1:
                done[j] = near[0]
    return [done[j] for j in range(n - 1)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, text: str = "text",
          doc_id: str = "doc_id") -> DataFrame:
    """``(row, size, shard, slot)``: each row of ``docs`` as a struct, its size, shard and place there."""
    def key(row: str):
        body = F.coalesce(F.col(f"{row}{text}"), F.lit(""))
        return [F.xxhash64(body).alias("a"), F.xxhash64(F.col(f"{row}{doc_id}")).alias("b"),
                (F.octet_length(body) + ROW_BYTES).cast("long").alias("size")]
    keys = written(docs.select(*key("")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(-(-total // (shards * RANGE_BYTES)), MOST_RANGES // shards))
    cuts = splitters(keys, shards, tolerance, total, per_shard)
    below = [0, *histogram(keys, cuts)[1].tolist()] if total and cuts else [0] * (len(cuts) + 2)
    edges, first = _probes(cuts), np.array(below[:-1], np.int64)
    start = first - first[np.arange(len(first)) // per_shard * per_shard]  # rows of the shard before the range

    @F.pandas_udf("range int, start long")
    def find(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        cell = np.searchsorted(edges, _image(a.to_numpy(np.int64), b.to_numpy(np.int64)), side="right")
        return pd.DataFrame({"range": cell.astype(np.int32), "start": start[cell]})
    rows = docs.select(whole_row(docs)).select("row", *key("row."))
    rows = rows.withColumn("found", find("a", "b")).select("row", "size", "a", "b", "found.range", "found.start")
    place = F.row_number().over(Window.partitionBy("range").orderBy("a", "b")) - 1
    return rows.select("row", "size", F.expr(f"range DIV {per_shard}").cast("int").alias("shard"),
                       (F.col("start") + place).alias("slot"))
