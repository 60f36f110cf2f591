"""Exact vector search that leaves out cells by their radii (EVA-10, RNK-1 for many queries).

Some vectors of the corpus are pivots. Every vector belongs to the cell of its nearest pivot, at a distance r from
it, and the members of a cell, in order of r, are cut into blocks of at most ``BLOCK_ROWS``. By the triangle
inequality a query at distance d from the pivot is no nearer to any member of a block than d minus the block's largest
r, or its smallest r minus d.

1. Each query is measured against one block, that of its own cell which holds its own distance, and has a k-th best
   distance from then on.
2. It goes on to those blocks only whose bound is not beyond that distance, and the best of all are kept.

Queries meet their own block in a join on it, so no task holds more than a block and ``QUERY_ROWS`` queries: a block that very
many queries want is given out in copies. They go on in tiles of ``CHUNK_ROWS`` queries that began side by side; a tile meets
a chunk of neighbouring blocks once, if any of its queries reaches one of them, so what is sent grows with tiles x chunks and not
with queries x blocks. Where cells can't be told apart every pair is measured; a query keeps what is no farther than its k-th
best and nothing is sorted whole. The pivots and one row for each block are all that every task knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import broadcast_if_small, materialize, top_k
from .vector import MAX_QUERY_ROWS, ROUND_KEY, vector_topk

PIVOTS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 4096        # queries that meet a block at once, on average
MOST_BLOCKS = 200_000    # blocks get larger beyond
SHARES = 256             # of a cell by distance, at most
CHUNK_ROWS = 32_768      # vectors, and queries, that meet in a task beyond a query's own block
FIRST_ROWS = 512         # members measured before bounds are known
CHUNK_CELLS = 1 << 22    # bounds or distances that a task holds at once
SLACK = 1e-6             # of a distance: bounds are kept a little too wide


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _in_cells(vectors: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray) -> DataFrame:
    """``(id, vec, cell, r)``: the nearest pivot of every vector and its distance."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d2 = _distances(_stack(pdf["vec"]), pivots)
                cell = d2.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), r=np.sqrt(d2[np.arange(len(pdf)), cell]))
    kind = dict(vectors.dtypes)[id_col]
    return vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .mapInPandas(run, f"id {kind}, vec array<double>, cell int, r double")


def cells_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "embedding",
               pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS,
               counts: dict | None = None) -> DataFrame:
    """The result of ``vector_topk``: ``(query_id, <id_col>, d2, rank)``. ``counts``, if given, receives ``all`` (pairs of query
    and vector) and ``measured`` (those whose distance was taken)."""
    spark = corpus.sparkSession
    id_type, q_type = dict(corpus.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    chosen = corpus.filter(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(vec_col).limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], f"query_id {q_type}, {id_col} {id_type}, d2 double, rank int")
    points = _stack(r[0] for r in chosen)                               # at most ``pivots`` vectors

    members = materialize(_in_cells(corpus, id_col, vec_col, points))
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    n_all = sizes.agg(F.sum("n")).first()[0]
    block_rows = max(block_rows, -(-n_all // MOST_BLOCKS))
    # shares of a cell by distance, from its quantiles, so that a large cell is not sorted in one task
    limits = materialize(members.groupBy("cell").agg(F.percentile_approx("r", [i / SHARES for i in range(1, SHARES)], 1000).alias("q"))
                         .join(sizes, "cell").withColumn("shares", F.least(F.ceil(F.col("n") / block_rows), F.lit(SHARES))))
    place = F.aggregate("q", F.lit(0), lambda a, x: a + (F.col("r") > x).cast("int"))            # 0 .. SHARES - 1
    placed = members.join(F.broadcast(limits.select("cell", "shares", "q")), "cell").select(      # at most ``pivots`` rows
        "id", "vec", "cell", "r", F.floor(place * F.col("shares") / SHARES).alias("share"))
    placed = materialize(placed)
    # what is still too large (many at one distance, copies say) by id
    parts = placed.groupBy("cell", "share").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    blocked = materialize(placed.join(F.broadcast(parts), ["cell", "share"]).select(
        "id", "vec", "cell", "r", F.concat_ws(":", "cell", "share", part).alias("block")))
    table = blocked.groupBy("block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")) \
        .orderBy("cell", "low", "block").collect()                       # a row for each block
    names = np.array([r["block"] for r in table], dtype=object)
    cell, low, high, size = (np.array([r[c] for r in table]) for c in ("cell", "low", "high", "n"))

    asked = materialize(_in_cells(queries, "query_id", "embedding", points))

    def first_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, r in zip(pdf["cell"], pdf["r"]):
                own = np.flatnonzero(cell == c)
                if not len(own):                                          # a cell of queries only
                    own = np.arange(len(names))
                out.append(names[own[np.argmin(np.maximum(low[own] - r, r - high[own]))]])
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "block": out})
    start = materialize(asked.mapInPandas(first_block, f"id {q_type}, vec array<double>, block string"))
    near = materialize(_measure(start, blocked, k, id_type, q_type, query_rows))
    kth = top_k(near, ["query_id"], [F.col("d2_key"), F.col("id")], k, "n").filter(F.col("n") == k).select(
        F.col("query_id").alias("id"), F.col("d2").alias("kth"))
    done = materialize(start.select("id", F.col("block").alias("done")).join(kth, "id", "left"))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK_CELLS // len(names))
        for whole in batches:
            for first in range(0, len(whole), step):
                pdf = whole.iloc[first:first + step]
                hit = _within_reach(_stack(pdf["vec"]), pdf["kth"], points, cell, low, high)
                hit &= names[None, :] != pdf["done"].to_numpy(dtype=object)[:, None]
                for tile, rows in pdf.reset_index(drop=True).groupby("tile").groups.items():
                    n = np.bincount(chunk_of, weights=hit[np.asarray(rows)].sum(0) * size, minlength=chunk_of[-1] + 1).astype(np.int64)
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"tile": [tile] * len(at), "chunk": at, "pairs": n[at]})
    # neighbouring blocks make a chunk, the queries that began in a chunk a tile (several, if they are many)
    chunk_of = np.zeros(len(names), dtype=np.int64)
    room = 0
    for i, n in enumerate(size.tolist()):
        new = i > 0 and room + n > chunk_rows
        chunk_of[i], room = chunk_of[i - 1] + new if i else 0, n if new else room + n
    home = F.broadcast(spark.createDataFrame(list(zip(names.tolist(), chunk_of.tolist())), "block string, chunk long"))    # a row for each block
    begun = start.join(home, "block")
    tiles = begun.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("copies"))
    tile = F.concat_ws(":", "chunk", F.pmod(F.xxhash64("id"), F.col("copies")))
    tiled = materialize(begun.join(F.broadcast(tiles), "chunk").select("id", "vec", tile.alias("tile")).join(done, "id"))
    wanted = materialize(tiled.mapInPandas(reached, "tile string, chunk long, pairs long").groupBy("tile", "chunk").agg(F.sum("pairs").alias("pairs")))
    if counts is not None:
        n_of = dict(zip(names.tolist(), size.tolist()))
        per = start.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
        counts["all"] = int(size.sum()) * asked.count()
        counts["measured"] = sum(r["n"] * n_of[r["block"]] for r in per) + (wanted.agg(F.sum("pairs")).first()[0] or 0)

    number = {n: i for i, n in enumerate(names.tolist())}

    def measure(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = _Best(k, q["kth"].fillna(np.inf).to_numpy(dtype=np.float64))
        if len(q) and len(x):
            vecs, ended = _stack(q["vec"]), q["done"].to_numpy(dtype=object)
            for block, rows in x.groupby("block"):
                b = [number[block]]
                mine = np.flatnonzero(_within_reach(vecs, q["kth"], points, cell[b], low[b], high[b])[:, 0] & (ended != block))
                found.add(vecs, mine, _stack(rows["vec"]), rows["id"].to_numpy())
        return found.table(q["id"].to_numpy())
    pair = broadcast_if_small(wanted.select("tile", "chunk"))
    left = tiled.join(pair, "tile")
    right = blocked.select("id", "vec", "block").join(home, "block").join(pair, "chunk")
    far = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInPandas(
        measure, f"query_id {q_type}, id {id_type}, d2 double, d2_key double")
    best = top_k(near.unionByName(far), ["query_id"], [F.col("d2_key"), F.col("id")], k, "rank")
    return best.select("query_id", F.col("id").alias(id_col), "d2", "rank")


def _within_reach(vecs: np.ndarray, kth: pd.Series, points: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a block (column) may hold something as near as a query's (row) k-th best."""
    own, place = np.unique(cell, return_inverse=True)
    d = np.sqrt(_distances(vecs, points[own]))[:, place]
    bound = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0.0)
    reach = np.sqrt(kth.fillna(np.inf).to_numpy(dtype=np.float64)) * (1 + SLACK) + SLACK
    return bound <= reach[:, None]


class _Best:
    """The ``k`` nearest of some queries: what is farther than a query's k-th best is not kept, so nothing whole is sorted."""

    def __init__(self, k: int, kth: np.ndarray):
        self.k, self.kth, self.held = k, kth, []

    def add(self, vecs: np.ndarray, mine: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, CHUNK_CELLS // max(1, len(ids)))
        for first in range(0, len(mine), step):
            rows = mine[first:first + step]
            d2 = _distances(vecs[rows], x)
            at, of = np.nonzero(d2 <= self.kth[rows, None] + 10.0 ** -ROUND_KEY)
            self.held.append((rows[at], ids[of], d2[at, of]))
            if sum(len(h[0]) for h in self.held) > CHUNK_CELLS // 4:
                self._cut()

    def _cut(self) -> None:
        at, ids, d2 = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        order = np.lexsort((ids, np.round(d2, ROUND_KEY), at))
        at, ids, d2 = at[order], ids[order], d2[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        last = nth == self.k - 1
        self.kth[at[last]] = np.minimum(self.kth[at[last]], d2[last])
        keep = nth < self.k
        self.held = [(at[keep], ids[keep], d2[keep])]

    def table(self, qids: np.ndarray) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"query_id": [], "id": [], "d2": [], "d2_key": []})
        self._cut()
        at, ids, d2 = self.held[0]
        return pd.DataFrame({"query_id": qids[at], "id": ids, "d2": d2, "d2_key": np.round(d2, ROUND_KEY)})


def _measure(asked: DataFrame, blocked: DataFrame, k: int, id_type: str, q_type: str, query_rows: int) -> DataFrame:
    """``(query_id, id, d2, d2_key)``: the ``k`` nearest members of the block each row of ``asked (id, vec, block)`` names."""
    wanted = materialize(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("copies")))
    left = asked.join(wanted, "block").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).select("id", "vec", "block", "copy")
    right = blocked.select("id", "vec", "block").join(wanted, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .select("id", "vec", "block", "copy")

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = _Best(k, np.full(len(q), np.inf))
        if len(q) and len(x):
            vecs = _stack(q["vec"])
            for first in range(0, len(x), FIRST_ROWS):      # the first few give bounds for the rest
                part = x.iloc[first:first + FIRST_ROWS]
                found.add(vecs, np.arange(len(q)), _stack(part["vec"]), part["id"].to_numpy())
                if found.held:
                    found._cut()
        return found.table(q["id"].to_numpy())
    return left.groupBy("block", "copy").cogroup(right.groupBy("block", "copy")).applyInPandas(
        run, f"query_id {q_type}, id {id_type}, d2 double, d2_key double")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """``vector_topk`` where one pass over the corpus meets all queries, ``cells_topk`` where they are more."""
    if queries.count() <= MAX_QUERY_ROWS:
        return vector_topk(corpus, queries, k, id_col=id_col, vec_col=vec_col)
    return cells_topk(corpus, queries, k, id_col=id_col, vec_col=vec_col)
