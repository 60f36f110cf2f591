"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, joined_as, written


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    """Least ``v`` of each ``u``; at most one row for each edge, hence broadcast if these are few."""
    return joined_as(pairs.groupBy("u").agg(F.min("v").alias("m")), rows <= BROADCAST_ROWS)


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step.

    No step holds the neighbours of a node together: minima are partial
    aggregates, the rest is a join back to the edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (both.join(_least(both, rows), "u").filter(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct())
    least = large.join(_least(large, rows), "u")
    return (least.select("u", F.col("m").alias("v"))
            .unionByName(least.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u != v").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges (u, v)``; the root is the least node
    of the component. Alternates star steps, each a written table, until the edges
    stay the same; they are then stars around the roots."""
    edges = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                    "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, before = state(edges), None
    while now != before:
        edges = written(_stars(edges, 2 * now[0]), "edges")
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
