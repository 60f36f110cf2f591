"""SimHash near-dedup by segment popcounts.

A fingerprint of 64 bits becomes a vector of 16 popcounts, one for each
segment of four bits. Where two fingerprints differ in d bits, their vectors
differ by at most d in Manhattan distance, so that distance bounds the Hamming
distance from below. Two integer vectors within distance 2 have a common
point within distance 1 of each. So a grid range-join is an equality join:
each fingerprint goes to its own cell and to the neighbours one step away (33
at most), and all pairs within distance 2 meet in some cell.

A cell of two fingerprints is verified at once. The fingerprints of a cell of
three or more go to the finest grid, segments of one bit, where Manhattan and
Hamming distance are the same: all that meet in a cell there are within two
bits of each other, and each is linked to the least of them. So a crowded cell
costs links in proportion to its size, no pairs, and loses no connection.

Only distinct fingerprints are joined; copies follow their fingerprint.

Cases: a null, empty or blank text has fingerprint 0, linked like any other;
texts of one or two words hash as one shingle; repeated rows get the same
component; rows of null doc_id take part, but an id of null is never the
smallest unless the component has no other; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, joined_as, small, text_key, whole_row, written
from .components import connected

SHINGLE = 3
MAX_BITS = 2  # the grids above hold for this distance
SEED = 42
FINE_CELLS = 65  # of a fingerprint: itself and one for each bit


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return udf(text)


def _nibble_counts(x: Column) -> Column:
    """Popcount of each four bits of a 32-bit number, in those four bits."""
    pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
    return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))


def popcounts(fp: Column) -> Column:
    """The vector of 16 segment popcounts, four bits each in a 64-bit integer."""
    low = _nibble_counts(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.shiftleft(_nibble_counts(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(low)


def coarse_cells(vector: Column) -> Column:
    """The cell of a popcount vector and those one step away."""
    near = [vector]
    for i in range(0, 64, 4):
        here, step = F.shiftrightunsigned(vector, i).bitwiseAND(F.lit(15)), F.lit(1 << i)
        near += [F.when(here < 4, vector + step), F.when(here > 0, vector - step)]
    return F.array(*near)


def fine_cells(fp: Column) -> Column:
    """The fingerprint itself and all at one bit from it."""
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(b).cast("long")) for b in bits])


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect all of ``fps (fp)`` within two bits of each other, none beyond."""
    cells = (fps.select("fp", popcounts(F.col("fp")).alias("vector"))
             .select("fp", F.explode(coarse_cells(F.col("vector"))).alias("cell")).filter("cell IS NOT NULL"))
    shared = written(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
                     .filter("n > 1"), "cells")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    twos = shared.filter((F.col("n") == 2) & close).select("u", "v")
    crowded = written(cells.join(small(shared.filter("n > 2").select("cell")), "cell", "left_semi").select("fp").distinct(),
                      "crowded")
    fine = crowded.select("fp", F.explode(fine_cells(F.col("fp"))).alias("cell"))
    centres = fine.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("u")).filter("n > 1").select("cell", "u")
    few = FINE_CELLS * crowded.count() <= BROADCAST_ROWS
    stars = fine.join(joined_as(centres, few), "cell").select("u", F.col("fp").alias("v")).filter(close & (F.col("u") != F.col("v")))
    return twos.unionByName(stars).distinct()


def component_table(prints: DataFrame) -> DataFrame:
    """``(fp, component, component_id)`` of every fingerprint of the written table
    ``prints (id, fp)``: the least fingerprint and the least id it reaches."""
    fps = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprints")
    roots = connected(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    linked = fps.join(small(written(roots, "roots")), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    merged = linked.filter(F.col("root").isNotNull()).groupBy("component").agg(F.min("least_id").alias("merged_id"))
    return written(linked.join(small(written(merged, "merged")), "component", "left").select(
        "fp", "component", F.coalesce("merged_id", "least_id").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(id, key, fp, component, component_id)``, one row for each row of ``docs``."""
    prints = written(docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"),
                                 fingerprint(F.col(text), shingle).alias("fp")), "prints")
    return prints.join(small(component_table(prints)), "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: the one of least id, then of least text key."""
    found = near_duplicates(docs, text, doc_id)
    stay = written(found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("s"))
                   .select("s.id", "s.key"), "survivors")
    rows = docs.select(whole_row(docs))
    rows = rows.select("row", F.col(f"row.{doc_id}").alias("id"), text_key(F.col(f"row.{text}")).alias("key")).alias("r")
    repeated = written(found.groupBy("id", "key").count().filter("count > 1").select("id", "key"), "repeated")

    def match(side: str) -> Column:
        return F.col("r.id").eqNullSafe(F.col(f"{side}.id")) & (F.col("r.key") == F.col(f"{side}.key"))
    kept = rows.join(small(stay).alias("s"), match("s"), "left_semi")
    again = small(repeated).alias("a")
    return (kept.join(again, match("a"), "left_anti").select("row.*").unionByName(
        kept.join(again, match("a"), "left_semi").dropDuplicates(["id", "key"]).select("row.*")))
