"""Importance resampling towards a target distribution, over a head-tail vocabulary.

Features are the runs of 1 to ``longest`` (1 or 2) consecutive words of a text; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``. The vocabulary has
two parts. The head is broadcast: the words that make up at least one in
``HEAD_WORDS`` of all word occurrences, found by an exact count over the corpus,
with the CRC state after each, and, where pairs are features, the pairs of head words
that make up as large a part of all pairs, with their buckets. Being defined by a
share, the head has at most ``HEAD_WORDS`` words and as many pairs, whatever the
size of the corpus. All other features, the tail, take a direct CRC, of a pair from
the state of its first word on. Head and tail give the same bucket for the same
feature, so the head changes the cost and not the result, and the bucket totals of
corpus and target are exact.

A bucket's gain is the floor of 1000 times the log ratio of its share in the target
to that in the corpus, one added to each count. A document's weight is the sum of its
features' gains; its score adds a Gumbel term drawn from its id, so the documents
of highest score are a sample without replacement, each with a chance that follows
from its weight.

Only the head, the totals (``buckets`` numbers for each side) and a row for each sorted
range reach the driver. Ranks come from sorted ranges and the row counts
of the ranges before; no task sees more than its range.

Cases: a null or empty text has no features and weight 0; the id of a row decides its
draw, a null id counting as the empty text, and rows that repeat draw alike; ties in
score go to the smaller id (null first), then to the smaller weight; with an empty corpus or
target the counts are 0 and the gains follow from the ones added; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written

BUCKETS = 10_000
LONGEST = 1  # words of a feature
MIN_WORDS = 20  # of a document that may be drawn
PERCENT = 10  # of those that are drawn
SEED = 2024
HEAD_WORDS = 1 << 16
HEAD_BYTES = 64  # of a head word at most
COUNTED = 1 << 19  # different words that a task counts before it hands them on
GROUP_CHARS = 4 << 20  # of texts that are looked up together
MARGIN = 0.02  # share of rows above the estimated cut that are sorted with those drawn

# A-Z to a-z; what is neither a letter, a digit nor beyond ASCII to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """The rows of the batches, in parts of bounded text, with the words of each."""
    for batch in batches:
        first, held, chars = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            held.append(words_of(text.as_py()))
            chars += len(text.as_py() or "")
            if chars >= GROUP_CHARS:
                yield batch.slice(first, len(held)), held
                first, held, chars = i + 1, [], 0
        if held:
            yield batch.slice(first, len(held)), held


class Head:
    """Frequent words with their CRC state and frequent pairs with their bucket."""

    def __init__(self, words: list[bytes], pairs: list[int], buckets: int):
        self.buckets, self.words = buckets, words
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w) for w in words], np.int64)
        self.pairs = np.array(sorted(pairs), np.int64)  # number of the first word times the words, plus that of the second
        self.pair_bucket = np.array([zlib.crc32(words[p // len(words)] + b" " + words[p % len(words)]) % buckets
                                     for p in self.pairs.tolist()], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places of words in the head; -1 for those of the tail."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def states(self, words: list[bytes], number: np.ndarray) -> np.ndarray:
        """CRC after each word."""
        out = self.state[number] if len(self.state) else np.zeros(len(words), np.int64)
        tail = np.flatnonzero(number < 0)
        out[tail] = [zlib.crc32(words[i]) for i in tail.tolist()]
        return out

    def features(self, texts: list[list[bytes]], longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features, and the text that each belongs to."""
        words = list(chain.from_iterable(texts))
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        number = self.numbers(words)
        state = self.states(words, number)
        if longest == 1:
            return state % self.buckets, text
        first = np.flatnonzero(text[:-1] == text[1:])
        code = np.where((number[first] >= 0) & (number[first + 1] >= 0), number[first] * len(self.words) + number[first + 1], -1)
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == code if len(self.pairs) else np.zeros(len(first), bool)
        bucket = np.empty(len(first), np.int64)
        bucket[known] = self.pair_bucket[at[known]]
        rest = np.flatnonzero(~known)
        bucket[rest] = [zlib.crc32(b" " + words[i + 1], s) % self.buckets
                        for i, s in zip(first[rest].tolist(), state[first[rest]].tolist())]
        return np.concatenate((state % self.buckets, bucket)), np.concatenate((text, text[first]))


def _frequent(counts: DataFrame, key: str) -> list:
    """Keys that make up at least one in ``HEAD_WORDS`` of the whole count: at most that many."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") * HEAD_WORDS >= total)
    return [r[key] for r in rows.select(key).collect()]


def head(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> Head:
    """The head of the vocabulary of ``docs``, by exact counts."""
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])
        for _, texts in _groups(batches, 0):
            seen.update(chain.from_iterable(texts))
            if len(seen) >= COUNTED:
                yield out()
                seen.clear()
        yield out()

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for _, texts in _groups(batches, 0):
            number = known.numbers(list(chain.from_iterable(texts)))
            own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            first = np.flatnonzero((own[:-1] == own[1:]) & (number[:-1] >= 0) & (number[1:] >= 0))
            pair, n = np.unique(number[first] * len(known.words) + number[first + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])
    texts = docs.select(F.col(f"`{text}`"))
    counts = written(texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    found = sorted(bytes(w) for w in _frequent(counts, "word") if len(w) <= HEAD_BYTES)
    if longest == 1 or not found:
        return Head(found, [], buckets)
    words = docs.sparkSession.sparkContext.broadcast(Head(found, [], buckets))
    pairs = written(texts.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "word-pairs")
    return Head(found, _frequent(pairs, "pair"), buckets)


def totals(docs: DataFrame, known, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``docs`` in each bucket; ``known`` is a broadcast head."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for _, texts in _groups(batches, 0):
            seen += np.bincount(known.value.features(texts, longest)[0], minlength=buckets)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["bucket", "n"])
    found = docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from the totals of both sides."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([floor(1000 * log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, known, text: str = "text", doc_id: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _groups(batches, 1):
            bucket, text_of = known.value.features(texts, longest)
            order = np.argsort(text_of, kind="stable") if longest > 1 else slice(None)
            n = np.bincount(text_of, minlength=len(texts))
            below = np.concatenate(([0], np.cumsum(gain[bucket][order])))
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(below[end] - below[end - n], pa.int64())], names=[f.name for f in schema])
    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``, from 1 on, null where a document isn't drawn."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    may = scored.filter(F.col("n_words") >= min_words)
    share = max(0.0, 1 - percent / 100 - MARGIN)
    about = may.agg(F.count("*").alias("n"), F.percentile_approx("score", F.lit(share), F.lit(1000)).alias("cut")).first()
    wanted = about["n"] * percent // 100
    # The estimated cut is used only if the documents above it are enough.
    enough = wanted and may.filter(F.col("score") >= about["cut"]).count() >= wanted
    above = (F.col("n_words") >= min_words) & (F.col("score") >= about["cut"] if enough else F.lit(wanted > 0))
    order = [F.col("score").desc(), F.col("doc_id"), F.col("weight")]
    spread = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(scored.filter(above).repartitionByRange(spread, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in counts]).tolist()
    first = scored.sparkSession.createDataFrame([(r, end - n) for (r, n), end in zip(counts, ends)], "range int, before long")
    placed = ranged.join(small(first), "range")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    cols = weighed.columns + ["score"]
    ranked = placed.withColumn("rank", rank).select(*cols, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.filter(~above).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
             longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document; those with a rank are drawn."""
    known = docs.sparkSession.sparkContext.broadcast(head(docs, text, longest, buckets))
    gain = gains(totals(docs, known, text, longest, buckets), totals(target, known, target_text, longest, buckets))
    return draw(weigh(docs, gain, known, text, doc_id, longest), percent, min_words, seed)
