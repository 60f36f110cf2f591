"""Language identification by compression.

Each language has a zstandard dictionary of raw content: sample texts of that
language, joined. A text is cut into chunks, each chunk is compressed with each
dictionary, and the language with the fewest bytes in all is chosen. Chunks
keep long texts honest: a compressor that has read much of a text refers to
the text itself, no longer to the dictionary.

The dictionaries are fitted on a bounded sample of labelled rows: for each
language ``SAMPLE_DOCS`` documents at most (by the hash of the id), of each its
first ``SAMPLE_BYTES`` bytes, ``DICTIONARY_BYTES`` in all. Prediction reads
whole texts.

The score is the share of the best language if code lengths are read as
probabilities, a byte halving them: near 1 for a clear case, 1/2 for two that
tie. A margin under ``MARGIN`` bytes or ``MARGIN_SHARE`` of the best size is
narrow: ``accepted`` is false, the best guess stays in ``lang_pred``. Ties go
to the language with more labelled documents, then by name.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
any labelled row all are; a null lang is not learned from; rows that repeat are
predicted alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 256
SAMPLE_BYTES = 512
DICTIONARY_BYTES = 1 << 16
CHUNK = 2048
LEVEL = 12
MARGIN, MARGIN_SHARE = 2, 0.01
UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
_ASCII = re.compile(r"[^a-z]+")


def _image(text: str) -> bytes:
    """The words of a text in lower case; digits and signs belong to no language."""
    low = text.lower()
    return f" {(_ASCII if low.isascii() else _NO_LETTERS).sub(' ', low).strip()} ".encode()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, bytes]]:
    """``(language, dictionary)``, the languages with more labelled documents first.

    What reaches the driver is bounded by the languages times the sample sizes above."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    sample = (rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.substring(text, 1, SAMPLE_BYTES).alias("text"))
              .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).orderBy("lang", "n").collect())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    found: dict[str, bytes] = {}
    for r in sample:
        found[r["lang"]] = found.get(r["lang"], b"") + _image(r["text"])[:SAMPLE_BYTES]
    return [(k, found[k][:DICTIONARY_BYTES]) for k in sorted(found, key=lambda k: (-counts[k], k))]


class Compressors:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by_language = [(lang, zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options))
            for lang, d in dictionaries]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.by_language or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        image = _image(text)
        chunks = [image[i:i + CHUNK] for i in range(0, len(image), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in self.by_language]
        best = min(sizes)
        score = 1 / sum(2.0 ** -min(s - best, 1000) for s in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else best + MARGIN + best
        return self.by_language[sizes.index(best)][0], score, second - best >= max(MARGIN, MARGIN_SHARE * best)


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """``docs`` with the struct ``__lang`` of ``lang_pred``, ``score`` and ``accepted`` (in place of a column of that name)."""
    made: list[Compressors] = []  # once in each worker

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def udf(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Compressors(dictionaries))
        return pd.DataFrame([made[0].predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])
    return docs.withColumn("__lang", udf(F.col(text)))
