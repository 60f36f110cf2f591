"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of the corpus is first cut into the matches of the split pattern, and
its distinct matches ("words") are laid out behind each other as one row of
byte symbols. An inverted index holds, for every pair of neighbouring symbols
that some merge joins, the positions where that pair stands, over all words at
once. The merges are then replayed in rank order: a merge takes its positions
from the index, joins them all in one step (of overlapping ones the leftmost),
and looks up only the neighbours it touched, whose new pairs enter the index
under their own ranks. No text is encoded twice: what is merged are the distinct
words, and documents are put together from their words' ids.

Merges never cross words, so the words of one block do not depend on those of
another, and replaying block by block gives what one replay over the whole
corpus would give, without sending any word to another task. A block is at most
``BLOCK_CHARS`` characters (or one text, if that is longer), which bounds the
memory of a task; nothing else is kept between blocks.

The ranks are those of a vocabulary in the ``tiktoken`` form. That library joins,
as long as it can, the pair of least rank in a word, and takes a word that is a
token of its own as it is. Both agree here: where a merge would make a pair of
lower rank than its own (a vocabulary that was not trained merge by merge), the
word is done again by that rule, one pair at a time.

Cases: a null or empty text has no ids and decodes to the empty text; any text
decodes to its own UTF-8 bytes; rows that repeat are encoded each; an empty table
gives an empty result; columns other than the text and the id are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 8 << 20  # of texts whose words are merged together
FLUSH_IDS = 1 << 19  # ids that a task holds before it hands them on
NEVER = np.int32(2**31 - 1)  # rank of a pair that no merge joins

# Letters and digits of Unicode versions after 16.0, which the tiktoken library
# counts as neither (fixed values, hexadecimal code points).
LATER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f ")
LATER_DIGITS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _set(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in ranges.split())


def split_pattern() -> str:
    """The public pattern whose matches are encoded separately."""
    import public_tokenizers
    return public_tokenizers.PATTERN


class Splitter:
    """Matches of a pattern, with the character classes of the tiktoken library."""

    def __init__(self, pattern: str):
        letters, digits = _set(LATER_LETTERS), _set(LATER_DIGITS)
        self.later = re.compile(f"[{letters}{digits}]")
        self.usual = regex.compile(pattern)
        self.strict = regex.compile("(?V1)" + pattern.replace("\\p{L}", f"[\\p{{L}}--[{letters}]]")
                                    .replace("\\p{N}", f"[\\p{{N}}--[{digits}]]"))

    def __call__(self, text: str) -> list[str]:
        strict = not text.isascii() and self.later.search(text)
        return (self.strict if strict else self.usual).findall(text)


class Merges:
    """The merges of a vocabulary: which pairs of tokens join, and into what."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.span = max(self.token) + 1
        joined = {self.ranks[t[:i]] * self.span + self.ranks[t[i:]]: r for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = np.array(sorted(joined), np.int64)
        self.into = np.array([joined[p] for p in self.pairs.tolist()], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair of symbols joins into; ``NEVER`` for others. A negative symbol joins with none."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.into[at], NEVER)

    def one_word(self, word: bytes) -> list[int]:
        """Ids of a word, joining the leftmost pair of least rank as long as there is one."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            least, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in a row, and where each word's ids end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size + 1) - 1  # a symbol that joins with none stands behind each word
        symbol = self.byte[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
        symbol[end] = -1
        n = len(symbol)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[-1] = n - 1
        rank = np.append(self.rank(symbol[:-1], symbol[1:]), NEVER)
        index: dict[int, list[np.ndarray]] = defaultdict(list)

        def enter(at: np.ndarray) -> None:
            """Positions into the index, by the rank of the pair that starts there."""
            at = at[np.argsort(rank[at], kind="stable")]
            found, first = np.unique(rank[at], return_index=True)
            for r, places in zip(found.tolist(), np.split(at, first[1:])):
                if r not in index:
                    heapq.heappush(todo, r)
                index[r].append(places)
        todo: list[int] = []
        enter(np.flatnonzero(rank != NEVER))
        late = []
        while todo:
            merge = heapq.heappop(todo)
            places = index.pop(merge)
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[rank[at] == merge]
            if len(at) > 1:
                chained = right[at[:-1]] == at[1:]
                if chained.any():  # of overlapping pairs every second one, from the left
                    nth = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.append(False, chained), 0, nth))
                    at = at[(nth - start) % 2 == 0]
            if not len(at):
                continue
            gone = right[at]
            after = right[gone]
            symbol[at], symbol[gone], rank[gone] = merge, -2, NEVER
            right[at], left[after] = after, at
            before = left[at]
            before = before[before >= 0]
            for touched in (before, at):
                rank[touched] = self.rank(symbol[touched], symbol[right[touched]])
            touched = np.concatenate((before, at))
            touched = touched[rank[touched] != NEVER]
            early = rank[touched] < merge
            if early.any():
                late.append(touched[early])
                rank[touched[early]] = NEVER
                touched = touched[~early]
            if len(touched):
                enter(touched)
        kept = symbol >= 0
        ids, ends = symbol[kept], np.cumsum(kept)[end]
        if late:
            again = np.unique(np.searchsorted(end, np.concatenate(late))).tolist()
            cut = np.split(ids, ends[:-1])
            for w in again:
                cut[w] = np.array(self.one_word(words[w]), np.int64)
            ids, ends = np.concatenate(cut), np.cumsum([len(c) for c in cut])
        return ids, ends


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def encode_block(texts: list[str | None], path: str, pattern: str) -> Iterator[np.ndarray]:
    """Ids of each text, all texts of the block merged together."""
    own, split = merges(path), splitter(pattern)
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    held = [np.fromiter(map(number.__getitem__, split(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    words = [w.encode() for w in number]
    number.clear()
    whole = np.array([own.ranks.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(whole < 0)
    ids, ends = own.replay([words[i] for i in rest.tolist()])
    size = np.ones(len(words), np.int64)
    size[rest] = np.diff(ends, prepend=0)
    first = np.cumsum(size) - size
    table = np.zeros(int(size.sum()), np.int64)
    table[first[whole >= 0]] = whole[whole >= 0]
    table[np.repeat(first[rest] - (ends - size[rest]), size[rest]) + np.arange(len(ids))] = ids
    for w in held:
        n = size[w]
        yield table[np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text, an array of integers."""
    pattern = pattern or split_pattern()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys, ids):
            ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(ends), flat)],
                                              names=["doc_id", "ids"])

        def block():
            out, n = [], 0
            for ids in encode_block(texts, path, pattern):
                out.append(ids)
                n += len(ids)
                if n >= FLUSH_IDS:
                    yield rows(keys[:len(out)], out)
                    del keys[:len(out)]
                    out, n = [], 0
            if out:
                yield rows(keys, out)
        keys, texts, chars, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                texts.append(t)
                chars += len(t or "")
                if chars >= BLOCK_CHARS:
                    yield from block()
                    keys, texts, chars = [], [], 0
        if texts:
            yield from block()
    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The bytes that an array of ids stands for; null has none. An id that the vocabulary lacks is an error."""
    @F.pandas_udf(T.BinaryType())
    def run(col: pd.Series) -> pd.Series:
        token = merges(path).token
        return pd.Series([b"".join(map(token.__getitem__, [] if i is None else i.tolist())) for i in col], dtype=object)
    return run(ids)
