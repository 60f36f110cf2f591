"""Exact token counts of every prefix of a text, by dynamic programming.

For each prefix of a word, the tokenizer's answer ends in one token, and what
stands before that token is the answer for a shorter prefix. A sequence of
vocabulary tokens is the tokenizer's answer if and only if each neighbouring
pair is, on its own, left unmerged across its border. So from left to right,
the last token of a prefix is the one that ends there and gets on with the last
token of the prefix before it, and its count is one more. In this vocabulary a
word's last token carries an end mark, so each prefix has two entries: ``open``
(more of the word follows) and ``closed`` (the text ends here).

The table of a text holds, for each character, by how much the count of the
prefix that ends with it differs from the one before, in one signed byte. The
token count is the sum; "how many tokens up to here", "does it fit" and "how
much of it fits" are answered from the table, without encoding again.

Words are computed once per worker and kept up to a bound. Characters are those
of the text in NFC, which is what the tokenizer reads.

Cases: a null or empty text has an empty table and no tokens; special tokens'
strings inside a text count as one token once complete, as the library's
default has it; rows that repeat are each counted; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .tokens import _WORDS, BYTE_SYMBOLS, LATIN_END, WHITE, _Known

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MOST_PIECES = 200_000
MOST_WORDS = MOST_PAIRS = 300_000
FLUSH_BYTES = 16 << 20
# Pieces that need the library's own tables, or whose characters aren't one to one with lower case.
_ODD = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]|[\u0130{WHITE}]")


class Vocabulary:
    """Merge ranks and tokens of a byte-pair vocabulary with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        end = self.end = model["end_of_word_suffix"]
        pairs = (p if isinstance(p, list) else p.split(" ") for p in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        # Tokens that the merges do form from their own symbols, with the last merge of each.
        self.halves: dict[str, tuple[str, str] | None] = {}
        for t in model["vocab"]:
            body = t.removesuffix(end)
            if body:
                last = self.last_merge([*body[:-1], body[-1] + end] if t != body else list(body))
                if last is not False:
                    self.halves[t] = last
        self.trie = self._trie()
        self.right_edges: dict[str, list] = {}
        self.left_edges: dict[str, list] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def last_merge(self, parts: list[str]) -> tuple[str, str] | None | bool:
        """Merge the symbols, lowest rank first: the last pair merged, None for a single
        symbol, False if more than one token stays."""
        last = None
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                return False
            last = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return last

    def edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """What stands at one border of a token while it is merged: parts with the ranks
        at which each comes and goes. A part's merges all rank below those it goes into,
        so rank is time."""
        known = self.right_edges if side else self.left_edges
        found = known.get(token)
        if found is None:
            found, gone, part = [], float("inf"), token
            while part is not None:
                halves = self.halves[part]
                come = self.rank[halves] if halves else -1
                found.append((part, come, gone))
                part, gone = halves[side] if halves else None, come
            known[token] = found
        return found

    def get_on(self, left: str, right: str) -> bool:
        """Whether the two tokens, in a row, stay as they are: no merge over their border
        ranks below the merges that take its two parts away. Of equal ranks the one
        further left is first."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            found, rank = True, self.rank.get
            for x, x_comes, x_goes in self.edge(left, 1):
                for y, y_comes, y_goes in self.edge(right, 0):
                    if x_comes < y_goes and y_comes < x_goes:
                        over = rank((x, y))
                        if over is not None and over < x_goes and over <= y_goes:
                            found = False
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _trie(self) -> dict:
        """Tokens by their characters: each leads to what may follow, the token that is open there and the one that is closed."""
        root: dict = {}
        for t in self.halves:
            body, below = t.removesuffix(self.end), root
            for c in body:
                node = below.setdefault(c, [{}, None, None])
                below = node[0]
            node[2 if t.endswith(self.end) else 1] = t
        return root

    def prefix_counts(self, word: str) -> list[int]:
        """Token count of each prefix of ``word`` (in byte symbols), the text ending there.

        From each place on, the trie gives the tokens that start there; the one that gets on with the
        last token before is the last token of the prefix it ends."""
        size = len(word)
        last, count, closed = [None] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        known, get_on, trie = self.pairs, self.get_on, self.trie
        for start in range(size):
            before, n, below, i = last[start], count[start] + 1, trie, start
            for c in word[start:]:
                node = below.get(c)
                if node is None:
                    break
                below, t, whole = node
                i += 1
                if t is not None and last[i] is None:
                    on = not start or known.get((before, t))
                    if on or on is None and get_on(before, t):
                        last[i], count[i] = t, n
                if whole is not None and not closed[i]:
                    on = not start or known.get((before, whole))
                    if on or on is None and get_on(before, whole):
                        closed[i] = n
        return closed[1:]


def _steps(counts: list[int]) -> bytes:
    return bytes((b - a) & 255 for a, b in zip([0, *counts], counts))


class PrefixCounter:
    def __init__(self, path: str):
        self.tokenizer = tokens.load(path)
        self.vocabulary = Vocabulary(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)))
        self.words = _Known(MOST_WORDS, self._word)
        self.pieces = _Known(MOST_PIECES, self._piece)

    def _word(self, word: str) -> bytes:
        """Steps of the characters of one word as the pre-tokenizer cuts it."""
        raw = word.encode()
        counts = self.vocabulary.prefix_counts(raw.decode("latin1").translate(BYTE_SYMBOLS))
        if len(raw) > len(word):
            counts = [counts[e - 1] for e in accumulate(len(c.encode()) for c in word)]
        if word in ("'re", "'ve", "'ll"):  # the prefix 'r, 'v or 'l is no suffix yet, but two words
            counts[1] = counts[0] + self.vocabulary.prefix_counts(word[1])[0]
        return _steps(counts)

    def _piece(self, piece: str) -> bytes:
        """Steps of the characters of a piece without white space."""
        if not _ODD.search(piece):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(piece.lower())))
        lower = [c.lower() for c in piece]
        text = "".join(lower)
        steps = np.zeros(len(text), np.int8)
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            steps[a:b] = np.frombuffer(self.words[text[a:b]], np.int8)
        ends = np.cumsum([len(c) for c in lower]) - 1
        counts = np.cumsum(steps, dtype=np.int64)[ends]
        if counts[-1] != len(self.tokenizer.encode(piece, add_special_tokens=False).ids):
            # characters that the library's tables class otherwise: ask it for each prefix
            counts = [len(self.tokenizer.encode(piece[:i], add_special_tokens=False).ids) for i in range(1, len(piece) + 1)]
        return _steps(list(counts))

    def _plain(self, text: str) -> bytes:
        return b"\0".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def table(self, text: str | None) -> bytes:
        """Steps of all characters of a text."""
        if not text:
            return b""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            steps = np.frombuffer(self._plain(text[at:m.end()]), np.int8).astype(np.int64)
            before = steps[:m.start() - at].sum()
            steps[-1] = before + 1 - steps[:-1].sum()
            out.append(steps.astype(np.int8).tobytes())
            at = m.end()
        return b"".join([*out, self._plain(text[at:]) if at < len(text) else b""])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def counts_of(table: bytes) -> np.ndarray:
    """Token count of every prefix, from none to all of the text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])


def _within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(table) <= budget)[-1])


def prefix_tables(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", budget: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, within, prefix_steps)``; ``n_tokens`` is the count of the longest prefix, ``within`` the
    characters of the longest prefix of at most ``budget`` tokens."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("within", T.LongType()),
                           T.StructField("prefix_steps", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)

        def out(batch, first, sizes, tables):
            totals = [int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in tables]
            fits = [_within(t, budget) for t in tables]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(tables)), pa.array(sizes, pa.int64()),
                                               pa.array(totals, pa.int64()), pa.array(fits, pa.int64()), pa.array(tables, pa.binary())],
                                              names=[f.name for f in schema])
        for batch in batches:
            first, sizes, tables, held = 0, [], [], 0
            for value in batch.column(1):
                t = value.as_py() or ""
                sizes.append(len(t.encode()))
                tables.append(own.table(t))
                held += len(tables[-1])
                if held >= FLUSH_BYTES:
                    yield out(batch, first, sizes, tables)
                    first, sizes, tables, held = first + len(tables), [], [], 0
            if tables:
                yield out(batch, first, sizes, tables)
    return docs.select(doc_id, text).mapInArrow(build, schema)


def tokens_up_to(steps: Column, chars: Column) -> Column:
    """Token count of the prefix of so many characters (of the whole text, if it has fewer)."""
    @F.pandas_udf("long")
    def udf(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(t, np.int8)[:max(0, k)].sum(dtype=np.int64)) for t, k in zip(s, n)], dtype="int64")
    return udf(steps, chars)


def chars_within(steps: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    @F.pandas_udf("long")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([_within(t, budget) for t in s], dtype="int64")
    return udf(steps)
