"""Token ids of many words at once, by the merges of a byte-level vocabulary.

The library joins, as long as it can, the pair of least rank in a word, of equal
ones the leftmost. Here all words with the same number of symbols stand in one
table, a row for each. A step takes the least pair of every row and joins it,
so the rows that go on are one symbol shorter and meet the words that had that
length from the start; rows without a pair that joins are done. There are as many
steps as the longest word has bytes, whatever the number of words.

The rank of a pair is looked up in a hash table in arrays (open addressing), and only
for the two neighbours of what was joined; the pairs of single bytes stand in a table of their own.
"""

from __future__ import annotations

import json

import numpy as np

NEVER = np.int32(2**31 - 1)  # rank of a pair that no merge joins
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class WordMerges:
    def __init__(self, path: str, symbols: dict[int, str]):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = (np.array([vocab[symbols[b] + e] for b in range(256)], np.int32) for e in ("", end))
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self._fill((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        every = np.repeat(self.inner, 256)
        self.first = np.concatenate([self.rank(every, np.tile(ends, 256)) for ends in (self.inner, self.last)])

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, _EMPTY), np.full(1 << bits, NEVER)
        rest = np.arange(len(keys))
        at = self._at(keys)
        while len(rest):
            free = self.keys[at] == _EMPTY
            self.ranks[at[free]] = rest[free]
            self.keys[at[free]] = keys[rest[free]]
            won = (self.keys[at] == keys[rest])
            # of several that took one place the last stands
            self.ranks[at[won]] = rest[won]
            rest, at = rest[~won], (at[~won] + 1) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._at(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], NEVER)
        rest = np.flatnonzero((met != keys) & (met != _EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            met = self.keys[at[rest]]
            found = met == keys[rest]
            out[rest[found]] = self.ranks[at[rest[found]]]
            rest = rest[~found & (met != _EMPTY)]
        return out

    def ids(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``size`` bytes, one at least, from ``first`` on in ``flat``: all ids in a row, and how many each word has."""
        order = np.argsort(size, kind="stable")
        longest = int(size.max(initial=0))
        bounds = np.searchsorted(size[order], np.arange(longest + 2))
        symbol, rank, who, done = np.zeros((0, longest), np.int32), np.zeros((0, max(0, longest - 1)), np.int32), order[:0], []
        for length in range(longest, 0, -1):
            new = order[bounds[length]:bounds[length + 1]]
            if len(new):
                b = flat[first[new][:, None] + np.arange(length)].astype(np.int32)
                own = self.inner[b]
                own[:, -1] = self.last[b[:, -1]]
                pair = b[:, :-1] * 256 + b[:, 1:]
                pair[:, -1:] += 1 << 16
                symbol, rank, who = np.concatenate([symbol, own]), np.concatenate([rank, self.first[pair]]), np.concatenate([who, new])
            if length == 1:
                done.append((who, symbol))
                break
            best = rank.argmin(1)
            low = rank[np.arange(len(who)), best]
            stop = low == NEVER
            if stop.any():
                done.append((who[stop], symbol[stop]))
                go = ~stop
                symbol, rank, who, best, low = symbol[go], rank[go], who[go], best[go], low[go]
            rows = np.arange(len(who))
            symbol[rows, best] = self.joined[low]
            keep = np.ones(symbol.shape, bool)
            keep[rows, best + 1] = False
            symbol = symbol[keep].reshape(len(who), length - 1)
            keep = np.ones(rank.shape, bool)
            keep[rows, best] = False
            rank = rank[keep].reshape(len(who), length - 2)
            before = np.flatnonzero(best > 0)
            at = best[before]
            rank[before, at - 1] = self.rank(symbol[before, at - 1], symbol[before, at])
            after = np.flatnonzero(best < length - 2)
            at = best[after]
            rank[after, at] = self.rank(symbol[after, at], symbol[after, at + 1])
        count = np.zeros(len(size), np.int64)
        for words, ids in done:
            count[words] = ids.shape[1]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for words, ids in done:
            out[start[words][:, None] + np.arange(ids.shape[1])] = ids
        return out, count
