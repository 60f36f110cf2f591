"""Token ids of whole texts, with the ids of their pieces remembered.

The tokenizers used here treat the parts of a text between white space
independently, and in them the words that their pre-tokenizer finds. So the ids
of a text are those of its words in a row. Each worker numbers the pieces it
meets and keeps their ids, up to the bounds below (then it starts anew). New
pieces of Latin characters are cut into words and merged all together
(``word_merges``); for others the library is asked. A text that holds a special
token's string goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np

from .word_merges import WordMerges

MOST_PIECES = 130_000
MOST_CHARS = 8 << 20  # of the pieces kept
MOST_WORDS = 60_000  # of pieces that are more than a word
GROUP_CHARS = 1 << 20  # of texts that are looked up together
LONGEST = 64  # characters of a word that is kept
LEARN_PIECES = 1 << 16  # merged together, at most

# White space as the pre-tokenizers see it (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and digits below this code point are the same in every Unicode version
# in use, and no text of such characters changes under NFC.
LATIN_END = 0x250


def _latin(kind: str) -> str:
    return "".join(f"\\u{i:04x}" for i in range(LATIN_END) if unicodedata.category(chr(i))[0] == kind)


def _byte_symbols() -> dict[int, str]:
    """Character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


BYTE_SYMBOLS = _byte_symbols()
_L, _N = _latin("L"), _latin("N")
_OTHER = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
# The public pre-tokenizer patterns of the two vocabularies, for Latin characters.
_WORDS = re.compile(f"{_SUFFIX}|[{_L}]+|[{_N}]|[^{WHITE}{_L}{_N}]+")
_BYTE_WORDS = re.compile(f"{_SUFFIX}| ?[{_L}]+| ?[{_N}]+| ?[^{WHITE}{_L}{_N}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# Pieces with their blank; of a longer run of white space the last blank goes to the word.
_BYTE_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WIDE_WHITE = re.compile(f"[{WHITE.replace('\\t-\\r ', '')}]")
# Classes of characters; of the last kind are those whose words need the patterns or the library.
_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kinds() -> np.ndarray:
    """Class of every code point below ``LATIN_END``, and of all others at that place."""
    major = {"L": _LETTER, "N": _DIGIT}
    kinds = [major.get(unicodedata.category(chr(i))[0], _SIGN) for i in range(LATIN_END)]
    for i in (*range(9, 14), 32, 0x85, 0xa0):
        kinds[i] = _WHITE
    kinds[ord("'")] = _ODD
    return np.array([*kinds, _ODD], np.uint8)


_KIND = _kinds()
# Lower case, by code point; a character for which it isn't one Latin character again is odd.
_LOWER = np.array([ord(c) if len(c) == 1 and ord(c) < LATIN_END else LATIN_END for c in (chr(i).lower() for i in range(LATIN_END))]
                  + [LATIN_END], np.uint32)
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x01")


def vocabulary(name: str) -> str:
    """Path of one of the installed public tokenizer files."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _byte_pieces(text: str) -> list[str]:
    """``_BYTE_PIECES``; texts of single blanks and line ends need no regular expression."""
    if any(map(text.__contains__, _UNEVEN)) or not text.isascii() and _WIDE_WHITE.search(text):
        return _BYTE_PIECES.findall(text)
    return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")


class _Known(dict):
    """What was found lately for parts that are found one at a time, in two generations of ``most`` entries:
    what is still in use when the younger one fills up lives on."""

    def __init__(self, most: int, find):
        self.most, self.find, self.old = most, find, {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.find(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)  # its entries move, they are not copied
                self.clear()
            self[part] = found
        return found


class Pieces:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    Every piece met gets a number; the ids of all numbered pieces stand in one array,
    so the ids of a text are gathered from it by the numbers of its pieces."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # One vocabulary drops white space and case, the other keeps both.
        self.drops_white = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.model = self.tokenizer.model
        self.merges = WordMerges(path, BYTE_SYMBOLS)
        self.words: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.first, self.size, self.uses, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint32))
        self.chars = 0

    def _trim(self) -> None:
        """Forget the pieces met once, or all if those are few."""
        often = np.flatnonzero((self.uses > 1) & (self.size <= LONGEST))
        if len(often) > MOST_PIECES // 2:
            return self._forget()
        names, size = list(self.number), self.size[often]
        at = np.repeat(self.first[often] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        flat = self.flat[at]
        self._forget()
        for i in often.tolist():
            self.chars += len(names[i])
            self.number[names[i]]
        self.first, self.size, self.uses, self.flat = np.cumsum(size) - size, size, np.zeros(len(often), np.int64), flat

    def of(self, text: str) -> bytes:
        """Straight from the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> list[int]:
        """Ids of one word as the pre-tokenizer cuts it, from the library's model alone."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin1").translate(BYTE_SYMBOLS))]

    def _find(self, piece: str) -> list[int]:
        """Ids of a piece. One of letters alone, with or without its blank, is a word."""
        low = piece.lower() if self.drops_white else piece
        if not low.isascii() and (_OTHER.search(piece) or _OTHER.search(low)):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        letters = low[1:] if low[:1] == " " else low
        if letters.isalpha():
            if letters.isascii():  # the symbols of ASCII letters are these letters
                return [t.id for t in self.model.tokenize(low if letters is low else BYTE_SYMBOLS[32] + letters)]
            if not _OTHER.search(letters):
                return self._word(low)
        out = []
        for word in (_WORDS if self.drops_white else _BYTE_WORDS).findall(low):
            found = self.words.get(word)
            if found is None:
                at = self.number.get(word, len(self.size))
                if at < len(self.size):  # the word is a piece met before
                    first = self.first[at]
                    found = self.flat[first:first + self.size[at]].tolist()
                else:
                    found = self._word(word)
                if len(word) <= LONGEST:
                    self.words[word] = found
            out += found
        return out

    def parts(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ") if self.drops_white else _byte_pieces(text)

    def all_ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts, in order; a null text has none."""
        group, size = [], 0
        for text in texts:
            whole = bool(text) and any(s in text for s in self.specials)
            group.append(self.of(text) if whole else self._numbers(text) if text else b"")
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _numbers(self, text: str) -> np.ndarray:
        parts = self.parts(text)
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def _merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and how many each has, -1 for those that are not merged here:
        the long ones and those with a character of ``_ODD`` or with white space but for a blank before a word."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        points = np.minimum(points, LATIN_END)
        if self.drops_white:
            points = _LOWER[points]
        kind = _KIND[points]
        full = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[full]
        if not self.drops_white:
            blank = starts[(points[starts] == 32) & (size[full] > 1)]
            kind[blank] = kind[blank + 1]  # it goes to the word
        odd = np.add.reduceat((kind == _WHITE) | (kind == _ODD), starts, dtype=np.int64) if len(full) else starts
        plain = np.zeros(len(new), bool)
        plain[full] = (odd == 0) & (size[full] <= LONGEST)
        cut = np.ones(len(points), bool)
        cut[1:] = kind[1:] != kind[:-1]
        if self.drops_white:
            cut |= kind == _DIGIT  # a word each
        cut[starts] = True
        cut = np.flatnonzero(cut & np.repeat(plain, size))
        mine = points[np.repeat(plain, size)]
        piece = np.repeat(np.arange(len(new)), size)[cut]
        # what is not plain is left out: places among the plain characters, then in their bytes
        place = np.cumsum(np.repeat(plain, size)) - 1
        wide = np.cumsum(mine >= 0x80) - (mine >= 0x80)
        first = place[cut]
        first += wide[first]
        flat = np.frombuffer(mine.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids, count = self.merges.ids(flat, first, np.diff(first, append=len(flat)))
        return ids, np.where(plain, np.bincount(piece, count, len(new)).astype(np.int64), -1)

    def _learn(self) -> None:
        """Ids of the pieces that were numbered last."""
        while new := list(islice(self.number, len(self.size), len(self.size) + LEARN_PIECES)):
            ids, size = self._merged(new)
            left = np.flatnonzero(size < 0).tolist()
            found = [self._find(new[i]) for i in left]
            own = np.fromiter(map(len, found), np.int64, len(found))
            # the ids of the others stand behind those of the merged ones
            first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            first[left], size[left] = len(ids) + np.cumsum(own) - own, own
            self.first = np.append(self.first, len(self.flat) + first)
            self.size = np.append(self.size, size)
            self.uses = np.append(self.uses, np.zeros_like(size))
            self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(found), np.uint32, int(own.sum()))])
            self.chars += sum(map(len, new))
            if len(self.words) > MOST_WORDS:
                self.words.clear()

    def _flush(self, group: list) -> list[bytes]:
        self._learn()
        numbered = [g for g in group if not isinstance(g, bytes)]
        if numbered:
            numbers = np.concatenate(numbered)
            self.uses += np.bincount(numbers, minlength=len(self.uses))
            n = self.size[numbers]
            ends = np.cumsum(n)
            at = np.repeat(self.first[numbers] - (ends - n), n) + np.arange(ends[-1])
            ids = self.flat[at].astype("<u4", copy=False).tobytes()
            cuts = iter((ends[np.cumsum([len(g) for g in numbered]) - 1] * 4).tolist())
        out, at = [], 0
        for found in group:
            if not isinstance(found, bytes):
                to = next(cuts)
                found, at = ids[at:to], to
            out.append(found)
        if len(self.number) > MOST_PIECES or self.chars > MOST_CHARS:
            self._trim()
        return out

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids([text]))


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
