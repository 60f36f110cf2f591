"""Text cleaning, parsing and string helpers as Column -> Column functions.

Everything here is a built-in Spark expression, so it runs inside
whole-stage code generation and needs no Python worker.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# the letter class kept by cleaning, the token length bounds, the
# empty-value placeholder and the html-tag pattern.
LETTER_CLASS = "a-zA-Zа-яА-ЯёЁ"
MIN_TOKEN_LEN = 2
MAX_TOKEN_LEN = 30
STUB = "stub"
TAG_PATTERN = "(?d)<.*?>"          # non-greedy, does not cross '\n'
URL_PATTERN = 'http([^"]+)'

_STOP_DIR = Path(__file__).with_name("stopwords")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def stop_words(*langs: str) -> tuple[str, ...]:
    """Stop-word list(s) shipped with Spark ML (``russian``, ``english`` ...).

    Several languages give the union in first-seen order (TXT-21).
    """
    seen: dict[str, None] = {}
    for lang in langs:
        for w in (_STOP_DIR / f"{lang}.txt").read_text(encoding="utf-8").split("\n"):
            w = w.strip()
            if w:
                seen.setdefault(w, None)
    return tuple(seen)


# --- TXT-1 .. TXT-5: the cleaning pipeline -------------------------------

def keep_letters(c) -> Column:
    """TXT-1: every character outside the letter class becomes a space.

    A run of such characters becomes one space: the tokens are the same, and
    one replacement per run is much cheaper than one per character. A text without
    a byte that Cyrillic letters begin with takes the class of Latin letters alone,
    a fifth of the time of the wide one; such bytes stand nowhere else in UTF-8."""
    c = _col(c)
    data = c.cast("binary")
    cyrillic = F.contains(data, F.lit(b"\xd0")) | F.contains(data, F.lit(b"\xd1"))
    return F.regexp_replace(c, F.when(cyrillic, F.lit(f"[^{LETTER_CLASS}]+")).otherwise(F.lit("[^a-zA-Z]+")), F.lit(" "))


def _raw_words(c) -> Column:
    # split on runs of spaces; only letters and spaces remain after TXT-1
    return F.filter(F.split(F.trim(keep_letters(c)), " +"), lambda w: w != "")


def clean_tokens(c, stop_list: Iterable[str] = (), min_len: int = MIN_TOKEN_LEN,
                 max_len: int = MAX_TOKEN_LEN) -> Column:
    """TXT-5 as a token array: letters only -> stop words removed (case
    sensitive, before lower-casing) -> lower -> keep tokens of length
    ``min_len..max_len`` (longer tokens are dropped, not cut).

    Without a stop list this is one regex pass, a split and one array
    filter; the stop-list path also filters the word array by the list.
    """
    sw = list(stop_list)
    if sw:
        words = F.filter(_raw_words(c), lambda w: ~w.isin(*sw))  # a hash-set test
        words = F.transform(words, lambda w: F.lower(w))
        return F.filter(words, lambda w: (F.length(w) >= min_len) & (F.length(w) <= max_len))
    # letters only, lower-cased, split on space runs; the length filter
    # also drops the '' an empty text splits into
    words = F.split(F.trim(F.lower(keep_letters(c))), " +")
    return F.filter(words, lambda w: (F.length(w) >= min_len) & (F.length(w) <= max_len))


def clean_string(c, stop_list: Iterable[str] = (), min_len: int = MIN_TOKEN_LEN,
                 max_len: int = MAX_TOKEN_LEN) -> Column:
    """TXT-5: cleaned text, tokens joined by single spaces."""
    return F.array_join(clean_tokens(c, stop_list, min_len, max_len), " ")


def whitespace_tokens(c) -> Column:
    """TXT-8: the parts between runs of white space, none of them empty."""
    return F.filter(F.split(_col(c), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_count(c) -> Column:
    """TXT-16: ``len(s.split(' '))``; the empty string counts as 1."""
    return F.size(F.split(_col(c), " "))


# --- TXT-9 .. TXT-18: parsing helpers ------------------------------------

def strip_tags(c) -> Column:
    """TXT-9: delete ``<...>`` spans (non-greedy, within one line)."""
    return F.regexp_replace(_col(c), TAG_PATTERN, "")


def remove_strings(c, strings: Iterable[str]) -> Column:
    """TXT-10: delete each listed string in order, then nbsp -> space."""
    out = _col(c)
    for s in strings:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.replace(out, F.lit("\u00a0"), F.lit(" "))


def first_url(c) -> Column:
    """TXT-11: first ``http...`` up to a double quote, '' when absent."""
    return F.regexp_extract(_col(c), URL_PATTERN, 0)


def line_at(c, i: int) -> Column:
    """TXT-12: the i-th (0-based) line, null when the text is shorter."""
    return F.get(F.split(_col(c), "\n"), i)


def title_and_body(c) -> tuple[Column, Column]:
    """TXT-13: title = chars 1 .. first blank line (exclusive), body = from the
    blank line on; without a blank line Python's ``find`` gives -1, so the
    title is ``s[1:-1]`` and the body the last character."""
    c = _col(c)
    pos = F.locate("\n\n", c)          # 1-based, 0 when absent
    n = F.length(c)
    title = F.when(pos > 0, F.substring(c, F.lit(2), pos - 2)) \
        .otherwise(F.substring(c, F.lit(2), F.greatest(n - 2, F.lit(0))))
    body = F.when(pos > 0, F.substring(c, pos, n)).otherwise(F.substring(c, F.greatest(n, F.lit(1)), F.lit(1)))
    return title, body


def url_page(c) -> Column:
    """TXT-17: the part of a url before ``#``."""
    return F.substring_index(_col(c), "#", 1)


def section_url(url, heading) -> Column:
    """TXT-15: ``url#Heading_without_final_dot`` (spaces -> ``_``), or the url."""
    h = _col(heading)
    anchor = F.replace(F.substring(h, F.lit(1), F.length(h) - 1), F.lit(" "), F.lit("_"))
    return F.when(F.length(h) > 0, F.concat(_col(url), F.lit("#"), anchor)).otherwise(_col(url))


def section_title(title, heading) -> Column:
    """TXT-15: ``title. heading`` when there is a heading."""
    h = _col(heading)
    return F.when(F.length(h) > 0, F.concat(_col(title), F.lit(". "), h)).otherwise(_col(title))


def heading_text(c) -> Column:
    """TXT-14 item rule: drop a leading number word, strip, add '.'."""
    c = F.trim(_col(c))
    return F.concat(F.trim(F.element_at(F.split(c, r"\s+", 2), -1)), F.lit("."))


def toc_headings(html, container: str = "(?s)<nav[^>]*>(.*?)</nav>") -> Column:
    """TXT-14: ordered unique headings from the table-of-contents block.

    ``container`` is a regex whose group 1 is the TOC block (``div#toc`` on
    the reference's pages, ``nav`` on the test pages). No block -> null.
    """
    block = F.regexp_extract(_col(html), container, 1)
    items = F.regexp_extract_all(block, F.lit("(?s)<li[^>]*>.*?<a[^>]*>(.*?)</a>"), 1)
    hs = F.array_distinct(F.transform(F.filter(items, lambda x: F.trim(x) != ""), heading_text))
    return F.when(block == "", F.lit(None)).otherwise(hs)


def fill_stub(df, cols=None):
    """TXT-18: null strings -> 'stub'."""
    return df.fillna(STUB, subset=cols)


def request_path_query(path) -> Column:
    """SRC-10: question from a request path: 2nd '/'-part, '_' -> ' ',
    percent-decoded. '+' is protected so it stays a plus sign."""
    part = F.get(F.split(_col(path), "/"), 1)
    return F.url_decode(F.replace(F.replace(part, F.lit("_"), F.lit(" ")), F.lit("+"), F.lit("%2B")))


def request_body_query(body) -> Column:
    """SRC-11: request body bytes decoded as UTF-8."""
    return F.decode(_col(body), "UTF-8")
