"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element, and each ``<br>``, is a line.
The length of a line is
that of its text outside links. Lines in containers that hold no article by their
element or their class and id words (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments; never what stands around a main element or around
the article) have length 0. The line-block distribution is the sum of the weights
over ``WINDOW`` lines from each line on. It surges where a sum rises over 0 and dives where
it falls back; a stretch from a surge to its dive is kept if some sum in it reaches
``THRESHOLD``, or, where none does, as much as the best one.

The weight of a line is its length and what the page's own mark adds: lines in a
marked article gain ``THRESHOLD``, so that short paragraphs and headings
surge by themselves, and lines outside it lose all. The distribution decides
whether the mark is believed: if the marked lines hold less than one part in ``DOUBT``
of the text that would be kept without it (cards that tease other pages, say), it counts for nothing. A line of
link text alone has no weight, but it is kept where it is a paragraph in a kept stretch.

Cases: a null, empty or text-free page has the empty text; elements left open
end with the next that closes around them, a skipped container that is never
closed ends at the next block; a lone ``<`` is text; rows that repeat give the
same text; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import bisect
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 80
DOUBT = 5

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)"
                  r"|<title(?=[\s>])[^>]*(?<!/)>[^<]*(?:<(?!/?title\b)[^<]*)*</title\s*>|<[!?][^>]*>", re.S | re.I)
_EMBED = re.compile(r"<(/?)(noscript|template|select|svg|iframe|object|title|button)(?=[\s/>])" + _ATTRIBUTES + ">", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("nav footer aside form menu dialog fieldset".split())
TEASERS = SKIPPED - {"form", "fieldset"}
SKIPPED_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
    comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice outbrain pager pagination paywall popup promo promoted promotion related reply replies
    respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget""".split())
# Words that mark a block of text inside an article; the others may name its topic or style (<p class="notice">).
ADVERT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising consent cookie cookies gdpr newsletter outbrain
    paywall promo promoted share sharing signup sponsor sponsored subscribe taboola""".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl dt dd ol ul li table tbody tr td th".split())
# Words that go with one of ``SKIPPED_WORDS`` in the name of a container; any other tells a topic (share-price).
LAYOUT_WORDS = frozenset("""area articles bar block body bottom box button buttons col column container content feed form group holder icon icons
    inline inner item items label left link links list module outer panel placeholder post posts region right row section side site
    slot stories text thread title top unit wrap wrapper zone""".split())
MODIFIERS, WRAPPERS = frozenset("with without has no".split()), frozenset("wrap wrapper".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd td".split())
ARTICLE_ROLES = frozenset(("article", "main"))


def _without_raw(page: str) -> str:
    """``page`` without comments, scripts and embedded elements. One that is self-closed or never closed is empty."""
    page = _RAW.sub("", page)
    opened: dict[str, list[int]] = {}
    cuts = []
    for m in _EMBED.finditer(page):
        if not m[1]:
            cuts.append([m.start(), m.end()])
            if not m[0].endswith("/>"):
                opened.setdefault(m[2].lower(), []).append(len(cuts) - 1)
        elif opened.get(m[2].lower()):
            cuts[opened[m[2].lower()].pop()][1] = m.end()
    parts, at = [], 0
    for start, end in cuts:
        if end > at:
            parts.append(page[at:max(at, start)])
            at = end
    return "".join(parts) + page[at:]


def _words(attributes: str) -> set[str]:
    return {w.lower() for _, v in _NAMES.findall(attributes) for w in _PARTS.findall(v)}


def _marked_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role say that the element is no text of the article.

    Names that tell of the layout around (``with-sidebar``, ``content-sidebar-wrap``) don't; inside an article the id
    of a heading doesn't, that of a section if all its words do (``related-work`` is a topic), or in a div one of
    ``ADVERT_WORDS``, and a name with a word of its own beside (``share-price``) tells a topic too."""
    for kind, value in _NAMES.findall(attributes):
        for token in value.strip("\"'").split():
            parts = [w.lower() for w in _PARTS.findall(token)]
            found = SKIPPED_WORDS.intersection(parts)
            if not found or parts[0] in MODIFIERS or parts[-1] in WRAPPERS and parts[0] not in SKIPPED_WORDS:
                continue
            if inside and not all(w in SKIPPED_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in parts):
                continue
            if inside and name in TEXT_BLOCKS and (kind.lower() == "id" and name[0] == "h" or not found & ADVERT_WORDS):
                continue
            if inside and kind.lower() == "id" and name in ("section", "div") and not SKIPPED_WORDS.issuperset(parts) and (
                    name == "section" or not found & ADVERT_WORDS):
                continue
            return True
    return False


def _holding(tags: list[re.Match]) -> tuple[set[int], set[int]]:
    """Places in ``tags`` of the elements that hold a main element, and of those that hold an article that is no comment."""
    opened: dict[str, list[int]] = {}
    ends, mains, articles = {}, [], []
    for i, m in enumerate(tags):
        name = m[2].lower()
        if name not in BLOCKS or m[3].endswith("/"):
            continue
        if m[1]:
            if opened.get(name):
                ends[opened[name].pop()] = i
            continue
        opened.setdefault(name, []).append(i)
        words = _words(m[3]) if m[3] else set()
        if name == "main" or "main" in words and "role" in m[3]:
            mains.append(i)
        elif name == "article" and not words & {"comment", "reply"} or "article" in words and "role" in m[3]:
            articles.append(i)
    for left in opened.values():
        ends.update(dict.fromkeys(left, len(tags)))

    def around(places: list[int]) -> set[int]:
        return {i for i, end in ends.items() if (k := bisect.bisect_right(places, i)) < len(places) and places[k] < end}
    return around(mains), around(articles)


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, bool]], bool]:
    """``(text, length outside links, in an article, a paragraph)`` of each line, and whether the page marks an article."""
    page = _without_raw(page)
    tags = list(_TAG.finditer(page))
    with_main, with_article = _holding(tags)
    closes: dict[str, int] = {}
    for m in tags:
        if m[1]:
            closes[m[2].lower()] = m.start()  # of the last one
    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    plain, links, article, marked = 0, 0, 0, False
    block = ""  # element that the line stands in
    skip, depth, loose = "", 0, False  # element skipped, how deep in its like, whether it is never closed

    def end_line():
        nonlocal plain
        line = " ".join(html.unescape("".join(text)).split())
        # text in links alone counts only inside an article
        if line:
            lines.append((line, len(line) if plain or article else 0, article > 0, block in PARAGRAPHS))
        text.clear()
        plain = 0
    at = 0
    for place, m in enumerate(tags):
        name, closing = m[2].lower(), bool(m[1])
        if not skip and m.start() > at:
            part = page[at:m.start()]
            text.append(part)
            if not links and not part.isspace():
                plain += 1
        at = m.end()
        if skip:
            if name == skip and not m[3].endswith("/"):
                depth += -1 if closing else 1
            if depth == 0 or loose and name in BLOCKS and m.start() > start:
                skip = ""
                lines.append(("", 0, False, False))
            if skip or depth == 0:
                continue
        if name == "a":
            links = 0 if closing else 1
        if name not in BLOCKS:
            continue
        end_line()
        block = "" if closing else name if name != "br" else block
        if closing:
            if name in ARTICLE_ROLES and article:
                article -= 1
            continue
        words = _words(m[3]) if m[3] else set()
        page_header = name == "header" and not article
        # around the article is layout; what an article or a menu holds are comments and teasers
        layout = place in with_main or place in with_article and not article and name not in TEASERS
        if not layout and name not in ("html", "body", "article", "main", "br", "hr") and (
                name in SKIPPED or page_header or words & SKIPPED_WORDS and _marked_out(name, m[3], article > 0)) or name == "article" and words & {"comment", "reply"}:
            if not m[3].endswith("/"):
                skip, depth, start, loose = name, 1, m.start(), closes.get(name, -1) < m.start()
        elif name in ARTICLE_ROLES or "main" in words and "role" in m[3]:
            if name in ARTICLE_ROLES:
                article, marked = article + 1, True
    if not skip:
        text.append(page[at:])
        plain += not page[at:].isspace()
        end_line()
    return lines, marked


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """``(largest window sum, surge, dive)`` of each stretch of the distribution."""
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(weights))]
    found, at = [], 0
    while at < len(sums):
        dive = at  # of the stretch that surges at ``at``
        while dive < len(sums) and weights[at] and sums[dive]:
            dive += 1
        if dive > at:
            found.append((max(sums[at:dive]), at, dive))
        at = max(dive, at + 1)
    return found


def kept_lines(lines: list[tuple[str, int, bool, bool]], weights: list[int]) -> list[int]:
    """Lines of the stretches that are kept: those of any weight, and paragraphs of none between such lines."""
    found = stretches(weights)
    least = min(THRESHOLD, max((s for s, _, _ in found), default=0))
    return [i for s, at, dive in found if s >= least for i in range(at, dive)
            if weights[i] or lines[i][0] and lines[i][3] and any(weights[i:dive])]


def main_text(page: str | None) -> str:
    lines, marked = lines_of(page or "")
    lengths = [n for _, n, _, _ in lines]
    kept = None
    if marked:
        without_mark = kept_lines(lines, lengths)
        inside = sum(n for _, n, own, _ in lines if own)
        if inside * DOUBT >= sum(lengths[i] for i in without_mark):
            kept = kept_lines(lines, [n + THRESHOLD if n and own else 0 for _, n, own, _ in lines])
        elif inside:
            kept = without_mark
    return "\n".join(lines[i][0] for i in (kept_lines(lines, lengths) if kept is None else kept))


def extract(page: Column) -> Column:
    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)
    return udf(F.coalesce(page, F.lit("")))
