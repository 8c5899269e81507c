r"""Main text of web pages from flat text blocks and a decision tree.

The markup is read once, left to right, without building a document tree: text collects in a block until
a block-level tag, and blocks carry what surrounds them. A block is described by its number of words and
link density, those of the blocks before and after it, the kind of place it stands in, and how much of the page's
prose stands in articles; a decision tree says whether it belongs to the article. The tree is grown from LAYOUTS,
a small table of pages with labelled blocks. Places are one input among others: prose outside of a marked
article is found by words and densities, and so are pages without any mark, or with misleading ones.

Scripts, styles, comments, form controls and the like hold no text. White space inside a block becomes
one space; character references are decoded; blocks without text are none. br is white space in a block.

Defined results: a null or empty page, or one without article blocks, gives an empty text. Unclosed and
stray tags do not matter: an unclosed head ends where something stands that it cannot hold, other silent elements
end at the next block-level tag, and only RAW ones run to the end of the page; a tag that never ends is dropped with what follows it in it. Pages of any
length and depth are read whole, in one pass. Repeated rows get equal texts; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Elements without text of their own.
SILENT = ("script", "style", "noscript", "template", "head", "title", "select", "option", "button", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video")
#: Those that hold characters only, up to their own end tag.
RAW = ("script", "style", "textarea", "title")
#: Those that do not hold their own kind: a second start tag ends the first.
SINGLE = ("select", "option", "button", "noscript")
#: What a head holds.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements whose tags end an unclosed silent element.
BLOCK_LEVEL = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose tags do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand for a place outside of the article, or for the article.
OUTSIDE = frozenset("nav header footer aside form menu dialog address".split())
INSIDE = frozenset(("article", "main"))
#: Names in class, id and role that do so; a name counts as a whole, or by its first or last part.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related recommended recommendations trending popular "
    "tag tags pagination pager copyright legal disclaimer skip complementary contentinfo".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
#: Names that stand for comments or for what an article is about: a name made of these, and of words for readers and lists, leaves it to the blocks.
AMBIGUOUS_NAMES = frozenset("reply discussion discussions response responses review reviews feedback".split())
READER_NAMES = frozenset("user users customer customers reader readers visitor guest list section area thread item items container wrapper wrap box block body content post".split())
INSIDE_NAMES = frozenset("article articlebody content main post entry story".split())
#: Parts that make a name tell how something looks or works, not what it is.
MODIFIERS = frozenset("by enabled disabled with without has no is open closed hidden visible on off layout theme page".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"\S+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Kinds of places: nothing is known; the tag of an article; the tag of something else; reader comments; a name of something else; a name of an
#: article; a name of comments or of an article's subject.
NEUTRAL, ARTICLE, ELSEWHERE, COMMENTS, NAMED_ELSEWHERE, NAMED_ARTICLE, AMBIGUOUS = range(7)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int


def _kind(name: str) -> int:
    """What a name in class, id or role says."""
    parts = [x for x in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", name).lower()) if x]
    if not parts or not MODIFIERS.isdisjoint(parts):
        return NEUTRAL
    if not COMMENT_NAMES.isdisjoint(parts):
        return COMMENTS
    if not AMBIGUOUS_NAMES.isdisjoint(parts) and AMBIGUOUS_NAMES.union(READER_NAMES).issuperset(parts):
        return AMBIGUOUS
    if parts[0] in OUTSIDE_NAMES or parts[-1] in OUTSIDE_NAMES:
        return NAMED_ELSEWHERE
    return NAMED_ARTICLE if parts[0] in INSIDE_NAMES or parts[-1] in INSIDE_NAMES else NEUTRAL


def _place(tag: str, attributes: str) -> int:
    """The kind of place that an element is by itself."""
    if tag in OUTSIDE:
        return ELSEWHERE
    kinds = set()
    if tag not in ("body", "html") and attributes:
        for m in _NAMES.finditer(attributes):
            kinds.update(map(_kind, (m[1] or m[2] or m[3] or "").split()))
    if COMMENTS in kinds:
        return COMMENTS
    if tag in INSIDE:
        return ARTICLE
    # Where names contradict each other, nothing is known.
    return NEUTRAL if kinds >= {NAMED_ARTICLE, NAMED_ELSEWHERE} else max(kinds, default=NEUTRAL)


def _within(outer: int, own: int, tag: str) -> int:
    """The kind of place inside of an element: inner marks decide, but only the tags of articles lead back from elsewhere,
    and nothing from comments, or from what may be comments. The header of an article is part of it."""
    if COMMENTS in (outer, own):
        return COMMENTS
    if outer == AMBIGUOUS:
        return own if own in (ELSEWHERE, NAMED_ELSEWHERE) else outer
    if own == AMBIGUOUS:
        return outer if outer in (ELSEWHERE, NAMED_ELSEWHERE) else own
    if own == NEUTRAL or (tag == "header" and outer in (ARTICLE, NAMED_ARTICLE)):
        return outer
    if own == NAMED_ARTICLE and outer != NEUTRAL:
        return outer
    return ELSEWHERE if own == NAMED_ELSEWHERE and outer == ELSEWHERE else own


class _Ends:
    """Next matches in a page that is read forwards: a pattern is looked for no more than once from any place on."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, pattern: str, at: int) -> re.Match | None:
        known = self.found.get(pattern, False)
        if known is False or (known is not None and known.start() < at):
            known = self.found[pattern] = re.compile(pattern, re.I).search(self.page, at)
        return known


def _end_tag(ends: _Ends, tag: str, at: int) -> re.Match | None:
    return ends.next(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", at)


def _end_of_unclosed(ends: _Ends, tag: str, at: int) -> int:
    """Where a silent element without an end tag ends, that begins before at."""
    page = ends.page
    if tag in RAW:
        return len(page)
    while m := _MARKUP.search(page, at):
        if tag == "head" and page[at : m.start()].strip():
            return at
        name = (m[2] or "").lower()
        if tag == "head":
            if name and not m[1] and name not in IN_HEAD:
                return m.start()
        elif name in BLOCK_LEVEL or (name == tag and tag in SINGLE) or (tag == "option" and name in ("optgroup", "select", "datalist")):
            return m.start()
        at = max(m.end(), m.start() + 1)
        if not m[1] and (name in RAW or (tag == "head" and name in ("noscript", "template"))):
            end = _end_tag(ends, name, at)
            at = end.end() if end else _end_of_unclosed(ends, name, at)
    return at if tag == "head" and page[at:].strip() else len(page)


def _silent_end(ends: _Ends, tag: str, at: int) -> int:
    """Where a silent element ends, whose start tag ends at that place."""
    end = _end_tag(ends, tag, at)
    if tag == "head":
        body = ends.next(r"<body(?=[\s/>])", at)
        found = [x for x in (end and end.end(), body and body.start()) if x is not None]
        return min(found) if found else _end_of_unclosed(ends, tag, at)
    if end is None:
        return _end_of_unclosed(ends, tag, at)
    again = ends.next(rf"<{tag}(?=[\s/>])", at) if tag in SINGLE else None
    if tag == "option" or (again is not None and again.start() < end.start()):
        return min(_end_of_unclosed(ends, tag, at), end.end())
    return end.end()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, int]] = []  # tag, and the place inside of it
    held: Counter[str] = Counter()  # how many of each tag are open
    ends, links = _Ends(page), 0

    def pop() -> str:
        tag = open_.pop()[0]
        held[tag] -= 1
        return tag

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(_WORD.findall(t)) for t, link in parts if link)
                out.append(Block(text, len(_WORD.findall(text)), linked, open_[-1][1] if open_ else NEUTRAL))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            parts.append((html.unescape(page[at:]), links > 0))
            break
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), links > 0))
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            if held[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in SILENT:
            flush() if tag not in ("svg", "math") else None
            if not m[3].rstrip().endswith("/"):
                at = _silent_end(ends, tag, at)
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag not in INLINE:
            flush()
        if tag == "a":
            links = 1
        elif tag not in VOID and tag not in INLINE:
            if tag in ("p", "li") and open_ and open_[-1][0] == tag:
                pop()
            outer = open_[-1][1] if open_ else NEUTRAL
            open_.append((tag, _within(outer, _place(tag, m[3]), tag)))
            held[tag] += 1
    flush()
    return out


#: Pages as their blocks, in order: words, per cent of them in links, kind of place (n nothing is known, a tag of an article, e tag of something
#: else, c comments, w a name of something else, i a name of an article, r a name of comments or of a subject), + for the article.
LAYOUTS = (
    # An article element between a menu and a footer; an advert or a notice is named, or not.
    "1:100e 1:100e 2:100e 7:0w 9:0a+ 1:0a+ 60:0a+ 4:0a+ 120:3a+ 2:0a+ 1:100a+ 30:0a+ 9:0e",
    "1:100e 1:100e 1:100e 25:0n 6:0a+ 45:0a+ 3:0a+ 14:50a+ 80:0a+ 12:0e 1:100e",
    "2:100n 1:100n 3:100n 11:0a+ 250:0a+ 90:0a+ 22:0n 8:0n",
    "30:0w 5:0n 8:0a+ 2:0a+ 6:100a+ 75:0a+ 40:0a+ 18:0c 35:0c 70:0c 9:0c 2:100c",
    "12:0n 40:0w 10:0a+ 33:0a+ 150:0a+ 60:0w 80:0w 25:0w 2:100e 2:100e",
    "10:0a+ 3:0a+ 1:0a+ 5:20a+ 4:0a+ 2:0a+ 24:0e 6:0e",
    "66:0a+ 22:0a+ 92:0w 22:0n", "8:0i+ 100:0i+ 150:0w 90:0w 60:0i+ 3:0n", "200:0w 120:0w 5:0a+ 70:0a+ 30:0a+ 110:0n 90:0n 20:0n",
    "14:0e 40:0e 9:0a+ 20:0a+ 35:0e 60:0e 90:0a+ 22:0c 130:0c 45:0c 8:0n 150:0e",
    # Long and short blocks of an article in any order, also where little else of the page is prose.
    "1:100e 5:0w 9:0a+ 100:0a+ 20:0a+ 10:0a+ 200:0a+ 5:0a+ 3:0a+ 150:0a+ 30:0a+ 12:0a+ 90:0a+ 25:0a+ 8:0a+ 120:0a+ 9:0e", "7:0i+ 110:0i+ 15:0i+ 4:0i+ 130:0i+ 28:0i+ 9:0i+ 95:0i+ 2:0i+ 6:0e",
    "90:0n+ 12:0n+ 6:0n+ 140:0n+ 30:0n+ 18:0n+ 100:0n+ 3:0n+ 11:0n+ 88:0n+ 25:0n+ 2:100n 1:100n", "4:0e 160:0a+ 1:0a+ 2:0a+ 180:0a+ 7:0a+ 19:40a+ 99:0a+ 4:50a+ 21:0a+ 6:0c",
    # Pages that end with the article, or are nothing else.
    "8:0a+ 60:0a+ 1:0a+", "5:0i+ 40:0i+ 2:0i+", "12:0a+", "22:0i+", "2:100e 22:0a+ 35:0a+", "1:100n 1:0a+ 1:0a+ 1:0a+", "30:0a+ 12:100a+", "4:0i+ 2:0i+ 3:0i+ 1:0i+",
    # A page without marks but a few menus: prose among prose, headings before prose; link lists and what lies between them go.
    "1:100n 1:100n 2:100n 8:0n+ 60:0n+ 45:2n+ 110:0n+ 20:0n+ 1:100n 2:100n 3:100n",
    "3:100n 4:100n 3:0n 4:100n 2:100n 6:0n+ 35:0n+ 3:0n+ 80:0n+ 22:10n+ 5:0n+ 50:0n+ 4:100n 5:80n",
    "2:0n 1:100n 2:100n 1:100n 200:0n+ 90:0n+ 40:0n+ 9:90n 3:100n 2:0n 3:100n",
    "22:0n+ 22:0n+ 1:100n", "1:100n 1:100n 22:0n+ 22:0n+ 1:100n", "120:0n+", "15:0n+ 30:5n+ 18:0n+",
    "4:50n 22:0n+ 30:0n+ 2:100n", "9:100n 30:90n 15:80n 12:60n 70:0n+ 2:0n+ 66:0n+ 3:0n 2:100n 5:0n 1:100n",
    "20:0n 1:100n 1:100n 3:100n 10:0n+ 75:0n+ 30:0n+ 60:20n+ 14:0n+ 40:0n+ 1:100n 6:0n 2:100n",
    # The same with adverts, notices, forms and comments that are named or tagged: short or long, between or before prose.
    "1:100n 2:100n 7:0w 8:0n+ 60:0n+ 5:0w 45:0n+ 11:0w 70:0n+ 9:0c 30:0c 2:100n", "9:0e 2:0n+ 22:0n+ 18:0n+ 4:0w 40:0n+ 20:0e 15:0n+ 36:0n+ 6:0e",
    "6:0w 3:0w 1:0n+ 15:0n+ 24:0n+ 3:0n+ 16:0n+ 28:0n+ 8:0c 22:0c 10:0c 44:0c", "13:0w 90:0n+ 8:0w 120:0n+ 3:0e 50:0n+ 2:0e 100:0n+ 35:0w",
    "1:0e 40:0n+ 2:0e 3:0e 5:0n+ 25:0n+ 30:0w 30:0n+ 55:0w 12:0n+ 60:0n+", "4:0c 80:0n+ 6:0c 2:0c 40:0c 90:0c 1:0c", "10:0n+ 19:0n+ 2:0n+ 12:0n+ 7:0n+ 14:0n+ 25:0n+ 3:100n 2:100n",
    "6:0w 22:0n+ 22:0n+ 22:0n+ 8:0w 22:0n+ 22:0e", "2:100e 4:0n+ 22:0n+ 1:0n+ 9:0n+ 33:0n+ 4:0w 31:0w 3:0n+ 27:0n+",
    # A teaser is marked, the story is not; or names mislead around prose.
    "1:100e 1:100e 1:0a+ 9:0n+ 60:0n+ 45:0n+ 90:0n+ 5:0n+ 70:0n+ 9:0e",
    "2:100e 6:0a+ 2:100a+ 100:0n+ 85:0n+ 64:5n+ 2:100n 1:100n",
    "1:100n 2:100n 90:0w+ 110:0w+ 95:0w+ 120:0w+ 1:100n", "3:100e 85:0w+ 140:0w+ 200:0w+ 12:0e",
    # Named articles: their prose stays, their lists of links go.
    "4:0w 22:0w 7:0i+ 50:0i+ 2:0i+ 22:0i+ 3:0w 30:0i+ 22:0c 15:0c 4:0e",
    "1:100i 2:100i 1:100i 9:0i+ 60:0i+ 45:10i+ 1:0i+ 80:0i+ 2:100i 3:100i 2:100i 9:0e",
    "22:0w 22:0w 22:0i+ 2:0i+ 1:0w 22:0c", "8:0i+ 22:0i+ 12:0i+ 1:100w 2:100w 14:0w",
    # Related stories within an article: a heading before links, and links beside links, go; a link on its own stays.
    "1:100e 7:0a+ 60:0a+ 80:0a+ 2:0a 5:100a 6:100a 7:100a 9:0e", "9:0a+ 120:0a+ 45:0a+ 3:0a 8:100a 6:100a 5:100a 7:100a 33:0a+ 70:0a+ 12:0e", "6:0i+ 90:0i+ 2:0i 4:100i 9:100i 6:100i",
    "8:0a+ 40:0a+ 6:100a 8:100a 25:0a+ 30:0a+", "11:0a+ 75:0a+ 22:0a+ 2:0a 4:100a 3:100a 6:100a 4:100a", "5:0a+ 33:0a+ 2:100a+ 48:0a+ 3:100a+ 61:0a+ 2:0a 9:100a 7:100a 8:100a", "70:0a+ 3:0a 7:100a 6:100a 50:0a+ 12:100a+ 44:0a+",
    "40:0a+ 2:0a 6:100a 5:100a 8:100a 60:0a+", "30:0a+ 3:0a 4:100a 7:100a 45:0a+ 50:0a+", "66:0a+ 2:0a 3:100a 9:100a 35:0a+ 80:0a+", "90:0a+ 2:0a 3:100a 4:100a 6:100a", "28:0a+ 1:0a 4:100a 5:100a 31:0a+", "12:0a+ 55:0a+ 2:0a 5:100a 4:100a 9:0e",
    "60:0a+ 40:0a+ 5:100a+", "8:0a+ 22:0a+ 3:100a+ 9:0a+ 30:0a+", "50:0a+ 2:100a+ 4:0a+ 70:0a+", "35:0a+ 6:100a+ 12:0a+", "44:0a+ 9:100a+", "20:0a+ 1:100a+ 8:0a+ 64:0a+", "31:0a+ 4:100a+",
    "40:0a+ 2:0a 18:100a 22:100a 16:100a 30:0a+", "6:0a+ 70:0a+ 3:0a 21:100a 17:100a 25:100a", "55:0a+ 2:0a 16:100a 19:100a 48:0a+ 90:0a+ 70:0a+", "110:0a+ 95:0a+ 80:0a+ 2:0a 3:100a 4:100a 6:100a", "150:0a+ 130:0a+ 3:0a 15:100a 24:100a 20:100a",
    "4:0a+ 2:100a+ 60:0a+", "3:0a+ 6:100a+ 80:0a+ 9:0a+ 5:100a+ 45:0a+", "7:0a+ 3:100a+ 12:0a+ 40:0a+", "5:0a+ 8:100a+ 20:0a+", "9:0a+ 4:100a+ 6:0a+ 2:100a+ 90:0a+", "8:0a+ 12:100a+ 18:0a+ 50:0a+", "10:0a+ 40:100a+ 9:0a+ 30:0a+",
    "8:0n+ 70:0n+ 55:0n+ 2:0n 6:100n 7:100n 5:100n", "9:0i+ 55:0i+ 3:0i 5:100i 6:100i 40:0i+",
    # An article under a name that may mean comments: there is hardly any prose elsewhere; and comments beside an article.
    "1:100e 8:0r+ 100:0r+ 60:0r+ 9:0e", "1:100n 2:100n 7:0r+ 45:0r+ 150:0r+ 30:0r+ 1:100n", "30:0w 6:0r+ 80:0r+ 120:0r+ 9:0e", "25:0e 1:100e 12:0r+ 40:0r+ 3:0r+ 70:0r+", "3:100n 12:0n 5:0r+ 90:0r+ 20:0r+ 66:0r+ 8:0e",
    "2:100e 10:0r+ 25:0r+ 33:0r+ 2:0r+ 140:0r+ 40:0c 22:0c", "100:0r+", "1:100n 35:0r+ 28:0r+",
    "8:0a+ 90:0a+ 60:0a+ 2:0r 40:0r 22:0r 120:0r 9:0e", "7:0n+ 80:0n+ 45:0n+ 30:0r 15:0r 60:0r", "6:0i+ 50:0i+ 40:0i+ 9:0r 150:0r 80:0r", "5:0a+ 30:0a+ 25:0a+ 20:0r 33:0r", "9:0a+ 200:0a+ 3:0r 12:0r 5:0r 28:0r 100:0r 6:0e",
    "1:100n 9:0n+ 40:0n+ 55:0n+ 18:0r 70:0r 2:100r 25:0r",
    # A menu of one link right before prose, and prose right before one.
    "1:100e 90:0a+ 30:0a+", "1:100e 200:0w+ 110:0w+ 90:0w+ 20:0e", "2:100e 120:0n+ 60:0n+ 1:100e", "1:100e 60:0n+ 50:0n+ 2:100e", "3:100e 85:0r+ 60:0r+ 1:100e", "2:100n 130:0n+ 70:0n+", "1:100e 45:0i+ 80:0i+ 2:100w 75:0i+",
    # Nothing but menus, forms, notices and comments.
    "1:100n 2:100n 1:100n 3:100n", "3:0w 25:20w 5:0e 4:0e", "12:0e 30:0e 1:100e 2:100e 8:0e", "15:0c 40:0c 12:0c 60:0c", "2:0n 1:100n 2:100n 4:0n 3:100n 1:100n",
)
_KINDS = "naecwir"


class Tree(NamedTuple):
    column: int  # -1 in a leaf
    most: float
    low: "Tree | None"
    high: "Tree | None"
    label: int


#: Rows of the smallest leaf.
LEAF = 3


def grow(x: np.ndarray, y: np.ndarray) -> Tree:
    """A tree by Gini impurity, grown until its leaves are pure or too small to cut."""
    label = int(2 * y.sum() >= len(y))
    best = (1e-9, -1, 0.0)
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    whole = gini(y)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= cut
            if min(low.sum(), (~low).sum()) < LEAF:
                continue
            gain = whole - gini(y[low]) - gini(y[~low])
            if gain > best[0] + 1e-9:
                best = (gain, c, float(cut))
    if best[1] < 0:
        return Tree(-1, 0.0, None, None, label)
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[low], y[low]), grow(x[~low], y[~low]), label)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the blocks of LAYOUTS."""
    x, y = [], []
    for page in LAYOUTS:
        found = []
        for words, links, kind, label in re.findall(r"(\d+):(\d+)(\w)(\+?)", page):
            found.append(Block("", int(words), round(int(words) * int(links) / 100), _KINDS.index(kind)))
            y.append(float(label == "+"))
        x.append(features(found))
    return np.vstack(x), np.array(y)


@lru_cache(maxsize=1)
def tree() -> Tree:
    return grow(*labelled())


#: Columns of features.
COLUMNS = ("words", "density", "words before", "density before", "words after", "density after", *(f"place {k}" for k in _KINDS), "share of articles", "prose")
#: Words of prose on a page beyond which their number tells nothing more.
MOST_PROSE = 400
#: Link density up to which a block is prose.
PROSE = 0.5


def features(found: list[Block]) -> np.ndarray:
    """A row of COLUMNS for each block of a page."""
    words, linked, place = (np.array([b[k] for b in found], float) for k in (1, 2, 3))
    density = linked / np.maximum(1, words)
    near = [np.r_[0.0, v[:-1]] if side < 0 else np.r_[v[1:], 0.0] for side in (-1, 1) for v in (words, density)]
    prose = np.where(density <= PROSE, words, 0)
    known = prose[np.isin(place, (NEUTRAL, ARTICLE, NAMED_ARTICLE))].sum()  # outside of what names or tags set apart
    share = prose[np.isin(place, (ARTICLE, NAMED_ARTICLE))].sum() / max(1.0, known)
    whole = [np.full(len(found), v) for v in (share, min(known, MOST_PROSE))]
    return np.column_stack([words, density, *near, place[:, None] == np.arange(len(_KINDS)), *whole])


def article(found: list[Block], model: Tree) -> list[Block]:
    """The blocks that the tree takes for the article."""
    kept = []
    for b, x in zip(found, features(found).tolist() if found else [], strict=True):
        t = model
        while t.column >= 0:
            t = t.low if x[t.column] <= t.most else t.high
        if t.label:
            kept.append(b)
    return kept


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in article(blocks(page or ""), tree()))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def scan(batches):
        for b in W.slices(batches, "html", 8 << 20):
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
