"""HTML extraction by line-block distribution.

Markup is stripped first: scripts, styles and other unseen text go and block elements become lines. Each line has a weight: the
length of its text outside links, nothing for lines of menus, footers, adverts, comments and the like (by their elements' names or by a
class that says nothing else), half for lines of a class that may be part of an article too. Weights are summed over a sliding
window; where a sum rises above the threshold the text surges, where it falls to nothing it dives. The main text lies
between the first surge and the last dive, and reaches to the ends of the element that holds it, so short paragraphs at its ends
stay. Within it, lines that weigh nothing for what they are go, and doubtful ones unless they are as long as a surge. Marks of an
article only bound and extend what the windows found, and only where most of it is marked.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_COMMENT = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag. Possessive: one pass, whether it matches or not.
_QUOTED_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_REST = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose text is never shown as text of the page.
RAW = frozenset("script style noscript template textarea title svg iframe object select option button canvas math audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr center".split())
#: Elements that are no part of an article.
OUTSIDE = frozenset("nav aside footer form dialog menu head".split())
#: Words of classes, ids and roles of elements that are no part of an article.
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside comment comments disqus replies share sharing related recommended newsletter subscribe subscription signup pagination pager widget widgets contentinfo complementary disclaimer".split())
#: The same, but an article may have them too: they count by half.
DOUBTFUL_WORDS = frozenset("banner alert respond responses reply social login search toolbar form skip".split())
#: The same as OUTSIDE_WORDS, but only for elements that hold others, not for single paragraphs and headings.
HOLDER_WORDS = frozenset("header topbar top bottom".split())
#: Words that may stand beside them in one name (`comment-list`); beside any other word (`share-price`) they say nothing.
PLACES = frozenset("site page global main top bottom left right center upper lower inner outer primary secondary mobile desktop fixed sticky box bar block wrapper wrap container content area section list item items link links button buttons icon icons group row column panel slot unit holder module text title heading form user reader".split())
#: The same, but not beside HOLDER_WORDS: an article's header is part of it.
ARTICLES = frozenset("article articles post posts entry story stories blog news".split())
_BESIDE, _BESIDE_HOLDER = OUTSIDE_WORDS | DOUBTFUL_WORDS | PLACES | ARTICLES, HOLDER_WORDS | PLACES
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr".split())
KEEP = frozenset("html body article main".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div section article ul ol dl table footer header nav aside form blockquote pre li tr td th dt dd main".split())
#: Elements that may stay unclosed, and what ends them.
ENDS = {"p": _BLOCKS, **{f"h{k}": _BLOCKS for k in range(1, 7)}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    outside: int  # how its elements are marked: 0 not, 1 doubtful, 2 as no part of an article
    holders: tuple | None  # the innermost article or main around it: its number, and the same of the one around that
    parent: int  # number of the innermost element that holds lines


def _tags(page: str) -> Generator[tuple[str, str, str, str, int], int | None, None]:
    """(text before it, "/" or nothing, name, attributes, end) of each tag, the last one without a name, in one pass. A place
    that is sent is where it goes on.

    A quoted value may hold `>`. Where a tag's quotes never end, quotes mean nothing from there on; a `<` with no `>`
    after it is text.
    """
    at = begin = 0
    last, rest = page.rfind(">"), _QUOTED_REST
    parts: list[str] = []
    while 0 <= (at := page.find("<", at)) < last:
        parts.append(page[begin:at])
        begin = at
        if m := _COMMENT.match(page, at):
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            at = begin = m.end()
        elif page.startswith(("<!", "<?"), at):
            at = begin = page.index(">", at) + 1
        elif m := _NAME.match(page, at):
            tail = rest.match(page, m.end())
            if not tail and rest is _QUOTED_REST:
                rest = _PLAIN_REST
                tail = rest.match(page, m.end())
            if not tail:
                break
            before = "".join(parts)
            parts.clear()
            jump = yield before, m[1], m[2].lower(), tail[1], tail.end()
            if jump is not None:
                yield "", "", "", "", jump  # what send gives back
            at = begin = tail.end() if jump is None else jump
        else:
            at += 1
    parts.append(page[begin:])
    yield "".join(parts), "", "", "", len(page)


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order: one for each run of text between block elements."""
    out: list[Line] = []
    parts: list[str] = []
    linked, in_link, number = 0, 0, 0
    stack: list[tuple[str, int, tuple | None, int]] = [("", 0, None, 0)]  # name, outside, holders, number
    opened: Counter[str] = Counter()  # how many of each name are on the stack
    last = page.rfind(">") + 1

    def end_line() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts)).replace("\x00", "")).strip()
        if text:
            _, outside, holders, parent = stack[-1]
            out.append(Line(text, min(linked, len(text)), outside, holders, parent))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack[-1][0] in INLINE:
            return
        parts.append(text)
        if in_link:
            linked += len(text)

    def push(name: str, outside: int, holders: tuple | None, parent: int) -> None:
        stack.append((name, outside, holders, parent))
        opened[name] += 1

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    tags = _tags(page)
    for text, closing, name, attributes, at in tags:
        if text:
            add(text)
        if not name:
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(page, at, last)
                tags.send(end.end() if end else len(page))
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in INLINE:
            if not closing and attributes and _outside(name, attributes) == 2:
                push(name, 2, stack[-1][2], stack[-1][3])  # its text is dropped, the block goes on
            elif closing and stack[-1][0] == name:
                pop()
            continue
        end_line()
        in_link = 0
        if name == "hr":
            continue
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while stack[-1][0] in INLINE or name in ENDS.get(stack[-1][0], ()):
            pop()  # elements that end where the next one begins
        number += 1
        _, outside, holders, parent = stack[-1]
        outside = max(outside, 2 if name in OUTSIDE or name == "header" and not holders else 0 if name in KEEP else _outside(name, attributes))
        if name in ("article", "main"):
            holders = (number, holders)
        push(name, outside, holders, parent if name in SINGLE else number)
    end_line()
    return out


@lru_cache(maxsize=1 << 14)
def _told(name: str, holder: bool) -> int:
    """What one class, id or role says of its element: 2 no part of an article, 1 in doubt, 0 nothing."""
    words = set(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
    if words & OUTSIDE_WORDS and words <= _BESIDE or holder and words & HOLDER_WORDS and words <= _BESIDE_HOLDER:
        return 2
    return int(bool(words & DOUBTFUL_WORDS) and words <= DOUBTFUL_WORDS | PLACES)


def _outside(name: str, attributes: str) -> int:
    """2 for an element that is no part of an article by its class, id or role or is hidden, 1 where that is in doubt, else 0."""
    found, holder = 0, name not in SINGLE and name not in INLINE
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            for one in value.split():
                found = max(found, _told(one, holder))
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
            found = 2
    return 2 if found == 2 or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=x", attributes)) else found


def weight(line: Line) -> int:
    """What a line counts in the windows."""
    if line.outside == 2 or 2 * line.linked > len(line.text):
        return 0
    return (len(line.text) - line.linked) // (1 + line.outside)


def surge_and_dive(lengths: list[int], window: int = 3, surge: int = 60) -> tuple[int, int] | None:
    """The first and end line of the text: from the first window whose sum surges to where the last one dives."""
    if not lengths:
        return None
    sums = np.convolve(np.asarray(lengths), np.ones(window, int))[window - 1 :]  # of the line and those after it
    high = np.flatnonzero(sums >= surge)
    if not len(high):
        return None
    first, last = int(high[0]), int(high[-1])
    while not lengths[first]:
        first += 1  # a window surges before its line does
    while last + 1 < len(lengths) and lengths[last + 1]:
        last += 1
    while not lengths[last]:
        last -= 1
    return first, last + 1


def _dives(lengths: list[int], window: int) -> list[bool]:
    """Which lines are in a window whose sum is nothing."""
    out, run = [False] * len(lengths), 0
    for k, n in enumerate(lengths):
        run = 0 if n else run + 1
        if run >= window:
            out[k - window + 1 : k + 1] = [True] * window
    return out


def _marked(own: list[Line], lengths: list[int], first: int, end: int, window: int) -> list[Line]:
    """The marked lines of the region and, up to the next dive, those to the ends of the elements that hold its text."""
    touched: set[int] = set()
    for x, n in zip(own[first:end], lengths[first:end]):
        around = x.holders if n else None
        while around and around[0] not in touched:
            touched.add(around[0])
            around = around[1]
    inside = [k for k, x in enumerate(own) if x.holders and (first <= k < end or x.holders[0] in touched)]
    dives = _dives([lengths[k] for k in inside], window)
    found = [i for i, k in enumerate(inside) if first <= k < end]
    begin, stop = found[0], found[-1] + 1
    while begin and not dives[begin - 1]:
        begin -= 1
    while stop < len(inside) and not dives[stop]:
        stop += 1
    return [own[k] for k in inside[begin:stop]]


def main_text(page: str, window: int = 3, surge: int = 60) -> str:
    lines = lines_of(page)
    weights = [weight(x) for x in lines]
    found = surge_and_dive(weights, window, surge)
    kept = [k for k, x in enumerate(lines) if x.outside == 0 or x.outside == 1 and weights[k] * 2 >= surge]
    own, lengths = [lines[k] for k in kept], [weights[k] for k in kept]
    if found:  # places among the lines that may stay
        first, end = int(np.searchsorted(kept, found[0])), int(np.searchsorted(kept, found[1]))
        found = (first, end) if first < end else None
    if not found:
        if any(n and x.holders for x, n in zip(own, lengths)):
            return "\n".join(x.text for x, dive in zip(own, _dives(lengths, window)) if x.holders and not dive)
        return "\n".join(x.text for x, n in zip(own, lengths) if n)
    first, end = found
    if 2 * sum(n for x, n in zip(own[first:end], lengths[first:end]) if x.holders) >= sum(lengths[first:end]):
        return "\n".join(x.text for x in _marked(own, lengths, first, end, window))
    parents = {own[first].parent, own[end - 1].parent}  # short lines at the ends, in the same elements
    while first and lengths[first - 1] and own[first - 1].parent in parents:
        first -= 1
    while end < len(own) and lengths[end] and own[end].parent in parents:
        end += 1
    return "\n".join(x.text for x in own[first:end])


def _extract(window: int, surge: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(t, window, surge) for t in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return extract


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 60) -> DataFrame:
    """One row for each row of pages: page_id, url, text.

    text has the main text's blocks in page order, joined by one line end; character references are decoded, white
    space inside a block is one space, and a block is trimmed. The windows find the region on every page. Where at least
    half of its text is marked (article or main), unmarked lines go and the region reaches to those elements' ends or
    the next dive. A page whose windows never surge gives its marked lines, or all that are no links if none is
    marked. A null page, or one without text, gives an empty text. Null and repeated ids and urls pass through; an empty table gives no rows; other columns are ignored. Rows never meet: no shuffle.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return own.mapInArrow(_extract(window, surge), "page_id long, url string, text string")
