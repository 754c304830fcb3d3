"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams start, end and data events. Block-level
tags cut the page into lines; each line has its text, its number of tags and
how much of it is link text. The text-to-tag ratios, in page order, are
smoothed with a Gaussian kernel and cut at their standard deviation: runs of
lines above it are content regions. The element that holds most of that text
(an article or main element if one holds half of it) is the content region's
container, and its lines are the result, so short paragraphs between long ones
stay. Without such an element it is the stretch from the first to the last
region, with the lines beside it up to one that is mostly links; there, lines
that are mostly links and lie outside every region go.

What is never content: scripts, styles, forms and controls, navigation, asides,
footers, hidden parts, and elements whose class, id or role says advert, menu,
sidebar, notice, share bar, comments and the like; page headers too, but not
the container's own (one with a heading that is not mostly links). Inside an
article a class must be such a name as a whole. Anchors of headings are ids too,
so an id on or in a heading, or on an inline element of an article, says
nothing; on other elements of an article, and on sections, it must be such a
name as a whole, or most of the element's text must be links.

One page is parsed at a time; no shuffle. Defined results: a null or empty
html gives an empty text. Broken markup is read as far as it goes: an end tag
without a start is ignored, what is open at the end counts as closed (a comment
or tag too), declarations of any kind are skipped, and end tags that HTML lets a page omit (of p, li, dt, dd, td, th, tr and table parts)
are put where the next start tag implies them.
Repeated rows get equal texts; other columns pass through; ``text`` and
``n_chars`` of the input are replaced; empty tables give empty results.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: tags that begin a new line
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
#: tags whose content is never text of the article
DROP = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object script select style "
    "svg template textarea title video".split())
#: elements that may be the container of the content
HOLD = frozenset("body article main section div table tbody tr td center details blockquote".split())
#: words of class, id and role that mark what is not content
MARKS = frozenset(
    "ad adbox ads adsbygoogle adsense adslot adv advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies crumbs dialog disclaimer discussion disqus footer gdpr login menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion "
    "promoted rail recommend recommended recommendations related reply replies respond responses search share sharing "
    "sidebar sidecol sidecolumn sidenav signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: marks that count outside an article only
PAGE_MARKS = frozenset("header masthead topbar topnav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: marks that are also ordinary headings, so that alone they are no sure id
PLAIN = frozenset(
    "ad advertisement advertising alert announcement banner breadcrumb comment consent cookie cookies dialog disclaimer "
    "discussion footer login menu modal navigation notice notices notification overlay pagination popup promotion rail "
    "recommend recommended recommendations related reply replies respond responses search share sharing social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split())
#: words that make an id of plain marks a sure one
FILL = frozenset("slot box container wrapper wrap bar unit area list panel buttons form cookie cookies consent".split())
#: elements that a mark never removes
SAFE = frozenset("html body article main".split())

#: start tags that imply the end of an open element: which ones, and the
#: elements beyond which nothing is looked for (of items: other blocks)
P_ENDS = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_P = (frozenset(["p"]), frozenset("button caption object table td template th".split()))
_ITEMS = (BLOCK | DROP) - frozenset("address div p".split())
_ROWS = frozenset(["tr"])
_PARTS = frozenset("tbody tfoot thead".split())
_TABLE = frozenset("table template".split())
IMPLIED = {
    "li": (frozenset(["li"]), _ITEMS), "dt": (frozenset("dd dt".split()), _ITEMS), "dd": (frozenset("dd dt".split()), _ITEMS),
    "td": (frozenset("td th".split()), _TABLE | _ROWS), "th": (frozenset("td th".split()), _TABLE | _ROWS),
    "tr": (_ROWS, _TABLE), "tbody": (_PARTS | _ROWS, _TABLE), "thead": (_PARTS | _ROWS, _TABLE), "tfoot": (_PARTS | _ROWS, _TABLE)}
#: inline elements with state, and what their end tags may close besides
INLINE = frozenset("span a label".split())
LOOSE = INLINE | frozenset("p li option".split())

#: tags at which the search for an open element ends, by what is sought
_ITEM_TAGS = frozenset("li dt dd".split())
STOPS = {"p": _P[1], "item": _ITEMS - _ITEM_TAGS, "inline": None}      # of end tags; None: all but LOOSE
STOPS |= {tag: stop - ends for tag, (ends, stop) in IMPLIED.items()}

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LONG_REFERENCE = re.compile(r"&#(?=0*[1-9]\d{7})\d+;?")     # beyond all characters


@dataclass(frozen=True)
class _Open:
    """An open element: its number if it may hold content, the number of the
    innermost such element up to it, and where each kind of stop was last."""
    tag: str
    number: int
    holder: int
    dropped: bool
    doubt: int                  # its first line if its links have to tell, else -1
    stops: dict


class _Lines(HTMLParser):
    """Collects the lines of one page. Every tag costs the same however deep
    the elements nest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = defaultdict(list)    # where each tag is open
        self.parent: list[int] = [-1]                   # of each element that may hold content; 0 is the page
        self.name: list[str] = [""]
        self.heads: dict[int, list[bool]] = {}          # page headers by number: whether they hold a heading
        self.lines: list[tuple[str, int, int, int]] = []     # text, tags, link characters, element
        self.sums: list[tuple[int, int]] = [(0, 0)]     # characters and link characters before each line
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.dropped = 0
        self.article = 0

    # what the page does not close is closed by its end
    def parse_comment(self, i, report=1):
        j = super().parse_comment(i, report)
        return j if j >= 0 else len(self.rawdata)

    def parse_marked_section(self, i, report=1):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        j = super().parse_html_declaration(i)
        return j if j >= 0 else len(self.rawdata)

    def parse_pi(self, i):
        j = super().parse_pi(i)
        return j if j >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        j = super().parse_starttag(i)
        return j if j >= 0 else len(self.rawdata)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, max(self.tags, 1), self.linked, self._element()))
            self.sums.append((self.sums[-1][0] + len(text), self.sums[-1][1] + self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def _element(self) -> int:
        return self.open[-1].holder if self.open else 0

    def _close(self, i: int) -> None:
        """Closes the elements from the i-th open one on."""
        before = self.dropped
        for k in range(len(self.open) - 1, i - 1, -1):
            e = self.open[k]
            if e.doubt >= 0:
                if not self.dropped:
                    self._flush()
                (a, b), (c, d) = self.sums[e.doubt], self.sums[-1]
                if 2 * (d - b) > c - a:
                    del self.lines[e.doubt:]
                    del self.sums[e.doubt + 1:]
            self.dropped -= e.dropped
            self.article -= e.tag in ("article", "main")
            self.at[e.tag].pop()
        del self.open[i:]
        if before and not self.dropped:
            self.parts, self.tags, self.linked = [], 0, 0

    def _stop(self, kind: str) -> int:
        return self.open[-1].stops[kind] if self.open else -1

    def _imply(self, ends: frozenset, kind: str) -> None:
        """Closes the innermost open element of ``ends`` that no stop hides; of
        several that nest (a row in a table part), the outermost."""
        stop = self._stop(kind)
        if len(ends) < 3:
            at = max((self.at[t][-1] for t in ends if self.at[t]), default=-1)
        else:
            first = [self.at[t][k] for t in ends if (k := bisect_right(self.at[t], stop)) < len(self.at[t])]
            at = min(first, default=-1)
        if at > stop:
            self._close(at)

    def _named(self, tag: str, name: str) -> bool | None:
        """Whether an id marks the element; None if its links have to tell."""
        words = {w.lower() for w in _WORD.findall(name)}
        found = words & (MARKS if self.article else MARKS | PAGE_MARKS)
        if not found or tag in HEADINGS or any(self.at[h] for h in HEADINGS):
            return False
        if not self.article and tag != "section":
            return True
        if tag not in BLOCK:
            return False
        if all(w in MARKS or w in FILL or w.isdigit() for w in words) and (words & FILL or found - PLAIN):
            return True if len(words) > 1 or found - PLAIN else None
        return None

    def _classed(self, tag: str, names: str) -> bool | None:
        """Whether classes or roles mark the element. Inside an article a
        class must be a mark as a whole, and a section's one that is no
        ordinary heading."""
        doubt = False
        for name in names.split():
            words = {w.lower() for w in _WORD.findall(name)}
            found = words & (MARKS if self.article else MARKS | PAGE_MARKS)
            if not found:
                continue
            if not self.article:
                return True
            if all(w in MARKS or w in FILL or w.isdigit() for w in words):
                if tag != "section" or found - PLAIN or words & FILL:
                    return True
                doubt = True
        return None if doubt else False

    def _marked(self, tag: str, attrs: list) -> bool | None:
        """Whether an element is dropped; None if its links have to tell."""
        if tag in DROP:
            return True
        if tag == "header" or tag in SAFE:
            return False
        doubt = False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and _HIDDEN.search(v or ""):
                return True
            if v and k in ("id", "class", "role"):
                marked = self._named(tag, v) if k == "id" else self._classed(tag, v)
                if marked:
                    return True
                doubt = doubt or marked is None
        return None if doubt else False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and not self.dropped:
            self._flush()
        if tag in IMPLIED:
            self._imply(IMPLIED[tag][0], tag)
        if tag in P_ENDS:
            self._imply(_P[0], "p")
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        marked = self._marked(tag, attrs)
        dropped = bool(marked)
        if not (dropped or tag in BLOCK and tag != "option" or tag in INLINE):
            return                              # inline or self-closing by custom: no state to keep
        holder, number = self._element(), 0
        page_header = tag == "header" and not self.article
        if (tag in HOLD or page_header) and not dropped and not self.dropped:
            self.parent.append(holder)
            self.name.append(tag)
            holder = number = len(self.name) - 1
            if page_header:
                self.heads[number] = [False]
        if tag in HEADINGS and holder in self.heads:
            self.heads[holder][0] = True
        if dropped:
            if not self.dropped:
                self._flush()
            self.dropped += 1
        here = len(self.open)
        stops = {k: here if (tag not in LOOSE if s is None else tag in s) else self._stop(k) for k, s in STOPS.items()}
        self.open.append(_Open(tag, number, holder, dropped, len(self.lines) if marked is None and not self.dropped else -1, stops))
        self.at[tag].append(here)
        self.article += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK and not self.dropped:
            self._flush()
        if tag == "a" and self.links:
            self.links -= 1
        if not self.at[tag]:
            return
        # an inline end tag closes no block, an item's no outer item
        kind = "p" if tag == "p" else "item" if tag in _ITEM_TAGS else "inline" if tag in INLINE else None
        if kind is None or self.at[tag][-1] >= self._stop(kind):
            self._close(self.at[tag][-1])

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, int]]:
        self.close()
        if not self.dropped:
            self._flush()
        self._close(0)
        return self.lines


def smooth(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the ends are weighted by the part inside."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x ** 2) / (2 * sigma ** 2))
    inside = np.convolve(np.ones(len(ratios)), kernel, "full")[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel, "full")[radius:radius + len(ratios)] / inside


def regions(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Mask of the lines in content regions."""
    ratio = np.array([(len(t) - linked) / tags for t, tags, linked, _ in lines], float)
    soft = smooth(np.maximum(ratio, 0))
    return soft >= min(soft.std(), soft.max())


def _container(page: _Lines, mass: list[int]) -> int:
    """The element that holds most of the regions' text; 0 is the page."""
    total = mass[0]
    whole = [i for i, n in enumerate(page.name) if n in ("article", "main") and 2 * mass[i] >= total > 0]
    if whole:
        return whole[-1] if page.name[whole[-1]] == "article" else whole[0]
    inner = {}                                  # of each element, the first in it that holds nine tenths of all
    for i in range(len(page.name) - 1, 0, -1):
        if 10 * mass[i] >= 9 * total > 0:
            inner[page.parent[i]] = i
    at = 0
    while at in inner:
        at = inner[at]
    return at


def _below(page: _Lines, tops: set[int]) -> list[bool]:
    """Of each element, whether it is one of ``tops`` or inside one."""
    out = [False] * len(page.name)
    for i in range(len(out)):                   # children come after their parents
        out[i] = i in tops or i > 0 and out[page.parent[i]]
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    page = _Lines()
    if html:
        page.feed(_LONG_REFERENCE.sub("\ufffd", html))
    page.finish()
    # page headers take no part until the container is known
    header = _below(page, set(page.heads))
    lines = [x for x in page.lines if not header[x[3]]]
    if not lines:
        return ""
    good = regions(lines)
    mass = [0] * len(page.name)
    for (text, _, linked, element), ok in zip(lines, good):
        if ok:
            mass[element] += len(text) - linked
    for i in range(len(mass) - 1, 0, -1):
        mass[page.parent[i]] += mass[i]
    top = _container(page, mass)
    within = _below(page, {top})
    if len(lines) < len(page.lines) and page.name[top] not in ("", "body"):
        own = {i for i, (heading,) in page.heads.items() if heading and within[i] and not _mostly_links(page, i)}
        if own:                                 # the container's own header
            kept = _below(page, own)
            marks = iter(good)
            rows = [(x, kept[x[3]] or bool(next(marks))) for x in page.lines if kept[x[3]] or not header[x[3]]]
            lines, good = [x for x, _ in rows], np.array([ok for _, ok in rows])
    inside = [within[x[3]] for x in lines]
    if page.name[top] in ("article", "main"):
        return "\n".join(x[0] for x, ok in zip(lines, inside) if ok)
    at = np.flatnonzero(good & np.array(inside))
    first, last = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, len(lines))
    plain = lambda i: inside[i] and 2 * lines[i][2] <= len(lines[i][0])
    while first and plain(first - 1):           # short lines beside a region are its headings and short paragraphs
        first -= 1
    while last < len(lines) and plain(last):
        last += 1
    return "\n".join(lines[i][0] for i in range(first, last) if inside[i] and (good[i] or plain(i)))


def _mostly_links(page: _Lines, header: int) -> bool:
    mine = _below(page, {header})
    rows = [x for x in page.lines if mine[x[3]]]
    return 2 * sum(x[2] for x in rows) > sum(len(x[0]) for x in rows)


def main_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text`` (the main text) and ``n_chars`` (its code points)."""
    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in pages], pa.string())

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("text", "n_chars")]
    got = df.select(*rest, text(F.col(f"`{html_col}`").cast("string")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("bigint"))
