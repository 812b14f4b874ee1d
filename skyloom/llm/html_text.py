"""Main text of web pages by line-block distribution: text lengths over sliding line windows, from surge to dive."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Lines in a window, and the characters that a window must hold for a surge.
WINDOW, SURGE = 3, 86
#: So many lines that are half links or more, one after another, or so many links in one such line, are a menu if their links are
#: labels of so many characters on average, or if there are LONG_MENU of them; longer links in a shorter list name sources.
MENU_LINES, LABEL, LONG_MENU = 3, 24, 8
#: Longest copyright notice.
NOTICE = 200

# Element names of HTML, and words by which pages name the parts that are not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre q summary td th".split())  # blocks that hold text itself
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
WHOLE = RAW | frozenset("audio button canvas noscript object select svg template video".split())  # left out with all they hold, inside a line
OUTSIDE = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer form head iframe legend map menu meter nav noembed noframes noscript object optgroup option output progress script select style svg template textarea title video".split()
)
ROOTS = frozenset(["article", "main"])
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_WORDS = frozenset(
    """ad ads adsbygoogle adslot adunit advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation
    newsletter notice notices pager pagination popup promo promoted promotion recommendations recommended related replies
    respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split()
)
ADVERT_WORDS = frozenset("ad ads adsbygoogle adslot adunit advert advertisement advertising adverts promo promoted promotion sponsor sponsored".split())
LAYOUT_WORDS = frozenset("banner header masthead menu modal nav navbar navigation notice notices popup sidebar social toolbar topbar widget widgets".split())  # themes also give these to wrappers of the article
NEUTRAL_WORDS = frozenset(
    """area article articles bar blog block body bottom box btn button buttons col column container count desktop entry fixed form
    global group holder icon icons id inner item items js label link links list main message mobile news outer page panel plugin post
    posts primary reader readers row secondary section site slot sticky stories story thread threads top unit user users wp wrap
    wrapper x zone""".split()
)
CONTENT_HEADERS = frozenset("article blog body entry item news page post section story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How far out of the article an element is: by a layout name, by another name, by its element, role or style.
LAYOUT, NAMED, FIXED = 1, 2, 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
_NOTICE = re.compile(r"©|(?:\(c\)|copyright\b)(?:\W*(?:©|\(c\)|by\b|\d{4}\b\W*(?:(?-i:[A-Z0-9])|by\b|all\b|$))|.*(?:©|rights reserved)|.{0,60}\b\d{4}\W*$)|all rights reserved", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


@dataclass
class _Line:
    text: str
    linked: int  # characters inside links
    links: int
    place: int  # the element that holds the block
    rooted: int  # the outermost article or main that holds it
    outside: int
    doubt: int  # the outermost element with a doubtful name
    inset: bool  # outside for an element that stands within articles, as adverts do


@dataclass
class _Element:
    name: str
    place: int
    outside: int
    rooted: int
    linked: bool
    doubt: int
    holder: int  # the element that holds blocks here
    block: int  # height in the stack of the innermost element that is not inline
    inset: bool


class _Closings:
    """Where the closing tags of a name stand; each name is looked for once in a page."""

    def __init__(self, page: str):
        self.page, self.of = page, {}

    def after(self, name: str, at: int) -> int | None:
        if name not in self.of:
            self.of[name] = [m.start() for m in re.finditer(rf"</{name}[\s/>]", self.page, re.I)]
        k = bisect_left(self.of[name], at)
        return self.of[name][k] if k < len(self.of[name]) else None


def is_inline(name: str) -> bool:
    """Elements that nobody knows are inline, as browsers have it."""
    return name in INLINE or not (name in BLOCK or name in VOID or name in OUTSIDE)


def _names_outside(name: str, attributes: str, rooted: int) -> tuple[int, bool, bool]:
    """How far role, style, class or id put an element out of the article, whether a name leaves that in doubt, and whether it is an inset.

    A name counts if all its parts are known; with other parts beside known ones, as in elementor-widget, it is
    doubtful, and so it is for a paragraph or another block of text inside an article.
    """
    found = {m[1].lower(): m[2].strip("\"'") for m in _ATTRIBUTE.finditer(attributes) if m[1]}
    if found.get("role", "").lower() in OUTSIDE_ROLES or re.search(r"display\s*:\s*none", found.get("style",
        "")) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I):
        return FIXED, False, False
    if name in ROOTS or name in INLINE:
        return 0, False, False
    level, doubt, inset = 0, False, True
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {w.lower() for w in _WORDS.findall(one)}
        words = parts & OUTSIDE_WORDS
        if "header" in parts and not rooted and name not in HEADINGS and not parts & CONTENT_HEADERS:
            words |= {"header"}
        if words and parts - words <= NEUTRAL_WORDS and not (rooted and name in PROSE):
            level = max(level, LAYOUT if words <= LAYOUT_WORDS else NAMED)
            inset = inset and words <= ADVERT_WORDS
        elif words and not parts & {"has", "no", "non", "with", "without"}:
            doubt = True
    return level, doubt, inset and level > 0


def lines_of(page: str) -> list[_Line]:
    """The blocks of a page as lines, markup stripped; a region that is no article is marked line by line.

    A main element is not drawn out by the name of a wrapper around it. An element that is left out whole but never
    closed is passed over, so that it doesn't take the rest of the page with it. Time is in proportion to the page.
    """
    lines: list[_Line] = []
    stack = [_Element("", 0, 0, 0, False, 0, 0, 0, False)]
    opened: Counter[str] = Counter()
    closings = _Closings(page)
    parts: list[tuple[str, bool]] = []
    places, breaks, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal breaks
        breaks = 0
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                inside = [n for p, link in parts if link and (n := len(" ".join(html.unescape(p).split())))]
                lines.append(_Line(text, sum(inside), len(inside), stack[-1].holder, stack[-1].rooted, stack[-1].outside, stack[-1].doubt,
                    stack[-1].inset))
            parts.clear()

    def leave(to: int) -> None:
        opened.subtract(e.name for e in stack[to:])
        del stack[to:]

    def close(to: int) -> None:
        if any(not is_inline(e.name) or e.outside for e in stack[to:]):
            flush()
        leave(to)

    while at < end:
        start = page.find("<", at)
        start = end if start < 0 else start
        if start > at:
            parts.append((page[at:start], stack[-1].linked))
            breaks = breaks if page[at:start].isspace() else 0
        if start == end:
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a bare less-than sign
            parts.append(("<", stack[-1].linked))
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append((html.escape(m[0][9:].removesuffix("]]>")), stack[-1].linked))
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            elif not is_inline(name):
                flush()
            continue
        if name == "br":
            parts.append((" ", False))
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name in ("td", "th"):
            parts.append((" ", False))
        elif not is_inline(name) and name not in VOID and name not in WHOLE or name == "hr":
            flush()
            top = stack[-1].block
            above = stack[top].name
            if above == "p" or (above == name and name in ("li", "tr", "option")) or (above in ("dt", "dd") and name in ("dt", "dd")):
                leave(top)
        if name in VOID or m[3].endswith("/") and name not in INLINE and (name in OUTSIDE or name not in BLOCK):
            continue
        above = stack[-1]
        level, doubt, inset = _names_outside(name, m[3], above.rooted) if m[3] and name not in ("html", "body") else (0, False, False)
        fixed = name in OUTSIDE or (name == "header" and not above.rooted and not any(CONTENT_HEADERS & {w.lower()
            for w in _WORDS.findall(v)} for v in re.findall(r"class\s*=\s*[\"']?([^\"'>]*)", m[3])))
        outside = max(FIXED if fixed else level, 0 if name == "main" and above.outside < FIXED else above.outside)
        if name in WHOLE:
            close_at = closings.after(name, at)
            if close_at is None and name not in RAW:
                continue
            if not outside:
                parts.append((page[at : end if close_at is None else close_at], above.linked))
            tail = -1 if close_at is None else page.find(">", close_at)
            at = tail + 1 if tail >= 0 else end
            continue
        if outside != above.outside:
            flush()  # also an inline element, when it is no part of the article
        places += 1
        inline = is_inline(name)
        rooted = above.rooted or (places if name in ROOTS and outside < FIXED else 0)
        holder, block = above.holder if inline or name == "p" else places, above.block if inline else len(stack)
        stack.append(_Element(name, places, outside, rooted, above.linked or name == "a", above.doubt or (places if doubt else 0), holder, block,
            above.inset if above.outside else inset or (name == "aside" and above.rooted > 0)))
        opened[name] += 1
    flush()
    return lines


def _window_sums(lengths: list[int]) -> list[int]:
    return [sum(lengths[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(lengths))]


def _densest(lines: list[_Line], chosen: list[bool]) -> int:
    """The largest window sum of the chosen lines; the others count as blank windows."""
    return max(_window_sums([n for x, own in zip(lines, chosen, strict=True) for n in ([max(1, len(x.text) - x.linked)] if own else [0] * WINDOW)]), default=0)


def _settle_names(lines: list[_Line]) -> None:
    """Settles by link share and density which lines names really put outside."""
    doubts: dict[int, list[int]] = {}
    for x in lines:
        own = doubts.setdefault(x.doubt, [0, 0])
        own[0], own[1] = own[0] + len(x.text), own[1] + x.linked
    for x in lines:
        if x.doubt and not x.outside and doubts[x.doubt][1] * 2 >= doubts[x.doubt][0]:
            x.outside = LAYOUT
    free = [not x.outside for x in lines]
    if not any(f and x.rooted for f, x in zip(free, lines, strict=True)):
        below = [x.rooted > 0 and x.outside == LAYOUT for x in lines]
        if _densest(lines, below) > _densest(lines, free):  # the page's only article, below a wrapper
            for own, x in zip(below, lines, strict=True):
                x.outside = 0 if own else x.outside
        if not any(x.rooted and not x.outside for x in lines) and _densest(lines, free) < SURGE <= _densest(lines, [x.outside == LAYOUT for x in lines]):
            for x in lines:
                x.outside = 0 if x.outside == LAYOUT else x.outside
    if not any(not x.outside for x in lines):  # names mislead where nothing else is left
        for x in lines:
            x.outside = 0 if x.outside < FIXED else x.outside


def _blank_notices(lines: list[_Line], blank: list[bool], only_links: list[bool]) -> None:
    """Blanks short copyright notices at the page's end, after which no article line and no long one stands."""
    for i in range(len(lines) - 1, -1, -1):
        x = lines[i]
        listed = i > 0 and x.text[:3].lower() == "(c)" and lines[i - 1].text[:3].lower() == "(b)"
        notice = not x.rooted and not listed and len(x.text) <= NOTICE and bool(_NOTICE.match(x.text))
        if not blank[i] and not notice and not only_links[i] and (x.rooted or len(x.text) >= SURGE):
            return
        blank[i] = blank[i] or notice


def _is_menu(lines: list[_Line], items: int) -> bool:
    return items >= LONG_MENU or (items >= MENU_LINES and sum(x.linked for x in lines) <= LABEL * sum(x.links for x in lines))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by line feeds; empty if there is none.

    Lines get their length without links; lines outside the article, menus and copyright notices become blank windows, but adverts
    are taken away, so that they don't cut off what is short before or after them.
    Where a window's sum rises from nothing is a surge, where it falls to nothing a dive; a stretch between them is kept
    whole if a window in it reaches SURGE, if it shares an element with such a stretch, or, where no window does, if it
    is the densest. Inside article or main elements links and notices stay. Lines beside these elements don't count if
    the elements hold the densest window; else each element is a stretch of its own, kept also if it is the only one.
    """
    lines = lines_of(page or "")
    _settle_names(lines)
    blank = [x.outside > 0 for x in lines]
    only_links = [not x.rooted and x.linked * 2 >= len(x.text) for x in lines]
    blank = [gone or (only and _is_menu([x], x.links)) for gone, only, x in zip(blank, only_links, lines, strict=True)]
    _blank_notices(lines, blank, only_links)
    for i in range(len(lines)):
        if only_links[i] and not blank[i] and (i == 0 or not only_links[i - 1] or blank[i - 1]):
            run = next((j for j in range(i, len(lines)) if not only_links[j] or blank[j]), len(lines))
            if _is_menu(lines[i:run], run - i):
                blank[i:run] = [True] * (run - i)
    beside = [not gone and not x.rooted for gone, x in zip(blank, lines, strict=True)]
    within = [not gone and x.rooted > 0 for gone, x in zip(blank, lines, strict=True)]
    roots = any(within) and (not any(beside) or _densest(lines, within) >= _densest(lines, beside))
    sole = len({x.rooted for x, own in zip(lines, within, strict=True) if own}) == 1
    lengths: list[int] = []
    kept_lines: list[_Line | None] = []
    root = 0
    for line, gone in zip(lines, blank, strict=True):
        if gone and line.outside and line.inset:
            continue  # taken away: what it interrupts goes on
        if gone or (roots and not line.rooted) or (not roots and line.rooted != root):
            lengths += [0] * WINDOW
            kept_lines += [None] * WINDOW
        if not gone and not (roots and not line.rooted):
            lengths.append(max(1, len(line.text) - line.linked))
            kept_lines.append(line)
            root = line.rooted
    sums = _window_sums(lengths)
    stretches: list[tuple[int, list[_Line]]] = []
    surge = None
    for i in range(len(sums) + 1):
        if surge is None and i < len(sums) and sums[i]:
            surge = i
        elif surge is not None and (i == len(sums) or not sums[i]):
            stretches.append((max(sums[surge:i]), [x for x in kept_lines[surge:i] if x]))
            surge = None
    if not stretches:
        return ""
    most = max(s for s, _ in stretches)
    enough = 1 if roots else min(SURGE, most)
    places = {x.place for s, own in stretches if s >= enough for x in own}
    return "\n".join(x.text for s, own in stretches if s >= enough or (sole and own[0].rooted) or any(x.place in places for x in own) for x in own)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Whole pages are read; null counts as empty and gives an empty text. White space inside a block, character
    references decoded, becomes one space. Ids and urls may be null or repeat. An empty table gives an empty result.
    Other columns of pages are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    small_batches(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts),
                pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
