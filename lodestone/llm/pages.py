"""The main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one a block. A sliding window sums the lengths of lines; where it rises from nothing the text surges, where it
falls back to nothing it dives, and what lies between is main text if the window ever holds enough. Lines of menus, adverts and the like have no length,
so they part such stretches; if the page marks its article, lines outside have none either.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters in it that make a stretch main text where the page doesn't mark any.
WINDOW, SURGE = 3, 86
#: Share of a line's characters in links from which on it counts as a menu, where the page doesn't mark its article.
LINKED = 0.5

# Elements by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of which nothing is main text.
DROPPED = set("aside audio button canvas datalist dialog embed footer form head iframe map menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class names and ids that mark menus, footers, sidebars, notices, adverts and comments.
NAMES = set(
    "ad adblock adbox ads adsense adslot adunit adv advert advertisement advertising alert announcement banner bottombar breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr leaderboard legal login menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promos promoted promotion recommended "
    "recommendations related replies reply respond responses search searchbox searchform share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription taboola teaser "
    "teasers toolbar topbar widget widgets".split()
)
#: Parts that may stand beside those in the name of an article or main element that is none; others, as of topics, tell nothing.
BESIDE = set("body box card content entry inner item list wrapper".split())
HEADER_NAMES = {"header", "masthead"}
#: Class names and ids of what holds the article.
CONTENT_NAMES = set("article articlebody articlecontent articletext content entry entrycontent main maincontent maintext post postbody postcontent story storybody storycontent".split())
#: An element that opens ends open ones of these names, up to the nearest of the others.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that may stand in a head; any other ends one.
_OF_HEAD = set("base link meta noscript script style template title".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Line:
    text: str
    linked: int
    #: Whether an element that is no main text holds it, and whether article, main or content elements do.
    dropped: bool
    marks: int


@dataclass
class _Open:
    """An open element: whether it or one that holds it is no main text, a header, a link or a heading, and the marks of all of them."""

    name: str
    dropped: bool
    #: Dropped within a line, which goes on behind it.
    silent: bool
    header: bool
    marks: int
    link: bool
    heading: bool


#: Marks of what holds the article.
ARTICLE, MAIN, CONTENT = 4, 2, 1


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class name and of the id; names that tell what an element has or lacks are left out."""
    whole = attributes.get("class", "").split() + attributes.get("id", "").split()
    listed = [[w.lower() for w in _WORDS.findall(name)] for name in whole]
    return [words for words in listed if words and words[0] not in ("has", "with", "no", "is", "without")]


def _opened(name: str, rest: str, above: _Open | None) -> _Open:
    """What an element means where it stands."""
    if above:
        out = _Open(name, above.dropped, above.silent, above.header, above.marks, above.link or name == "a", above.heading or name in HEADINGS)
    else:
        out = _Open(name, False, False, False, 0, name == "a", name in HEADINGS)
    out.dropped |= name in DROPPED
    out.header |= name == "header"
    out.marks |= ARTICLE if name == "article" else MAIN if name == "main" else 0
    if name not in ("html", "body") and ("=" in rest or "hidden" in rest):
        given = _attributes(rest)
        role = given.get("role", "").strip().lower()
        names = _names(given)
        if name in ("article", "main"):
            marked = any(words[0] in NAMES and set(words) <= NAMES | BESIDE for words in names)
        else:
            marked = any(not NAMES.isdisjoint([*words, "".join(words)]) for words in names)
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.IGNORECASE)
        out.dropped |= bool(role in ROLES or hidden or marked)
        out.header |= role == "banner" or any(not HEADER_NAMES.isdisjoint(words) for words in names)
        out.marks |= MAIN if role == "main" else ARTICLE if role == "article" or "articlebody" in given.get("itemprop", "").lower() else 0
        if name in BLOCKS and name != "li" and any("".join(words) in CONTENT_NAMES for words in names):
            out.marks |= CONTENT
    if out.dropped and not (above and above.dropped):
        out.silent = name not in BLOCKS
    return out


class _Page:
    """Reads a page tag by tag into lines."""

    def __init__(self, page: str):
        self.page = page
        self.lines: list[Line] = []
        self.stack: list[_Open] = []
        self.open: dict[str, int] = {}  # how many of a name are open
        self.last_end = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z][^\s/>]*)", page)}
        self.text: list[str] = []
        self.linked = 0
        self.state = (False, 0)

    def say(self, piece: str) -> None:
        top = self.stack[-1] if self.stack else None
        if not piece or top and top.silent:
            return
        piece = html.unescape(piece)
        if not any(map(str.strip, self.text)):
            # of a header, only headings of an article belong to it
            self.state = (top.dropped or top.header and not (top.heading and top.marks), top.marks) if top else (False, 0)
        self.text.append(piece)
        if top and top.link:
            self.linked += len("".join(piece.split()))

    def close_line(self) -> None:
        whole = " ".join("".join(self.text).split())
        if whole or not self.lines or self.lines[-1].text:
            self.lines.append(Line(whole, self.linked, *self.state))
        self.text.clear()
        self.linked, self.state = 0, (False, 0)

    def push(self, x: _Open) -> None:
        self.stack.append(x)
        self.open[x.name] = self.open.get(x.name, 0) + 1

    def pop_to(self, depth: int) -> None:
        gone = self.stack[depth:]
        if any(x.name in BLOCKS for x in gone):
            self.close_line()
        del self.stack[depth:]
        for x in gone:
            self.open[x.name] -= 1

    def up(self, found, walls=()) -> int | None:
        """The place of the innermost open element of these names, unless one of walls is nearer."""
        if not any(self.open.get(n) for n in found):
            return None
        return next((k if self.stack[k].name in found else None for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].name in found or self.stack[k].name in walls), None)

    def end(self, name: str) -> None:
        depth = self.up({name})
        if depth is None:
            if name in BLOCKS:
                self.close_line()
        elif name in BLOCKS or not any(x.name in BLOCKS for x in self.stack[depth + 1 :]):
            self.pop_to(depth)
        else:
            # an inline element that holds blocks: they stay open, and are links no more
            for x in self.stack[depth + 1 :]:
                x.link = x.link and name != "a"
            del self.stack[depth]
            self.open[name] -= 1

    def start(self, name: str, rest: str, at: int) -> None:
        if self.open.get("head") and name not in _OF_HEAD:
            self.pop_to(self.up({"head"}))
        if name in BLOCKS:
            if (depth := self.up({"p"}, BLOCKS - {"p"})) is not None:
                self.pop_to(depth)
            self.close_line()
        if name in IMPLIED_ENDS:
            ended, walls = IMPLIED_ENDS[name]
            while (depth := self.up(ended, walls)) is not None:
                self.pop_to(depth)
        if name in ("article", "main"):
            # what is dropped and never ends doesn't hold the article
            lost = next((k for k, x in enumerate(self.stack) if (x.dropped or x.header) and self.last_end.get(x.name, -1) < at), None)
            if lost is not None:
                self.pop_to(lost)
        opened = _opened(name, rest, self.stack[-1] if self.stack else None)
        if name in VOID or rest.endswith("/") and name not in BLOCKS or opened.silent and self.last_end.get(name, -1) < at:
            return
        self.push(opened)

    def read(self) -> list[Line]:
        at = 0
        while m := _TAG.search(self.page, at):
            self.say(self.page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if name == "br":
                self.say(" ")
            elif name and m["end"]:
                self.end(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(self.page, at)
                at = end.end() if end else len(self.page)
            elif name:
                self.start(name, m["rest"], m.start())
        self.say(self.page[at:])
        self.close_line()
        return self.lines


def page_lines(page: str) -> list[Line]:
    """The lines of a page without markup: a line a block, empty ones too, in page order."""
    return _Page(page).read()


def main_text(page: str | None) -> str:
    """The main text of a page, a block a line."""
    lines = page_lines(page or "")
    size = np.array([0 if x.dropped else len(x.text) for x in lines], np.int64)
    marks = np.array([x.marks for x in lines], np.int64)
    least = 1
    for mark in (ARTICLE, MAIN, CONTENT):
        if (size[marks & mark > 0] > 0).any():
            size[marks & mark == 0] = 0
            break
    else:
        # nothing is marked: menus are lines of links, and a stretch has to hold some text
        letters = np.array([len("".join(x.text.split())) for x in lines], np.int64)
        size[np.array([x.linked for x in lines], np.int64) > LINKED * np.maximum(letters, 1)] = 0
        least = SURGE
    if not size.any():
        return ""
    window = np.convolve(size, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of a line and those behind it
    least = min(least, int(window.max()))
    text = window > 0
    edge = np.diff(np.concatenate([[False], text, [False]]).astype(np.int8))
    kept = [x for surge, dive in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if window[surge:dive].max() >= least for x in range(surge, dive)]
    return "\n".join(lines[k].text for k in kept if size[k])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html): the main text, blocks joined by line ends, and its code points.

    Main text is the article: no menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup or readers'
    comments. What these are is told by elements, roles, class names and ids, and, where the page doesn't mark its article, by
    shares of links and by the distribution of text over lines. White space within a block is one space; character references are decoded.

    Null or empty html gives an empty text, as does a page without main text. Markup may be broken: what isn't closed ends with what holds it. A
    null page_id or url is carried on, repeated rows each give a row, other columns are ignored. A page is read as a whole in
    one step, by a stack without recursion; nothing is shuffled.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
