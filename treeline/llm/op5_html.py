"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; elements that are never part of an article (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) leave an empty line. The sum of
text lengths over a sliding window of lines surges where main text begins and dives where it ends, and of the stretches
between such points the one with most text is the core. Containers refine its ends: the article that holds most of the
core, or where the page marks none the innermost container around the core's long lines, is kept whole; without any, the
text between surge and dive is.

Scale: a narrow map over pages; nothing is shuffled and memory is bounded by a batch. A page is read in one pass, in time
in proportion to its length whatever stands unclosed in it.

Defined cases: null html is empty; a page without text gives the empty string; unclosed elements end with the next block
or the page; character references are decoded once; repeated rows and extra columns pass; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import in_python, table

#: Lines in a window, the least text in one where the main text may begin, and that below which it ends.
WINDOW, SURGE, DIVE = 3, 80, 30
#: A line with more of its text in links than this counts as empty in the distribution.
LINKED = 0.6

#: Comments, elements whose content is no markup, and declarations: to their end, or else that of the page.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_ARTICLES = frozenset(("article", "main"))
_CONTAINERS = frozenset("article main div section td".split())
_NEVER = frozenset("nav aside footer form button dialog menu fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_EARLY = frozenset("p li dt dd td th tr option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay"
    " newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond share sharing social related recommended"
    " footer masthead toolbar pagination pager widget login search".split()
)


def _named(tag: str, attributes: str) -> int:
    """2 if a class or id is a word of _NAMES, 1 if one has such a word among others, else 0; a heading's id names its subject and says nothing."""
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "class" or (name == "id" and tag not in _HEADINGS):
            for word in "".join(values).lower().split():
                if word in _NAMES:
                    return 2
                found = found or int(not _NAMES.isdisjoint(_PARTS.findall(word)))
    return found


def _unwanted(tag: str, attributes: str, inside_article: bool) -> int:
    """3 if the element's tag or role says that it is never part of an article, else what its names say."""
    if tag in _NEVER or (tag == "header" and not inside_article):
        return 3
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return 0
    if any(name.lower() == "role" and "".join(values).lower() in _ROLES for name, *values in _ATTRIBUTE.findall(attributes)):
        return 3
    return _named(tag, attributes)


def _tokens(page: str):
    """(start, end, tag or "" for what is no tag, closing, attributes) of the page's markup, in one pass: from the first quote that never ends on, quotes say nothing."""
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        after = page[at : at + 1]
        if after in "!?" or (raw := _RAW.match(page, start)):
            m = raw if after not in "!?" else _RAW.match(page, start)
            if m:
                at = m.end()
                yield start, at, "", False, ""
        elif after == "/" or after.isalpha():
            m = _TAG.match(page, start) if quotes else None
            if not m and (m := _PLAIN_TAG.match(page, start)):
                quotes = False
            if m:
                at = m.end()
                yield start, at, m[2].lower(), bool(m[1]), m[3]


def _extents(page: str) -> dict[int, tuple[bool, bool, float]]:
    """For each element with an end, by where it starts: whether it holds a main, whether an article with no name of _NAMES, and its share of the page's text."""
    text = mains = articles = at = 0
    opened: dict[str, list] = {}
    held = {}
    for begin, end, tag, closing, attributes in _tokens(page):
        text += len(page[at:begin].strip())
        at = end
        if not tag:
            continue
        if closing:
            if opened.get(tag):
                start, *before = opened[tag].pop()
                held[start] = (mains > before[0], articles > before[1], text - before[2])
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            mains += tag == "main"
            articles += tag == "article" and not _named(tag, attributes)
            opened.setdefault(tag, []).append((begin, mains, articles, text))
    text += len(page[at:].strip())
    for start, *before in (x for stack in opened.values() for x in stack):  # unclosed: to the end of the page
        held[start] = (mains > before[0], articles > before[1], text - before[2])
    return {start: (main, article, size / max(text, 1)) for start, (main, article, size) in held.items()}


class Containers:
    """The containers of a page, numbered as they begin; 0 is the page. What container k holds has the numbers k to last[k]."""

    def __init__(self):
        self.tag, self.parent, self.last, self.article = [""], [0], [0], [0]  # article: the innermost one that k is or stands in, or 0
        self.inside, self.open = [0], {}

    @property
    def now(self) -> int:
        return self.inside[-1]

    def begin(self, tag: str) -> None:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.now)
        self.last.append(k)
        self.article.append(k if tag in _ARTICLES else self.article[self.now])
        self.inside.append(k)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        """The innermost one of that tag ends, and unclosed ones within."""
        while self.open.get(tag, 0):
            k = self.inside.pop()
            self.last[k] = len(self.tag) - 1
            self.open[self.tag[k]] -= 1
            if self.tag[k] == tag:
                return

    def close(self) -> None:
        for k in self.inside:
            self.last[k] = len(self.tag) - 1

    def around(self, first: int, last: int) -> int:
        """The innermost container that holds those numbered first and last, and so all between."""
        while self.last[first] < last:
            first = self.parent[first]
        return first


def lines_of(page: str, wide: bool = False) -> tuple[list[tuple[str, int, float]], Containers]:
    """(text, innermost container, share of it in links) of each block in page order, and the containers; removed elements are empty lines.

    Names alone don't remove what holds the page's main or, outside any article, an article; nor, if wide, what holds most of the text and has a name that only contains a listed word."""
    out: list[tuple[str, int, float]] = []
    text: list[str] = []
    linked = length = links = 0
    places = Containers()
    skipped, depth = "", 0
    extents = None

    def spared(start: int, named: int) -> bool:
        nonlocal extents
        extents = _extents(page) if extents is None else extents
        main, article, share = extents.get(start, (False, False, 0.0))
        most = share > 0.5
        return main or (article and not places.article[places.now] and (named == 1 or most)) or (wide and named == 1 and most)

    def flush() -> None:
        nonlocal linked, length
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, places.now, linked / max(length, 1)))
            text.clear()
        linked = length = 0

    at = 0
    for begin, end, tag, closing, attributes in _tokens(page):
        if not skipped and begin > at:
            piece = page[at:begin]
            text.append(piece)
            length += len(piece)
            linked += len(piece) if links else 0
        at = end
        if not tag:
            continue
        if skipped:
            early = skipped in _ENDS_EARLY and tag in _BLOCKS and (closing or tag == skipped or tag not in ("ul", "ol", "dl"))
            if tag == skipped and tag not in _ENDS_EARLY:
                depth += -1 if closing else 1
            if depth == 0 or early:
                again = early and not (closing and tag == skipped)
                skipped = ""
                if not again:
                    continue
            elif tag in _ARTICLES and closing and places.article[places.now]:  # an unclosed element ends with its article
                skipped = ""
            else:
                continue
        if tag in _BLOCKS or tag == "body":
            flush()
        if tag == "br":
            text.append(" ")
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if not closing and tag not in _VOID and not attributes.rstrip().endswith("/") and (named := _unwanted(tag, attributes, places.article[places.now] > 0)) and (named == 3 or not spared(begin, named)):
            flush()
            out.append(("", places.now, 0.0))
            skipped, depth = tag, 1
        elif tag in _CONTAINERS and not closing:
            places.begin(tag)
        elif tag in _CONTAINERS:
            places.end(tag)
    if not skipped:
        text.append(page[at:])
    flush()
    places.close()
    return out, places


def core(lines: list[tuple[str, int, float]]) -> tuple[int, int]:
    """First line and end of the stretch from a surge to the next dive that holds most text; equal ones: the earlier."""
    sizes = [0 if share > LINKED else len(t) for t, _, share in lines]
    n = len(sizes)
    window = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    best, most = (0, 0), 0
    i = 0
    while i < n:
        if sizes[i] and window[i] >= SURGE:
            a = i
            while i < n and window[i] >= DIVE:
                i += 1
            if sum(sizes[a:i]) > most:
                best, most = (a, i), sum(sizes[a:i])
        else:
            i += 1
    if not most and any(sizes):  # no surge: all that is left
        return 0, n
    return best


def main_text(page: str | None) -> str:
    lines, places = lines_of(page or "")
    sizes = [len(t) for t, _, _ in lines]
    if not any(sum(sizes[i : i + WINDOW]) >= SURGE for i in range(len(sizes))):  # the main text may stand in what was removed
        lines, places = lines_of(page or "", wide=True)
    a, b = core(lines)
    held_text: dict[int, int] = {}
    for t, k, _ in lines[a:b]:
        if t:
            held_text[places.article[k]] = held_text.get(places.article[k], 0) + len(t)
    held = max(held_text, key=lambda k: (held_text[k], -k), default=0)
    if not held and held_text:  # the innermost container of the core, but for short lines that may have been caught at its ends
        numbers = [k for t, k, _ in lines[a:b] if WINDOW * len(t) >= SURGE] or [k for t, k, _ in lines[a:b] if t]
        held = places.around(min(numbers), max(numbers))
    if held:
        return "\n\n".join(t for t, k, _ in lines if t and held <= k <= places.last[held])
    return "\n\n".join(t for t, _, _ in lines[a:b] if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_python(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
