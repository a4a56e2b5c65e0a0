"""HTML extraction by line-block distribution.

Markup is stripped to lines (one a block), and each line weighs the length of its text. Names of
elements can only zero a line: boilerplate (navigation, headers and footers of the page, sidebars,
forms, notices, adverts, comments) weighs nothing, nor does a line that is one link outside the
named content, nor, where elements that name the content hold the bulk of a page's text, any line
beside them. Sums of weights over a sliding window of lines then decide on every page: a dive is a
whole window without weight, a surge a window that reaches ``SURGE`` or, on a page of little text,
half of the page's largest window. The main text is every stretch between two dives that surges,
from its first to its last line of weight, without boilerplate. As the threshold follows a
page's own distribution, no page that has text outside boilerplate is left empty.

Defined results: null and empty pages, and pages without text, give an empty string; a page cut
off inside a tag, entity or element is read as far as it goes; an element of no text that lacks its
closing tag ends at the next block (script and style at the page's end); very long pages, pages of one
line and markup that is never closed are read whole, in time linear in their length; a page of
equal windows (ties) keeps all of them; duplicates are extracted each; null ids and urls are
carried; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: Sum of text over a window at which text surges; half of the largest window on pages that never reach it twice over.
SURGE = 80
#: Shares of a page's text: of each element that counts as its content, and of all these together.
SHARE, BULK = 0.2, 0.5

#: Elements whose content is no text of the page.
_SILENT = {"script", "style", "template", "svg", "iframe", "head", "title", "select", "textarea", "button"}
#: Elements that hold no main text.
_ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Where a silent element without its closing tag ends; a list's own options do not end it.
_NEXT = re.compile(rf"</?(?:{'|'.join(sorted((_BLOCKS | _SILENT) - {'option'}))})(?=[\s/>])", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that mark boilerplate.
_NOISE = re.compile(
    r"ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|footer|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal"
    r"|newsletter|subscri\w*|signup|login|search\w*|social|shar(?:e|es|ing)|related|recommend\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus|paginat\w*|pager|tags|widgets?|toolbar"
    r"|skip|copyright|legal|complementary|contentinfo|toc"
)
#: The same for headers, which are boilerplate unless they stand inside the content.
_HEADER = re.compile(r"header|masthead|site-?head|topnav")
#: Words that say only how or where a thing is put: beside one of these a word above keeps its meaning ("share-buttons"), beside another it does not ("share-price").
_PLACE = re.compile(
    r"\d+|[a-z]|site|page|top|bottom|left|right|main|inner|outer|global|primary|secondary|sub|mini|sticky|fixed|float\w*|bar|box|btns?|buttons?|list|lists|links?|wrap|wrapper|container|area|section|block|panel|items?|form"
    r"|form-?field|icons?|count|message|overlay|row|col|column|unit|slot|zone|group|module|component|header|footer|nav|posts?|articles?|stories|story|entry|blog|news|user|reader|thread|policy|law|bottombar|content|title|heading|text|toggle|tools?|media|input|field|img|image|rail|side|desktop|mobile|hidden|show|open|close"
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article(?:-?(?:body|content|text))?|post-?(?:body|content|text)|entry-?(?:content|body)|main-?(?:content|text)?|content|story(?:-?body)?|body-?text)(?=$|[\s_-])", re.I)
#: Comments, declarations, tags; a quote opens only after an equals sign, and what is left open runs to the page's end. Nothing is tried twice.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    text: str
    box: int  #: content element it lies in, counted from 1 in page order; 0 is none
    noise: bool
    link: bool  #: the whole line is links


class _Open(NamedTuple):
    name: str
    noise: bool
    box: int
    block: str  #: the nearest block that is open, itself included


def _says(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role says boilerplate, and whether it says header: a name does when one of its words is such a word and the others only say where."""
    noise = header = False
    for name in value.split():
        parts = [p for p in re.split(r"[-_:]+", _CAMEL.sub("-", name).lower()) if p]
        marked = [bool(_NOISE.fullmatch(p)) for p in parts]
        if any(marked):
            noise = noise or all(m or _PLACE.fullmatch(p) or _HEADER.fullmatch(p) for p, m in zip(parts, marked))
        elif any(_HEADER.fullmatch(p) for p in parts):
            header = header or all(_HEADER.fullmatch(p) or _PLACE.fullmatch(p) for p in parts)
    return noise, header


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element's name or attributes say boilerplate, header, or content."""
    noise, header, content = tag in _ASIDE, tag == "header", tag in ("article", "main")
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            value, name = value.strip("\"'"), name.lower()
            if name in ("class", "id", "role"):
                says, heads = _says(value)
                if tag not in ("body", "html", "article", "main"):
                    noise, header = noise or says, header or heads
                content = content or (tag in _BLOCKS and tag not in ("body", "html") and bool(_CONTENT.search(value)) and not says and not heads)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                noise = True
    return noise, header, content


def lines(page: str) -> list[Line]:
    """The blocks of a page in its order."""
    out: list[Line] = []
    piece: list[str] = []
    loose = False  # text outside links in this line
    stack: list[_Open] = []
    count: Counter[str] = Counter()  # open elements by name
    unended: set[str] = set()  # silent elements with no closing tag in the rest of the page
    containers, at, n = 0, 0, len(page)

    def close_line() -> None:
        nonlocal loose
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append(Line(text, stack[-1].box if stack else 0, bool(stack) and stack[-1].noise, not loose))
        loose = False

    def say(text: str) -> None:
        nonlocal loose
        piece.append(text)
        loose = loose or not count["a"] and not text.isspace()

    def close_to(name: str) -> None:
        while stack:
            gone = stack.pop().name
            count[gone] -= 1
            if gone == name:
                break

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.rfind("<")
            say(rest if cut < 0 or not re.match(r"<[a-zA-Z/!?]", rest[cut:]) else rest[:cut])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _BLOCKS:
                close_line()
            if count[name]:
                close_to(name)
            continue
        closed = m[3].rstrip().endswith("/")
        if name in _SILENT:
            if name == "svg" and closed:
                continue
            end = None if name in unended else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                unended.add(name)
                if name in ("script", "style"):
                    at = n
                elif name != "head":  # what an unclosed head holds is silent or void by itself
                    following = _NEXT.search(page, at)
                    at = following.start() if following else n
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in _VOID or closed and name not in _BLOCKS:
            if name == "hr":
                close_line()
            continue
        if name in _BLOCKS:
            close_line()
            # An open paragraph or item ends where the next block begins.
            if stack and stack[-1].block == "p":
                close_to("p")
            if name == "li" and stack and stack[-1].block == "li":
                close_to("li")
        noise, header, content = _marks(name, m[3])
        above = stack[-1] if stack else _Open("", False, 0, "")
        box = above.box
        noise = noise or header and not box  # a header inside the content is the content's own
        if content and not above.noise and not noise and not box:
            containers += 1
            box = containers
        stack.append(_Open(name, above.noise or noise, box, name if name in _BLOCKS else above.block))
        count[name] += 1
    close_line()
    return out


def distribution(found: list[Line]) -> tuple[list[Line], list[int]]:
    """The lines that can hold main text or part it, and their weights. Boilerplate inside the content parts nothing, so it is left out."""
    size: Counter[int] = Counter()
    for x in found:
        if not x.noise:
            size[x.box] += len(x.text)
    total = size.total()
    chosen = {box for box, s in size.items() if box and s >= SHARE * total}
    if sum(size[box] for box in chosen) < BULK * total:
        chosen = set()
    left = [x for x in found if not (x.noise and x.box)]
    beside = [x.noise or bool(chosen) and x.box not in chosen for x in left]
    left = [x._replace(noise=b) for x, b in zip(left, beside)]
    return left, [0 if x.noise or x.link and not x.box else len(x.text) for x in left]


def runs(weight: list[int]) -> list[tuple[int, int]]:
    """[from, to) of every stretch between two dives that surges, from its first to its last line of weight."""
    n = len(weight)
    up_to = [0, *accumulate(weight)]
    sums = [up_to[min(n, i + WINDOW)] - up_to[i] for i in range(n)]
    surge = min(SURGE, max(sums, default=0) / 2)
    out, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j]:
            j += 1
        if j > i and max(sums[i:j]) >= surge:
            weighted = [k for k in range(i, j) if weight[k]]
            out.append((weighted[0], weighted[-1] + 1))
        i = j + 1
    return out


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by one newline."""
    if not page:
        return ""
    found = lines(page)
    left, weight = distribution(found)
    kept = runs(weight)
    if not kept and any(not x.noise for x in left):  # links alone: they are the text
        weight = [0 if x.noise else len(x.text) for x in left]
        kept = runs(weight)
    return "\n".join(left[k].text for i, j in kept for k in range(i, j) if not left[k].noise)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page, from the whole html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
