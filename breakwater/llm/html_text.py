"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one line for each block of the page, and an empty line
where something was left out that is no content by its element, class, id or role (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, reader comments).  Over these
lines the lengths of text that isn't link text are summed in sliding windows.  Text begins
where the sums surge and ends where they dive to nothing, and all lines between are kept,
short ones too.  What a page marks as its article only bounds the runs so found: if most of their
text is marked, what is not marked goes; a short marked teaser beside a longer text decides
nothing.  What was left out inside a marked article is no dive, as an article is not over at an advert."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines of a window.
WINDOW = 3
#: Characters of a window that make a surge, and the part of the page's best window that does.
SURGE, SURGE_PART = 80, 0.25
#: Part of the found text that must lie in marked articles for these to bound it.
MARKED_PART = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul caption option".split()
)
ROOTS = frozenset(("article", "main"))
NO_CONTENT = frozenset("head nav footer aside form dialog menu select button fieldset".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: A name that ends with one of these is that of a text, whatever stands before.
TEXT_WORDS = frozenset("article story".split())
#: Words that mean no content except inside an article, where they mean its own heading.
OUTSIDE_WORDS = frozenset("header topbar".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "head", "option", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select div article section main body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Line:
    text: str
    links: int  # characters of link text
    root: bool  # inside an article or main element


def _no_content(name: str, attrs: str, in_article: bool) -> bool:
    if name in NO_CONTENT or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or not attrs.strip(" /"):
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), html.unescape("".join(values)).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key == "role" and value.strip() in NO_CONTENT_ROLES:
            return True
        if key in ("class", "id"):
            words = {w for name in value.split() for w in (_WORDS.findall(name) or [""]) if not name.endswith(tuple(TEXT_WORDS))}
            if words & NO_CONTENT_WORDS or not in_article and words & OUTSIDE_WORDS:
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page as lines; an empty one stands for what was left out."""
    lines: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is no content
    still: Counter[str] = Counter()  # how many of each name are open
    skipped = roots = links = 0
    parts: list[str] = []
    link_chars = 0
    at = 0

    def flush():
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, link_chars, roots > 0))
        parts, link_chars = [], 0

    def pop(to: int):
        nonlocal skipped, roots, links
        while len(stack) > to:
            name, skip = stack.pop()
            still[name] -= 1
            skipped -= skip
            roots -= name in ROOTS
            links -= name == "a"

    def add(text: str):
        nonlocal link_chars
        if text and not skipped:
            decoded = html.unescape(text)
            parts.append(decoded)
            if links:
                link_chars += len(" ".join(decoded.split()))

    while True:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            continue
        name = name.lower()
        if found["close"] or found["close2"]:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if still[name] else None
            if name in BLOCK:
                flush()
            if open_at is not None:
                pop(open_at)
            continue
        attrs = found["attrs"] if found["name"] else found["attrs2"]
        if name == "br":
            add(" ")
            continue
        if name in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "textarea", "title", "xmp"):
                at = len(page)
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
        elif name in ("td", "th"):
            add(" ")
        if name in ENDS_P and still["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if name in SIBLINGS and any(still[x] for x in SIBLINGS[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[name]:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if name == "body":  # a head that never ended
            while stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        if name in ROOTS and skipped and not _no_content(name, attrs, False):
            # an article begins: what was left out before it and never ended ends here, unless it
            # has its own end further on
            outer = next(i for i, (_, skip) in enumerate(stack) if skip)
            if not re.compile(rf"</{re.escape(stack[outer][0])}[\s>]", re.IGNORECASE).search(page, at):
                pop(outer)
        skip = _no_content(name, attrs, roots > 0)
        if skip and not skipped:
            flush()
            lines.append(Line("", 0, roots > 0))
        stack.append((name, skip))
        still[name] += 1
        skipped += skip
        roots += name in ROOTS
        links += name == "a"
    flush()
    return lines


def spans(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines, from the first line with text in front of a surge of the window sums
    to the dive after it, where a whole window has no text."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    surge = min(SURGE, SURGE_PART * max(sums, default=0))
    out, i, n = [], 0, len(lengths)
    while i < n:
        if not lengths[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        last = max(k for k in range(i, dive) if lengths[k]) + 1
        if max(sums[i:dive]) >= surge:
            out.append((i, last))
        i = dive
    return out


def main_text(page: str) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    lines: list[Line] = []
    lengths: list[int] = []
    for line in lines_of(page):
        if line.text:
            lines.append(line)
            # a line of links alone has no text, except in an article
            lengths.append(max(int(line.root), len(line.text) - line.links))
        elif not line.root:
            lines += [line] * WINDOW
            lengths += [0] * WINDOW
    found = [line for start, end in spans(lengths) for line in lines[start:end] if line.text]
    marked = [line for line in found if line.root]
    if sum(len(line.text) for line in marked) >= MARKED_PART * sum(len(line.text) for line in found):
        found = marked
    return "\n\n".join(line.text for line in found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.  A null html is empty and gives an empty
    text, as does a page without text; ids and urls are handed on, null or repeated; other
    columns are ignored; an empty table gives no rows.  No rows meet, so nothing is dealt anew."""
    src = common.renamed(pages, page_id=F.col(f"`{id_col}`").cast("long"), url=url_col, html=F.coalesce(F.col(f"`{html_col}`"), F.lit("")))

    def each(b):
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return common.map_batches(src, each, "page_id long, url string, text string, n_chars long")
