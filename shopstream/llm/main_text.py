"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element).  A line weighs its text length without link
text; weights are summed over sliding windows of ``WINDOW`` lines.  A region starts where the sums
surge from zero, ends where they dive to zero, and is kept if it reaches ``SURGE``.  Elements that are
never main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts,
styles) leave ``WINDOW`` blank lines, hence a dive.  Names of what a wrapper has (has-sidebar, comments-open)
don't mark it as such an element, and an article is left out only if it is hidden or a comment in another one.  Where a page marks its article, lines outside weigh
nothing and each line inside is enough for a surge, so that short paragraphs of an article stay.

Defined results: null, empty or text-free pages give the empty string.  Unclosed tags and comments end
with the page; an unclosed menu, sidebar or the like also ends where an article starts or ends.  If no
region surges, the region with the highest sum is kept.  Every row is judged alone: repeated rows and
further columns pass through, ``text`` and ``n_chars`` hold the operator's values.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 3
SURGE = 86

# Fixed values of HTML: elements by what they mean for the text.
RAW = frozenset("script style noscript template iframe textarea title svg math object select datalist".split())
NEVER = frozenset("nav footer aside form button dialog menu fieldset label head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details div dl dt figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody tfoot
    thead tr ul""".split())
ARTICLE = frozenset(("article", "main"))
# Words of class, id and role that name other parts of a page, and words that name the content.
OTHER = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent
    cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination
    popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toolbar complementary contentinfo search alert widget""".split())
CONTENT = frozenset("article body content entry main post story text".split())
STRONG = frozenset("""ad ads advert advertisement adverts advertising comment comments consent cookie cookies disqus
    newsletter notice related replies reply respond share sharing sidebar sponsor sponsored promo""".split())
READERS = frozenset("comment comments replies reply respond".split())
# Names that begin or end so tell what an element has or is filed under, not what it is: has-sidebar, comments-open.
ABOUT = frozenset("has with without no category tag".split())
STATE = frozenset("open closed enabled disabled".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]+|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[^a-z0-9]+")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def is_other(attributes: str, article: bool = False, inside: bool = False) -> bool:
    """Whether an element's attributes mark it as no part of the main text.

    An ``article`` element is main text whatever its class, but for a reader's comment ``inside`` another one.
    """
    parts: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        else:
            for token in value.split():
                words = NAME_PARTS.split(token)
                parts.update(CONTENT.intersection(words) if words[0] in ABOUT or words[-1] in STATE else words)
    if article:
        return inside and bool(parts & READERS) and not parts & (CONTENT - {"body"})
    return bool(parts & STRONG) or bool(parts & OTHER) and not parts & CONTENT


class Lines:
    """Lines of a page with their weights."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.plain: list[int] = []           # characters outside links
        self.inside: list[bool] = []         # in an article
        self.parts: list[str] = []
        self.linked = 0

    def add(self, piece: str, in_link: bool) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        self.parts.append(piece)
        if in_link:
            self.linked += len("".join(piece.split()))

    def end(self, inside: bool) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.text.append(text)
                self.plain.append(max(0, len(text) - text.count(" ") - self.linked))
                self.inside.append(inside)
            self.parts, self.linked = [], 0

    def gap(self) -> None:
        for _ in range(WINDOW):
            self.text.append("")
            self.plain.append(0)
            self.inside.append(False)


def page_lines(page: str) -> Lines:
    """The page's lines outside of elements that are never main text."""
    lines = Lines()
    at, depth, in_link = 0, 0, False
    skip, nested = "", 0                       # the element that is left out, and how deep it is in its like
    inner = 0                                  # articles (of reader comments, say) opened in it
    search = TAG.search
    while True:
        tag = search(page, at)
        piece = page[at:tag.start()] if tag else page[at:]
        if piece and not skip:
            lines.add(piece, in_link)
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(tag[1]), tag[3] or ""
        if skip:
            if skip == "p" and name in BLOCK and not (name == "p" and closing):   # a paragraph ends where a block starts
                nested = 0
                lines.gap()
                skip = ""
            elif name == skip:
                if closing:
                    nested -= 1
                elif not attributes.endswith("/"):
                    nested += 1
            # also ends where the article around it ends, or the first one starts, or the body of the page
            around = name in ARTICLE and skip not in ARTICLE and (not inner if closing else not depth)
            if name in ARTICLE and not around:
                inner += -1 if closing else 1
            if skip and nested and not (around or name == "body" and (closing or skip == "head")):
                continue
            if skip:
                ended_here = not nested
                if skip in BLOCK or skip in NEVER:
                    lines.gap()
                skip, nested = "", 0
                if ended_here:
                    continue
        if closing:
            if name in ARTICLE and depth:
                lines.end(True)
                depth -= 1
            elif name == "a":
                in_link = False
            elif name in BLOCK:
                lines.end(depth > 0)
            elif name in ("td", "th"):
                lines.add(" ", False)
            continue
        if name in RAW and not attributes.endswith("/"):
            found = RAW_END[name].search(page, at)
            at = found.end() if found else len(page)
            lines.add(" ", False)
            continue
        if name not in VOID and (name in NEVER or name == "header" and not depth or attributes and is_other(attributes, name in ARTICLE, depth > 0)) \
                and name not in ("html", "body"):
            if not attributes.endswith("/"):
                if name in BLOCK or name in NEVER:
                    lines.end(depth > 0)
                skip, nested, inner = name, 1, 0
            continue
        if name in BLOCK:
            lines.end(depth > 0)
            if name in ARTICLE:
                depth += 1
        elif name == "a":
            in_link = True
    lines.end(depth > 0)
    return lines


def main_text(page: str | None) -> str:
    """The text between surge and dive points of the page's line blocks."""
    if not page:
        return ""
    lines = page_lines(page)
    if any(lines.inside):
        weights = [SURGE if x else 0 for x in lines.inside]
    else:
        weights = lines.plain
    n = len(weights)
    sums = [sum(weights[i:i + WINDOW]) for i in range(n)]
    kept: list[str] = []
    best: tuple[int, list[str]] = (0, [])
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        peak = max(sums[start:i])
        first = next(k for k in range(start, n) if weights[k])
        region = [x for x in lines.text[first:i] if x]
        if peak >= SURGE:
            kept += region
        if peak > best[0]:
            best = (peak, region)
    return "\n".join(kept or best[1])


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the markup column; rows never leave their task."""
    keep = [c for c in pages.columns if c not in {column, "text", "n_chars"}]

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    out = pages.select(*keep, texts(F.col(column)).alias("text"))
    return out.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
