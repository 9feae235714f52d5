"""Pages: title, date, author, image and main text."""

from __future__ import annotations

import html as escapes
import re
from collections.abc import Iterator
from html.entities import html5 as HTML5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

SKIPPED = {"nav", "footer", "script", "style", "header", "noscript", "template", "aside"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "table", "ul", "ol", "blockquote", "pre"}
VOID = {"br", "img", "meta", "link", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}


def title_column(html: Column) -> Column:
    """Raw text of the title element, else of the first heading."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return S.strip(F.when(title != "", title).otherwise(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.flat: list[str] = []
        self.title: list[str] = []
        self.heading: list[str] = []
        self.meta: dict[str, str] = {}
        self.open: list[str] = []

    def parse_html_declaration(self, i):
        # no marked sections in pages: as in browsers, <![ is a comment up to the next >
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            a = dict(attrs)
            name = a.get("property") or a.get("name")
            if name and a.get("content") and name not in self.meta:
                self.meta[name.lower()] = a["content"].strip()
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in ("td", "th"):
            self.parts.append(" | ")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if "title" in self.open and not self.title_done():
            self.title.append(data)
            return
        if "h1" in self.open and "h1" not in self.meta:
            self.heading.append(data)
        if not SKIPPED & set(self.open) and "head" not in self.open:
            self.parts.append(data)
            if data.strip():
                self.flat.append(data.strip())

    def title_done(self) -> bool:
        return "svg" in self.open


def short_words(text: str) -> bool:
    words = text.split()
    return not words or sum(len(w) <= 3 for w in words) / len(words) > 0.6


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _whole(html: str) -> str:
    """html with every & that begins no complete character reference written as one that stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in HTML5) else "&amp;" + m[0][1:], html)


#: The digits of a number that count: beyond eight there is no such character, and int() refuses thousands.
_NUMBER = re.compile(r"&#0*([0-9]{1,8})[0-9]*")
_GONE = {"<!--": "-->", "<head>": "</head>", **{rf"<{t}(?:\s[^>]*)?>": f"</{t}>" for t in sorted(SKIPPED)}}
_PARTS = [(re.compile(rf"{start}.*?{end}", re.I | re.A | re.S), re.compile(end, re.I | re.A)) for start, end in _GONE.items()]
_OPEN = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED | {'head', 'title'}))})(?:\s[^>]*)?>", re.I | re.A)


def _closed(html: str) -> str:
    """html without comments, head and skipped elements, each up to its first end tag; where that is missing nothing goes but the start tag."""
    for part, end in _PARTS:
        last = 0
        for m in end.finditer(html):
            last = m.end()
        html = part.sub("" if end.pattern == "-->" else "<wbr>", html[:last]) + html[last:]  # a search from any start ends before last
    last = html.rfind(">") + 1
    return _OPEN.sub("<wbr>", html[:last]) + html[last:]


def _parsed(html: str) -> _Page:
    page = _Page()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        page.parts = page.flat = [escapes.unescape(re.sub(r"<[^>]*>", " ", html))]
    return page


def extract(html: str, max_chars: int | None = None, whole_references: bool = False, closed_only: bool = False) -> dict | None:
    """title, timestamp, author, image, content of a page, whole unless max_chars is given; None if it has no text.

    The text keeps its blocks as lines; if that is short or mostly short words, the page's
    visible text joined by spaces is taken. Browsers also read some references that lack their
    semicolon (&amp); with whole_references those stay as they are. What is skipped and has no
    end tag takes the rest of its parent with it, or of the page; with closed_only it skips nothing,
    and goes up to its first end tag otherwise.
    """
    html = _NUMBER.sub(r"&#\1", _whole(html) if whole_references else html)
    page = _parsed(html)
    body = _parsed(_closed(html)) if closed_only else page
    lines = (" ".join(x.split()) for x in "".join(body.parts).split("\n"))
    text = "\n".join(x for x in lines if x)
    if len(text) < 200 or short_words(text):
        text = " ".join(body.flat) or text
    text = text[:max_chars].strip()
    if not text:
        return None
    title = " ".join("".join(page.title).split()) or " ".join("".join(page.heading).split())
    return {"title": title, "timestamp": page.meta.get("article:published_time") or page.meta.get("date") or "", "author": page.meta.get("author"), "image": page.meta.get("og:image"), "content": text}


def extract_pages(pages: DataFrame, max_chars: int | None = None, now: str = "", keep: list[str] | None = None, whole_references: bool = False, closed_only: bool = False) -> DataFrame:
    """Documents of pages (url, html) with their whole text unless max_chars is given, and the columns to keep. Pages without text give no row; a missing date is ``now``. A narrow map."""
    keep = keep or []
    schema = T.StructType([*[f for f in pages.schema.fields if f.name in keep], *[T.StructField(n, T.StringType()) for n in ("content", "source", "title", "timestamp", "author", "image")]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for record in part.to_dict("records"):
                found = extract(record["html"], max_chars, whole_references, closed_only) if isinstance(record["html"], str) else None
                if found:
                    rows.append({**{k: record[k] for k in keep}, **found, "source": record["url"], "timestamp": found["timestamp"] or now})
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select(*keep, "url", "html").mapInPandas(run, schema)
