"""HTML to lines, links, titles and main text. Pages are parsed by the standard library within Arrow batches, one page at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that hold no content.
NOISE = ("script", "style", "noscript", "nav", "header", "footer", "svg", "iframe", "form", "button")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "body", "title", "option", "dd", "dt"}
#: A main element counts as the root if it holds at least this share of all text.
MAIN_SHARE = 0.2
#: Pages are parsed and handed on in pieces of about so many characters.
PIECE = 1 << 20
_STAMPS = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?|\b\d{1,2}:\d{2}(:\d{2})?\b")


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


class _Page(HTMLParser):
    """Collects text lines, table rows, links, titles and meta description in one pass."""

    def __init__(self, source: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.source = source
        self.line_starts: list[int] = []
        self.heading_from: int | None = None
        self.heading: str | None = None
        self.open: list[str] = []
        self.text: list[str] = []
        self.main: list[str] = []
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.links: list[tuple[str, str]] = []
        self.link: tuple[str, list[str]] | None = None
        self.titles: dict[str, list[str]] = {"title": [], "h1": []}
        self.meta: str | None = None
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        if tag == "meta" and (known.get("name") or known.get("property") or "").lower() in ("description", "og:description"):
            self.meta = self.meta or known.get("content")
        if tag in _BLOCK:
            self._break()
        if tag in _VOID:
            return
        self.open.append(tag)
        self.muted += tag in NOISE
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self.cell = []
        if tag == "a" and known.get("href"):
            self.link = (known["href"], [])
        if tag == "h1" and self.heading is None:
            self.heading_from = self._place() + len(self.get_starttag_text() or "")

    def _place(self) -> int:
        """Where in the source the parser stands."""
        self.line_starts = self.line_starts or [0, *(m.end() for m in re.finditer("\n", self.source))]
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_endtag(self, tag: str) -> None:
        if tag == "h1" and self.heading is None and self.heading_from is not None:
            self.heading = self.source[self.heading_from : self._place()]
        if tag in _BLOCK:
            self._break()
        if tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append(" ".join(" ".join(self.cell).split()))
            self.cell = None
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(" ".join(self.link[1]).split())))
            self.link = None
        while tag in self.open:
            closed = self.open.pop()
            self.muted -= closed in NOISE
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        for name in ("title", "h1"):
            if name in self.open:
                self.titles[name].append(data)
        if self.link:
            self.link[1].append(data)
        if self.muted or "title" in self.open:
            return
        if self.cell is not None:
            self.cell.append(data)
        self.text.append(data)
        if "main" in self.open or "article" in self.open:
            self.main.append(data)

    def _break(self) -> None:
        self.text.append("\n")
        self.main.append("\n")


def _parsed(html: str | None) -> _Page:
    page = _Page(html or "")
    page.feed(html or "")
    page.close()
    return page


def _some(column: pd.Series) -> Iterator[pd.Series]:
    """The column in pieces of about PIECE characters: a batch's results are handed on before the next pages are parsed."""
    sizes = column.str.len().fillna(0).cumsum() // PIECE
    for _, piece in column.groupby(sizes, sort=False):
        yield piece


def _lines(chunks: list[str]) -> list[str]:
    out = (" ".join(line.split()) for line in "".join(chunks).split("\n"))
    return [line for line in out if line]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Table rows, their cells joined by tabs, then all lines of text."""
    for html in (piece for part in parts for piece in _some(part)):
        pages = map(_parsed, html)
        yield pd.Series([["\t".join(r) for r in p.rows if any(r)] + _lines(p.text) for p in pages], dtype=object)


@F.pandas_udf(_struct("text", "hash"))
def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The page's content without noise elements, and its fingerprint without times of day and time stamps: a page that only tells the time anew is unchanged."""
    for html in (piece for part in parts for piece in _some(part)):
        texts = []
        for p in map(_parsed, html):
            whole, main = "\n".join(_lines(p.text)), "\n".join(_lines(p.main))
            texts.append(main if len(main) >= MAIN_SHARE * len(whole) and main else whole)
        hashes = [hashlib.sha256(" ".join(_STAMPS.sub(" ", t).split()).encode()).hexdigest() for t in texts]
        yield pd.DataFrame({"text": texts, "hash": hashes})


@F.pandas_udf(_struct("name", "title", "description", "heading"))
def page_titles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The product's name (heading, else the title's first segment), the title and the description; the first heading as it is written, its character references unread (null if there is none)."""
    for html in (piece for part in parts for piece in _some(part)):
        rows = []
        for p in map(_parsed, html):
            title, h1 = (" ".join("".join(p.titles[n]).split()) for n in ("title", "h1"))
            rows.append((h1 or re.split(r"\s+[|–—-]\s+", title)[0] or None, title or None, p.meta, None if p.heading is None else " ".join(re.sub(r"<[^>]*>", " ", p.heading).split())))
        yield pd.DataFrame(rows, columns=["name", "title", "description", "heading"])


@F.pandas_udf(T.ArrayType(_struct("url", "text")))
def page_links(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Absolute links of a page, one for each address (the longest text stays), without mail, telephone, script and same-page links."""
    for html, base in ((piece, base.loc[piece.index]) for part, base in parts for piece in _some(part)):
        out = []
        for body, own in zip(html, base, strict=True):
            best: dict[str, str] = {}
            for href, words in _parsed(body).links:
                if re.match(r"(?i)\s*(mailto:|tel:|javascript:|#)", href):
                    continue
                try:
                    url = urljoin(own or "", href.strip())
                    ok = urlsplit(url).scheme in ("http", "https")
                except ValueError:
                    continue
                if ok and len(words) >= len(best.get(url, "")):
                    best[url] = words
            out.append([{"url": u, "text": t} for u, t in best.items()])
        yield pd.Series(out, dtype=object)


#: An element of these kinds is the block of the links in it.
_ITEM = ("article", "li")


class _Ranges(HTMLParser):
    """Links, blocks and headings with the range of visible text that each covers. A block is an article or list item, or else the element right around a link."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, start, whether a link stands right in it, address
        self.parts: list[str] = []
        self.size = self.muted = 0
        self.links: list[dict] = []
        self.blocks: list[dict] = []
        self.headings: list = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        if tag == "li":  # an item ends where its list's next begins
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in ("ul", "ol"):
                    break
                if self.open[i][0] == "li":
                    self._close(i)
                    break
        if tag == "a" and self.open:
            self.open[-1][2] = True
        self.open.append([tag, self.size, False, dict(attrs).get("href") if tag == "a" else None])
        self.muted += tag in NOISE

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.muted and not any(o[0] == "title" for o in self.open):
            self.parts.append(data + " ")
            self.size += len(data) + 1

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            tag, start, holds, href = self.open.pop()
            self.muted -= tag in NOISE
            if self.muted:
                continue
            if tag == "a":
                self.links.append({"href": href, "start": start, "end": self.size})
            elif tag in _ITEM or holds:
                self.blocks.append({"start": start, "end": self.size, "item": tag in _ITEM})
            if tag in ("h1", "h2", "h3", "h4"):
                self.headings.append((start, self.size))

    def finish(self) -> str:
        """Closes what is open and gives the text."""
        self.close()
        self._close(0)
        whole = "".join(self.parts)
        said = lambda a, b: " ".join(whole[a:b].split())
        for link in self.links:
            link["text"] = said(link["start"], link["end"])
        self.headings = [h for h in (said(*r) for r in self.headings) if h]
        return whole


_INTS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
_RANGES = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([*_struct("url", "text").fields, *_INTS]))),
        T.StructField("blocks", T.ArrayType(T.StructType([*_INTS, T.StructField("item", T.BooleanType())]))), T.StructField("headings", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_RANGES)
def page_ranges(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """A page's visible text without noise elements, and the ranges in it of its links (absolute addresses) and blocks; its headings of the first four ranks."""
    for html, base in ((piece, base.loc[piece.index]) for part, base in parts for piece in _some(part)):
        rows = []
        for body, own in zip(html, base, strict=True):
            p = _Ranges()
            p.feed(body or "")
            whole = p.finish()
            links = []
            for link in p.links:
                try:
                    url = urljoin(own or "", (link["href"] or "").strip().split("#")[0])
                    ok = link["href"] and urlsplit(url).scheme in ("http", "https")
                except ValueError:
                    ok = False
                if ok:
                    links.append({"url": url, "text": link["text"], "start": link["start"], "end": link["end"]})
            rows.append((whole, links, p.blocks, p.headings))
        yield pd.DataFrame(rows, columns=["text", "links", "blocks", "headings"])
