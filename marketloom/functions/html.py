"""Bodies of web pages, with the standard library's parser in Arrow-batched functions.

Null, empty and broken pages give an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Where a generic page keeps its text, best first.
GENERIC = [("id", "ContentBody"), ("tag", "article"), ("tag", "main"), *[("class", c) for c in ("article", "article-content", "content", "post-content", "entry-content", "newsContent", "detail-content")]]


class Node:
    """An element: its tag, attributes and children (elements and texts)."""

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def first(self, kind: str, name: str, tag: str | None = None) -> Node | None:
        fits = {"tag": lambda n: n.tag == name, "id": lambda n: n.attributes.get("id") == name, "class": lambda n: name in (n.attributes.get("class") or "").split()}[kind]
        return next((n for n in self.walk() if n is not self and fits(n) and tag in (None, n.tag)), None)

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                stack += reversed(node.children)

    def text(self, joint: str = "") -> str:
        return joint.join(t for s in self.strings() if (t := s.strip()))


class TreeBuilder(HTMLParser):
    """Open elements are a stack, and elements don't know their parents: without cycles a tree goes with its last use."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag == "br":
            node.children.append("\n")
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def news_body(html: str) -> str:
    node = tree(html).first("id", "ContentBody")
    if node is None:
        return ""
    return "\n\n".join(t for p in node.all("p") if (t := p.text())) or node.text("\n")


def report_body(html: str) -> str:
    root = tree(html)
    node = root.first("class", "blk_container", "div") or root.first("class", "content", "div")
    if node is None:
        return ""
    return "\n\n".join(t for p in node.all("p") if (t := " ".join(p.strings()).strip()))


def generic_body(html: str) -> str:
    root = tree(html)
    for kind, name in GENERIC:
        if node := root.first(kind, name):
            if parts := [t for p in node.all("p", "li") if len(t := p.text(" ")) >= 8]:
                return "\n\n".join(parts[:40])
            if text := node.text("\n"):
                return text[:8000]
    return "\n\n".join([t for p in root.all("p") if len(t := p.text(" ")) >= 20][:40])


def links(html: str) -> list[tuple[str, str]]:
    """(href, text) of a list page's links; junk links are left out and the first of each target is kept."""
    out: dict[str, str] = {}
    for a in tree(html).all("a"):
        href, text = a.attributes.get("href", "").strip(), re.sub(r"\s+", " ", a.text(" ")).strip()
        if href and not href.startswith("#") and text:
            out.setdefault(href, text)
    return list(out.items())


def page_numbers(html: str) -> list[int]:
    """Page numbers that a forum's list page links to."""
    out = []
    for a in tree(html).all("a"):
        href = a.attributes.get("href") or ""
        if "nump" in (a.attributes.get("class") or "").split() or "f_" in href:
            shown = (span.text() if (span := a.first("tag", "span")) else "").strip()
            found = re.search(r"f_(\d+)\.html", href)
            out += [int(x) for x in (found and found[1], shown) if x and re.fullmatch(r"[+-]?\d+", x)]
    return out


def news_rows(html: str) -> list[tuple[str, str, str, str]]:
    """(href, title, snippet, '') of a search page's news."""
    out = []
    for item in [n for n in tree(html).walk() if "news_item" in (n.attributes.get("class") or "").split()]:
        head, body = item.first("class", "news_item_t"), item.first("class", "news_item_c")
        link = head.first("tag", "a") if head else None
        href = (link.attributes.get("href") or "").strip() if link else ""
        if href and href != "#":
            out.append((href, link.text(" "), body.text(" ") if body else "", ""))
    return out


def report_rows(html: str) -> list[tuple[str, str, str, str]]:
    """(href, title, '', date) of a report list's rows."""
    out = []
    for table in [n for n in tree(html).all("table") if "tb_01" in (n.attributes.get("class") or "").split()]:
        for row in table.all("tr"):
            cell = row.first("class", "tal", "td")
            link = cell.first("tag", "a") if cell else None
            href, title = ((link.attributes.get("href") or "").strip(), (link.attributes.get("title") or link.text()).strip()) if link else ("", "")
            cells = row.all("td")
            if href and title:
                out.append((href, title, "", cells[3].text() if len(cells) > 3 else ""))
    return out


def list_rows(kind: str):
    """A column function for news or report list pages: an array of (url, title, snippet, date), as they are written."""
    read = {"news": news_rows, "report": report_rows}[kind]

    @F.pandas_udf("array<struct<url string, title string, snippet string, date string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [dict(zip(("url", "title", "snippet", "date"), r)) for r in read(h)] if h else [])

    return run


def linked_pages():
    """A column function: the page numbers on a forum's list page."""

    @F.pandas_udf("array<int>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: page_numbers(h) if h else [])

    return run


def _column(extract: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: extract(h) if h else "")

    return run


def extractor(kind: str):
    """A column function for news, report or generic pages."""
    return _column({"news": news_body, "report": report_body, "generic": generic_body}[kind])


def link_extractor():
    @F.pandas_udf("array<struct<url string, title string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"url": u, "title": t} for u, t in links(h)] if h else [])

    return run
