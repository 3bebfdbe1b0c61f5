"""Readable text and links of HTML pages, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "meta", "link", "noscript")
CONTENT_SELECTORS = ("article", "main", "#content", ".content", ".main-content", "#main", "#primary", ".post-content", ".entry-content")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    __slots__ = ("classes", "ident", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.ident, self.classes = tag, attrs.get("id"), (attrs.get("class") or "").split()
        self.parts: list[_Node | str] = []

    def fits(self, selector: str) -> bool:
        if selector[0] == "#":
            return self.ident == selector[1:]
        return selector[1:] in self.classes if selector[0] == "." else self.tag == selector


class _Tree(HTMLParser):
    """A tree of elements; an end tag closes the nearest open element of its name, and else nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].parts.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _kept(root: _Node):
    """Elements and texts in document order, without what stands in dropped tags."""
    stack = [iter([root])]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        elif isinstance(part, str):
            yield part
        elif part.tag not in DROPPED_TAGS:
            yield part
            stack.append(iter(part.parts))


def readable_text(page: str) -> str:
    """Text of the first element that a content selector fits (selectors in their order), else of the body, else of all."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    root = tree.open[0]
    nodes = [n for n in _kept(root) if isinstance(n, _Node)]
    chosen = next((n for s in (*CONTENT_SELECTORS, "body") for n in nodes if n.fits(s)), root)
    lines = [bare for part in _kept(chosen) if isinstance(part, str) and (bare := part.strip())]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return re.sub(r"^\s+|\s+$", "", text, flags=re.MULTILINE)


def page_text(page: Column) -> Column:
    """``struct<text, mode>`` of a page; a page that can't be parsed is its own text."""

    @F.pandas_udf("text string, mode string")
    def extract(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            try:
                rows.append((readable_text(page or ""), "html"))
            except Exception:  # whatever the parser raises: the page is kept as it is
                rows.append((page, "html_fallback_raw"))
        return pd.DataFrame(rows, columns=["text", "mode"])

    return extract(page)


class _Links(HTMLParser):
    """Anchors with an address, in order; an anchor's text goes to its end tag, to the next anchor (which implies it) or to the page's end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.base: str | None = None
        self.href: str | None = None
        self.parts: list[str] = []

    def _end(self) -> None:
        if self.href is not None:
            self.links.append((self.href, "".join(self.parts).strip()))
        self.href, self.parts = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("a", "base"):
            return
        href = next((v or "" for k, v in attrs if k == "href"), None)  # the first of an attribute counts
        href = None if href is None else href.strip()
        if tag == "base":
            self.base = href if self.base is None else self.base
        else:
            self._end()
            self.href = href

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end()

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.parts.append(data)


def found_links(page: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The page's base address, if it names one, and its links with their texts."""
    parser = _Links()
    parser.feed(page)
    parser.close()
    parser._end()
    return parser.base, parser.links


def page_links(page: Column) -> Column:
    """Links of a page in order: ``array<struct<href, text, base>>``.

    Tags are read by a tokeniser: any case, quoted either way or not at all, character references decoded.  ``base`` is the address that
    relative links of the page start from, where it names one.  A null page, and one that can't be parsed, has no links.
    """

    @F.pandas_udf("array<struct<href string, text string, base string>>")
    def extract(pages: pd.Series) -> pd.Series:
        rows = []
        for page in pages:
            try:
                base, links = found_links(page or "")
                rows.append([{"href": h, "text": t, "base": base} for h, t in links])
            except Exception:  # whatever the parser raises
                rows.append([])
        return pd.Series(rows)

    return extract(page)
