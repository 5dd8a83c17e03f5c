"""Article text from fetched web pages.

The HTML is parsed per row in Arrow batches; the routing by domain happens
before, so pages of other domains never reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that have no end tag; elements whose text is not content.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT = frozenset(("script", "style", "template"))


@dataclass
class Node:
    name: str
    classes: str = ""
    parent: Node | None = None
    items: list[Node | str] = field(default_factory=list)

    def nodes(self) -> list[Node]:
        return [i for i in self.items if isinstance(i, Node)]

    def walk(self) -> Iterator[Node]:
        stack = self.nodes()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.nodes()[::-1])

    def pieces(self) -> Iterator[str]:
        stack: list[Node | str] = self.items[::-1]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.name not in _SILENT:
                stack.extend(item.items[::-1])

    def text(self, strip: bool = True) -> str:
        """Concatenated text; with ``strip`` each piece is trimmed first."""
        return "".join(p.strip() if strip else p for p in self.pieces())


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, dict(attrs).get("class") or "", self.open)
        self.open.items.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.items.append(data)


def parse(html: str) -> Node:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


@dataclass(frozen=True)
class BodyRule:
    """Direct children of the first matching container, joined by blank lines.

    The last one is left out when it is a paragraph. A page without the
    container gives the text ``None``, an empty container NULL.
    """

    container: str = "div"
    classes: str | None = "td-post-content tagdiv-type"
    children: tuple[str, ...] = ("p", "h2")

    def extract(self, root: Node) -> str | None:
        body = next(
            (
                n for n in root.walk()
                if n.name == self.container and self.classes in (None, n.classes)
            ),
            None,
        )
        if body is None:
            return "None"
        kept = [n for n in body.nodes() if n.name in self.children]
        if kept and kept[-1].name == "p":
            kept.pop()
        return "\n\n".join(n.text() for n in kept) or None


@dataclass(frozen=True)
class HeadingRule:
    """The paragraph after the first heading whose link text contains a mark."""

    heading: str = "h2"
    css_class: str | None = "wp-block-heading"
    mark: str = "CVE-"

    def extract(self, root: Node) -> str | None:
        for node in root.walk():
            if node.name != self.heading:
                continue
            if self.css_class is not None and self.css_class not in node.classes.split():
                continue
            link = next((n for n in node.walk() if n.name == "a"), None)
            if link is None or self.mark not in link.text(strip=False):
                continue
            siblings = node.parent.nodes()
            after = siblings[next(i for i, n in enumerate(siblings) if n is node) + 1:]
            paragraph = next((n for n in after if n.name == "p"), None)
            return None if paragraph is None else paragraph.text()
        return None


Rule = BodyRule | HeadingRule

# Domain mark in the address -> extraction rule, first match wins.
ROUTES: dict[str, Rule] = {
    "redpacketsecurity.com": HeadingRule(),
    "cybersecuritynews.com": BodyRule(),
}


def page_route(url: Column, routes: dict[str, Rule] = ROUTES) -> Column:
    """The first mark contained in the address, NULL for other pages."""
    marks = list(routes)
    chain = F.when(F.contains(url, F.lit(marks[0])), marks[0])
    for mark in marks[1:]:
        chain = chain.when(F.contains(url, F.lit(mark)), mark)
    return chain


def extract_articles(
    pages: DataFrame, url: str = "url", html: str = "html", routes: dict[str, Rule] = ROUTES,
    out: str = "article_text",
) -> DataFrame:
    """Add the article text by the rule of the page's domain; other pages get NULL."""

    @F.pandas_udf(T.StringType())
    def extract(route: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if r is None or h is None else routes[r].extract(parse(h))
                for r, h in zip(route, page)
            ],
            dtype=object,
        )

    routed = page_route(F.col(url), routes)
    text = extract(routed, F.when(routed.isNotNull(), F.col(html)))
    return pages.withColumn(out, text)
