"""HTML scans: cards in a container and profile pages, over a DataFrame of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements without content, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style noscript svg".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.items) if isinstance(x, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SKIPPED:
                stack += reversed(n.items)
        return " ".join(" ".join(out).split())

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def cards(page: str, container: str, card: str) -> list[tuple[str, str, str]]:
    """(heading, link, first paragraph) of the cards with that class in the container with that id or class; incomplete ones go."""
    box = next((n for n in parse(page).walk() if n.attrs.get("id") == container or container in n.classes()), None)
    out = []
    for n in box.walk() if box else ():
        if card in n.classes():
            parts = list(n.walk())
            head = next((x.text() for x in parts if x.tag in ("h1", "h2", "h3", "h4")), "")
            link = next((x.attrs["href"] for x in parts if x.tag == "a" and x.attrs.get("href")), "")
            para = next((x.text() for x in parts if x.tag == "p"), "")
            if head and link:
                out.append((head, link, para))
    return out


def section(root: Node, phrase: str, limit: int = 2200) -> str:
    """Text of the element around the first heading that holds the phrase, without the heading."""
    for n in root.walk():
        if n.tag in ("h1", "h2", "h3", "h4") and phrase.lower() in n.text().lower() and n.parent:
            return n.parent.text().replace(n.text(), "", 1).strip()[:limit]
    return ""


def profile(page: str, academic: str = "academic") -> tuple[str, str, str, str]:
    """(name, bio, academic section, ORCID link); the bio falls back to the description, then the first paragraph."""
    root = parse(page)
    nodes = list(root.walk())
    name = next((n.text() for n in nodes if n.tag == "h1"), "")
    bio = next((n.text() for n in nodes if n.classes() & {"bio", "biography"} or n.attrs.get("id") in ("bio", "biography")), "")
    bio = bio or next((n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("name") == "description"), "")
    bio = bio or next((n.text() for n in nodes if n.tag == "p" and n.text()), "")
    orcid = next((n.attrs["href"] for n in nodes if n.tag == "a" and "orcid.org/" in n.attrs.get("href", "")), "")
    return name, bio, section(root, academic), orcid


def scan_cards(pages: DataFrame, container: str, card: str) -> DataFrame:
    """url, ordinal, heading, link, paragraph, problem: a page without its container or usable cards is one row with a problem."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"], strict=True):
                found = cards(page or "", container, card)
                rows += [(url, k, *c, None) for k, c in enumerate(found, 1)] or [(url, 0, None, None, None, "no cards")]
            yield pd.DataFrame(rows, columns=["url", "ordinal", "heading", "link", "paragraph", "problem"])
    return pages.select("url", "html").mapInPandas(run, "url string, ordinal int, heading string, link string, paragraph string, problem string")


def scan_profiles(pages: DataFrame) -> DataFrame:
    """url, name, bio, academic, orcid: each url is parsed once."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(u, *profile(p or "")) for u, p in zip(pdf["url"], pdf["html"], strict=True)], columns=["url", "name", "bio", "academic", "orcid"])
    return pages.dropDuplicates(["url"]).select("url", "html").mapInPandas(run, "url string, name string, bio string, academic string, orcid string")


def page_summary(pages: DataFrame) -> DataFrame:
    """page_id, title, h1, first_link, has_nav by expressions alone: for flat tags no parser is needed."""
    pick = lambda p: F.regexp_extract("html", p, 1)
    return pages.select("page_id", pick(r"<title>([^<]*)</title>").alias("title"), pick(r"<h1>([^<]*)</h1>").alias("h1"),
                        pick(r'<a href="([^"]*)"').alias("first_link"), F.contains("html", F.lit("<nav>")).alias("has_nav"))
