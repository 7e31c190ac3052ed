"""Links and readable text of HTML pages, by the standard parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not for readers (fixed values).
SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template"}
BLOCK = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "pre"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.skipping: list[str] = []
        self.href: str | None = None
        self.anchor: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skipping.append(tag)
        if tag in BLOCK:
            self.parts.append("\n")
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.href, self.anchor = href, []

    def handle_endtag(self, tag):
        if tag in self.skipping:
            while self.skipping.pop() != tag:
                pass
        if tag in BLOCK:
            self.parts.append("\n")
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.anchor).split())))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.anchor.append(data)
        if not self.skipping:
            self.parts.append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def text_of(html: str | None) -> str:
    lines = (" ".join(x.split()) for x in "".join(parse(html).parts).split("\n"))
    return "\n".join(x for x in lines if x)


def links(pages: DataFrame) -> DataFrame:
    """``page_id, position, href, label`` of every link, in page order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, href, label) for i, h in zip(b["page_id"], b["html"], strict=True) for k, (href, label) in enumerate(parse(h).links)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "href", "label"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, href string, label string")


def admitted(found: DataFrame, allow: list[str], deny: list[str]) -> DataFrame:
    """Links under an allowed prefix and no denied one; an address's first place stays."""
    starts = lambda prefixes: F.greatest(F.lit(False), F.lit(False), *(F.col("href").startswith(p) for p in prefixes))
    inside = found.filter(starts(allow) & ~starts(deny))
    return inside.groupBy("page_id", "href").agg(F.min_by("label", "position").alias("label"), F.min("position").alias("position"))


def readable(pages: DataFrame) -> DataFrame:
    """``page_id, text``: what a reader sees, one block a line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": b["html"].map(text_of)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")
