"""Table functions for SQL: items of a feed, links of a page, provisions of a text.

Each takes one text and gives a row for each thing in it, so that SQL reads it with
``LATERAL``: ``SELECT p.id, l.* FROM pages p, LATERAL html_links(p.html) l``.  A null text has
no rows.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from riverbed.operators import provisions as provisions_
from riverbed.sources.html import parse


class HtmlLinks:
    """``position, href, label`` of a page's links, in page order."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from ((k, href, label) for k, (href, label) in enumerate(parse(html).links))


class Provisions:
    """``place, number, text, sha`` of a structured text's provisions, the head first."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((k, *part) for k, part in enumerate(provisions_.split(text or "")))


class FeedItems:
    """``place, title, url, id, summary, published`` of an RSS, RDF or Atom text's items."""

    NAMES = (("title",), ("link",), ("guid", "id"), ("description", "summary", "content"), ("pubDate", "published", "updated", "dc:date"))

    def eval(self, content: str) -> Iterator[tuple]:
        for k, item in enumerate(re.findall(r"<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>", content or "", re.S)):
            title, url, *rest = (next((v for n in names if (v := self._inner(item, n))), None) for names in self.NAMES)
            if url is None and (href := re.search(r'<link[^>]*\shref="([^"]+)"', item, re.S)):
                url = entities.unescape(href[1])
            yield (k, title, url, *rest)

    @staticmethod
    def _inner(item: str, name: str) -> str | None:
        found = re.search(rf"<{name}(?:\s[^>]*)?>(.*?)</{name}>", item, re.S)
        if not found:
            return None
        raw = re.fullmatch(r"\s*<!\[CDATA\[(.*)\]\]>\s*", found[1], re.S)
        return (raw[1] if raw else entities.unescape(found[1])).strip() or None


def name_function(spark: SparkSession, name: str, rows: Callable[[str], Iterable[tuple]], fields: str) -> None:
    """Name a table function of one text for SQL; ``rows`` gives a text's rows as ``fields`` says.

    Python gets whole batches of texts, and a text's rows come back as one array, which the
    function lays out: several times faster than a call and a message for each row.
    """

    kinds = [tuple(f.split()) for f in fields.split(", ")]

    @F.arrow_udf(f"array<struct<{fields}>>")
    def found(texts: pa.Array) -> pa.Array:
        each = [list(rows(t)) for t in texts.to_pylist()]
        flat = [r for own in each for r in own]
        columns = [pa.array([r[k] for r in flat], pa.int32() if kind == "int" else pa.string()) for k, (_, kind) in enumerate(kinds)]
        ends = pa.array(itertools.accumulate(map(len, each), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, [n for n, _ in kinds]))

    spark.udf.register(f"{name}_rows", found)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(source STRING) RETURNS TABLE({fields}) RETURN SELECT * FROM inline({name}_rows(source))")


def register(spark: SparkSession) -> None:
    """Name the table functions for SQL."""
    spark.udtf.register("html_links", udtf(HtmlLinks, returnType="position int, href string, label string"))
    name_function(spark, "provisions", Provisions().eval, "place int, number string, text string, sha string")
    spark.udtf.register("feed_items", udtf(FeedItems, returnType="place int, title string, url string, id string, summary string, published string"))
