"""Feed and list sources, feed and sitemap sinks."""

from __future__ import annotations

import functools
import html
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text longer than FULL_CHARS is an article; one with a teaser's mark below TEASER_CHARS is not (fixed values).
FULL_CHARS, TEASER_CHARS = 280, 1200
#: What a teaser says, and how one ends where it breaks off (fixed values).
TEASER_PHRASES = ("appeared first on", "read full story", "read the full story", "read full article", "read the full article", "continue reading", "read more")
TEASER_ENDS = ("…", "[…]", "[...]")


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references (named and numbered) as the characters they stand for."""
    return text.map(html.unescape, na_action="ignore")


def feed_items(files: DataFrame, content: str = "content") -> DataFrame:
    """RSS 2.0, RDF and Atom items of whole feed texts: ``source, title, url, id, summary, published``.

    ``files``: source and the feed's text.  Items are cut out by the feed's own tags, so a
    broken item is a row of nulls, not a failed feed.  Character references are resolved,
    but for those inside CDATA, which stands as written.
    """
    rows = files.select("source", F.explode(F.regexp_extract_all(F.col(content), F.lit(r"(?s)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"), F.lit(0))).alias("xml"))
    cdata = r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$"

    def tag(*names: str) -> Column:
        inner = [F.regexp_extract("xml", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1) for n in names]
        return F.coalesce(*(F.nullif(F.trim(F.when(x.rlike(cdata), F.regexp_extract(x, cdata, 1)).otherwise(unescaped(x))), F.lit("")) for x in inner))

    href = F.nullif(unescaped(F.regexp_extract("xml", r'(?s)<link[^>]*\shref="([^"]+)"', 1)), F.lit(""))
    return rows.select("source", tag("title").alias("title"), F.coalesce(tag("link"), href).alias("url"), tag("guid", "id").alias("id"), tag("description", "summary", "content").alias("summary"), tag("pubDate", "published", "updated", "dc:date").alias("published"))


def is_teaser(text: Column) -> Column:
    """Whether a text is short and ends or speaks like one that only leads to an article."""
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "), F.lit(" "))
    says = functools.reduce(Column.__or__, (F.contains(words, F.lit(f" {p} ")) for p in TEASER_PHRASES))
    closed = F.regexp_replace(text, r"\s", "")
    breaks = functools.reduce(Column.__or__, (F.endswith(closed, F.lit(e)) for e in TEASER_ENDS))
    return (F.length(F.trim(text)) < TEASER_CHARS) & (says | breaks)


def text_kind(text: Column, editorial: Column | None = None) -> Column:
    """``teaser`` for an editorial source's teaser, else ``body`` over 280 characters, else ``short``; null is short."""
    teaser = is_teaser(text) & (F.lit(True) if editorial is None else editorial)
    return F.when(teaser, "teaser").when(F.length(text) > FULL_CHARS, "body").otherwise("short")


def json_path(doc: Column, path: str) -> Column:
    """A dotted path with array places, as text: ``a.b[0].c``."""
    return F.get_json_object(doc, f"$.{path}")


def json_list(docs: DataFrame, items_path: str, fields: dict[str, str], column: str = "json") -> DataFrame:
    """One row for each element of the list at ``items_path``, its fields by path."""
    items = F.from_json(json_path(F.col(column), items_path), "array<string>")
    rows = docs.withColumn("_item", F.explode(items)).drop(column)
    return rows.select(*[c for c in docs.columns if c != column], *(json_path(F.col("_item"), p).alias(n) for n, p in fields.items()))


def template(parts: list[str | Column]) -> Column:
    """Fixed text and fields joined; null if any field is missing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def newest(items: DataFrame, feed: str, size: int = 50) -> DataFrame:
    """The newest items of each feed."""
    n = F.row_number().over(Window.partitionBy(feed).orderBy(F.desc("published"), F.asc("id")))
    return items.withColumn("place", n).filter(F.col("place") <= size)


def rss(title: str, items: DataFrame) -> str:
    """An RSS text of one feed's newest items (50 rows at most)."""
    rows = items.orderBy("place").limit(50).collect()
    body = "".join(f"<item><title>{escape(r.title or '')}</title><link>{escape(r.url or '')}</link><guid>{escape(str(r.id))}</guid><pubDate>{r.published}</pubDate></item>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title>{body}</channel></rss>'


def sitemap(kinds: list[DataFrame], capacity: int = 50_000) -> DataFrame:
    """Addresses of all kinds of page, first kind first, in files of fixed size.

    ``kinds``: url, changed.  An address that two kinds hold stays with the first.
    """
    both = None
    for k, df in enumerate(kinds):
        part = df.select("url", "changed", F.lit(k).alias("kind"))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy("url").agg(F.min(F.struct("kind", "changed")).alias("f")).select("url", "f.kind", "f.changed")
    # a hash of the address deals the files out, so no task has to number all rows
    n = F.row_number().over(Window.partitionBy("kind", "shard").orderBy("url")) - 1
    total = once.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / capacity).alias("shards"))
    return once.join(F.broadcast(total), "kind").withColumn("shard", F.pmod(F.xxhash64("url"), F.col("shards"))).withColumn("file", F.concat_ws("-", "kind", "shard", F.floor(n / capacity))).select("file", "url", "changed")


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite the partitions that the rows belong to and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_log(df: DataFrame, path: str, *keys: str) -> None:
    """Add rows to a log; nothing that stands there is changed."""
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
