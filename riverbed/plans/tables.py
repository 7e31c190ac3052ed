"""Queries in SQL over the table functions, and over pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions import text as text_
from riverbed.operators import diff as diff_
from riverbed.operators import similarity
from riverbed.plans.registry import Tables, query
from riverbed.sources import tables


def _sql(t: Tables, text: str, **views: DataFrame) -> DataFrame:
    tables.register(t.spark)
    return t.spark.sql(text, **views)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages) SELECT path, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def sql_html_links(t: Tables) -> DataFrame:
    return _sql(t, "SELECT l.href AS path, count(*) AS links, count(DISTINCT p.page_id) AS pages FROM {pages} p, LATERAL html_links(p.html) l WHERE l.href LIKE '/%' GROUP BY 1", pages=t.pages)


@query("""SELECT law, CAST(n AS INTEGER) AS place, CAST(n AS VARCHAR) AS number, 'Article ' || n || ' Part ' || l_partkey || ' of ' || l_suppkey AS text FROM
(SELECT l_orderkey AS law, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""")
def sql_provisions(t: Tables) -> DataFrame:
    """An order's lines as a law's articles."""
    articles = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x, k: F.format_string("Article %d Part %d of %d", k + 1, x["l_partkey"], x["l_suppkey"]))
    laws = t.lineitem.groupBy(F.col("l_orderkey").alias("law")).agg(F.concat(F.lit("The law\n"), F.array_join(articles, "\n")).alias("text"))
    return _sql(t, "SELECT l.law, p.place, p.number, p.text FROM {laws} l, LATERAL provisions(l.text) p WHERE p.number <> 'head'", laws=laws)


@query("""SELECT o_custkey AS feed, 'Order ' || o_orderkey || ' & more' AS title, 'http://x/' || o_orderkey || '?a=1&b=2' AS url, CAST(o_orderkey AS VARCHAR) AS id FROM orders""")
def sql_feed_items(t: Tables) -> DataFrame:
    """A customer's orders as the items of a feed."""
    item = F.format_string("<item><title>Order %d &amp; more</title><link>http://x/%d?a=1&amp;b=2</link><guid>%d</guid></item>", "o_orderkey", "o_orderkey", "o_orderkey")
    feeds = t.orders.groupBy(F.col("o_custkey").alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("content"))
    return _sql(t, "SELECT f.feed, i.title, i.url, i.id FROM {feeds} f, LATERAL feed_items(f.content) i", feeds=feeds)


@query()
def copy_differences(t: Tables) -> DataFrame:
    """Near copies and what differs: no SQL; the tests hold the spans against the texts."""
    texts = t.documents.select("doc_id", "text")
    pairs = similarity.near_fingerprints(texts.select(F.col("doc_id").alias("id"), text_.simhash64_once_udf("text").alias("fp")))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("old")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("new")), "b")
    found = both.withColumn("spans", diff_.diff(F.col("old"), F.col("new")))
    chars = lambda op: F.aggregate(F.filter("spans", lambda s: s["op"] == op), F.lit(0), lambda n, s: n + F.length(s["text"]))
    return found.select("a", "b", F.size("spans").alias("spans"), chars("equal").alias("equal"), chars("delete").alias("deleted"), chars("insert").alias("inserted"))
