"""Queries over phrases of texts and over price sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators import phrases
from riverbed.plans.registry import Tables, query
from riverbed.sources import prices
from riverbed.sources.shared import shared_dir


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), p AS (SELECT doc_id AS phrase, w[1:3] AS words FROM d WHERE doc_id % 20 = 0 AND len(w) > 0),
h AS (SELECT phrase, doc_id, len(list_filter(range(1, len(w) - len(words) + 2), lambda i: w[i:i + len(words) - 1] = words)) AS n FROM p JOIN d ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(words, ' ') || ' '))
SELECT phrase, count(*) AS documents, CAST(sum(n) AS BIGINT) AS places, min(doc_id) AS first FROM h GROUP BY 1""")
def phrase_search(t: Tables) -> DataFrame:
    """The first three words of every twentieth document, in all documents."""
    path = f"{shared_dir(t.spark)}/riverbed-phrases-{uuid.uuid4().hex}"
    phrases.build(t.documents.select(F.col("doc_id").alias("doc"), "text"), path)
    first = F.array_join(F.slice(phrases.terms(F.col("text")), 1, 3), " ")
    asked = t.documents.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("phrase"), first.alias("text"))
    # documents that begin alike ask for one phrase, which is searched and counted once
    found = phrases.search(phrases.load(t.spark, path), asked.select(F.col("text").alias("phrase"), "text").distinct())
    counts = found.groupBy(F.col("phrase").alias("text"), "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("text").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("places"), F.min("doc").alias("first"))
    return asked.join(counts, "text").select("phrase", "documents", "places", "first")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS page, 'Part ' || l_partkey AS name, 'box' AS unit, l_suppkey || '001' AS value, l_orderkey % 5 = 0 AS held FROM lineitem""")
def table_prices(t: Tables) -> DataFrame:
    """An order's lines as a page's price table, its unit spanning all rows, repeated once; every fifth copy has another last row."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x, k: F.concat(F.lit("<tr><td>"), F.format_string("Part %d", x["l_partkey"]), F.when(k == 0, "</td><td rowspan=0>box").otherwise(""), F.format_string("</td><td>%d,001</td></tr>", x["l_suppkey"])))
    head = "<table><tr><th>Name<th>Unit</th><th>Price <b>now</b></th></tr>"
    body = t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(rows, "").alias("rows"))
    more = F.when(F.col("page") % 5 == 0, "<tr><td>More</td></tr>").otherwise("")
    pages = body.select("page", F.concat(F.lit("<p>x<table><tr><td>Other</td></tr></table>" + head), "rows", F.lit("</table>" + head), "rows", more, F.lit("</table>")).alias("html"))
    return prices.table_prices(pages, ["Name", "Unit", "Price now"])


@query("""SELECT o_custkey AS file, CAST(o_orderdate AS DATE) - 1 AS fixing, CAST(o_orderkey AS VARCHAR) AS code, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '.50' END AS value,
nullif(concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN 'buy and sell differ' END, CASE WHEN o_orderkey % 7 = 0 THEN 'not a decimal with a comma' END), '') AS held FROM orders""")
def xml_fixings(t: Tables) -> DataFrame:
    """A customer's orders as the records of a file of fixings."""
    buy = F.concat(F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(",50"))
    sell = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise(""), buy)
    record = F.concat(F.lit('<Record Date="'), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit('" Code="'), F.col("o_orderkey").cast("string"), F.lit('"><Buy>'), buy, F.lit("</Buy><Sell>"), sell, F.lit("</Sell></Record>"))
    files = t.orders.groupBy(F.col("o_custkey").alias("file")).agg(F.concat(F.lit('<Metall FromDate="x">'), F.array_join(F.collect_list(record), ""), F.lit("</Metall>")).alias("xml"))
    return prices.fixings(files)
