"""Queries over copies of reports and issues made of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions import text as text_
from riverbed.operators import edition
from riverbed.plans.documents import _TITLED, titled
from riverbed.plans.registry import Tables, query


@query(rf"""WITH {_TITLED}, k AS (SELECT doc_id AS id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '^[^:]{{1,12}}:\s*', ''), '[\p{{Z}}\p{{P}}\p{{S}}]', '', 'g') AS key, TIMESTAMP '2024-01-01' + to_minutes((doc_id % 500) * 20) AS seen, source = 'src0' AS official FROM d),
g AS (SELECT *, CASE WHEN length(key) >= 8 THEN key END AS k8, CAST(seen + INTERVAL 8 HOUR AS DATE) AS day FROM k)
SELECT id, CASE WHEN k8 IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY k8, day ORDER BY official DESC, seen, id) END AS keeper, CASE WHEN k8 IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY k8, day) END AS copies FROM g""")
def copy_folding(t: Tables) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") % 500).cast("int") * 20)
    return edition.fold_copies(titled(t).select(F.col("doc_id").alias("id"), text_.title_key_udf("title").alias("key"), at.alias("at"), (F.col("source") == "src0").alias("official")))


@query("""WITH e AS (SELECT o_custkey % 50 AS issue, o_orderkey AS id, o_totalprice AS importance, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_custkey % 7 AS source, [o_custkey % 7, o_orderkey % 9] AS sources,
  CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey + 1, o_orderkey + 2, o_orderkey - 1, o_orderkey - 4] ELSE [] END AS mentions, o_orderstatus <> 'F' AS previous, o_orderpriority = '5-LOW' AS commentary, o_orderkey % 5 AS authority FROM orders),
m AS (SELECT issue, id, sources, unnest(mentions) AS mention, unnest(range(len(mentions))) AS pos FROM e), f AS (SELECT * FROM (SELECT m.issue, m.id, m.sources, h.id AS host, row_number() OVER (PARTITION BY m.id ORDER BY h.importance DESC, pos) AS n FROM m JOIN e h ON h.issue = m.issue AND h.id = m.mention AND h.id <> m.id) WHERE n = 1),
a AS (SELECT host AS id, flatten(list(sources)) AS more, count(*) AS folded FROM f GROUP BY 1),
l AS (SELECT e.*, CAST(len(list_distinct(list_concat(sources, coalesce(more, [])))) AS INTEGER) AS n_sources, coalesce(folded, 0) AS folded FROM e LEFT JOIN a USING (id) WHERE id NOT IN (SELECT id FROM f)),
c AS (SELECT *, (NOT previous AND NOT commentary) OR (authority < 3 AND NOT commentary) OR n_sources >= 3 AS earns FROM l), y AS (SELECT *, bool_or(earns) OVER (PARTITION BY issue) AS any_ FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY issue, source ORDER BY rank) AS k FROM y WHERE earns OR NOT any_), w AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY rank) AS place FROM s WHERE k <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY rank) AS place FROM c WHERE id NOT IN (SELECT id FROM w WHERE place <= 12))
SELECT issue, 'main' AS part, CAST(place AS INTEGER) AS place, id, n_sources, folded FROM w WHERE place <= 12 UNION ALL SELECT issue, 'flash', CAST(place AS INTEGER), id, n_sources, folded FROM r WHERE place <= 10""")
def issue_arrangement(t: Tables) -> DataFrame:
    key, issue = F.col("o_orderkey"), F.col("o_custkey") % 50
    none = F.array().cast("array<bigint>")
    entries = t.orders.select(
        issue.alias("issue"),
        key.alias("id"),
        key.alias("story"),
        F.col("o_totalprice").alias("importance"),
        (F.col("o_custkey") % 7).alias("source"),
        F.array(F.col("o_custkey") % 7, key % 9).alias("sources"),
        F.when(key % 3 == 0, F.array(key + 1, key + 2, key - 1, key - 4)).otherwise(none).alias("mentions"),
        (F.col("o_orderstatus") != "F").alias("previous"),
        (F.col("o_orderpriority") == "5-LOW").alias("commentary"),
        (key % 5).alias("authority"),
    )
    # any order without ties serves as a rank
    return edition.arrange(entries.withColumn("rank", F.struct((-F.col("importance")).alias("p"), F.col("id").alias("k"))))
