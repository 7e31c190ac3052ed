"""Queries over items as a reader meets them, and over the events that group them.

The fixture tables have no such columns; lengths, languages, sources, labels and prices
stand in for them so that every branch of a rule has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators import grouping, items
from riverbed.plans.registry import Tables, query

NOW = "2024-01-02 00:00:00"
_ITEMS = f"""i AS (SELECT d.doc_id AS id, d.source, d.lang, d.text, CASE WHEN n_chars < 200 THEN 'hidden' ELSE 'public' END AS visibility, d.source LIKE 'src1%' AS is_original_post,
  CASE d.lang WHEN 'en' THEN false WHEN 'de' THEN true END AS admission_required, coalesce(quality, 0) = 1 AS selected, n_chars > 800 AS candidate, coalesce(toxic, 0) = 0 AS eligible,
  CASE WHEN quality IS NULL THEN NULL ELSE n_chars % 100 END AS score, TIMESTAMP '2024-01-01' + to_minutes(CAST(n_chars % 2880 AS BIGINT)) AS visible_after, TIMESTAMP '{NOW}' AS now_,
  d.source IN ('src0', 'src5') AS first_party, CASE WHEN d.source < 'src3' THEN 'news' ELSE 'policy' END AS channel, CASE d.lang WHEN 'en' THEN 'market' WHEN 'de' THEN 'old_market' WHEN 'fr' THEN 'project' ELSE 'split' END AS category,
  [d.source, d.lang] AS tags, TIMESTAMP '2023-08-01' + to_hours(CAST(n_chars % 4000 AS BIGINT)) AS timeline_at FROM documents d LEFT JOIN labels USING (doc_id)),
admitted AS (SELECT *, NOT is_original_post OR coalesce(admission_required = false, false) AS open FROM i)"""


def rows(t: Tables) -> DataFrame:
    n, later = F.col("n_chars"), lambda day, n: F.lit(day).cast("timestamp_ntz") + n
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "source", "lang", "text", F.when(n < 200, "hidden").otherwise("public").alias("visibility"), F.col("source").startswith("src1").alias("is_original_post"),
        F.when(F.col("lang") == "en", False).when(F.col("lang") == "de", True).alias("admission_required"), (F.coalesce("quality", F.lit(0)) == 1).alias("selected"), (n > 800).alias("candidate"), (F.coalesce("toxic", F.lit(0)) == 0).alias("eligible"),
        F.when(F.col("quality").isNotNull(), n % 100).alias("score"), later("2024-01-01", F.make_dt_interval(mins=(n % 2880).cast("int"))).alias("visible_after"),
        F.col("source").isin("src0", "src5").alias("first_party"), F.when(F.col("source") < "src3", "news").otherwise("policy").alias("channel"), F.when(F.col("lang") == "en", "market").when(F.col("lang") == "de", "old_market").when(F.col("lang") == "fr", "project").otherwise("split").alias("category"),
        F.array("source", "lang").alias("tags"), later("2023-08-01", F.make_dt_interval(hours=(n % 4000).cast("int"))).alias("timeline_at"),
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {_ITEMS} SELECT id FROM admitted WHERE visibility = 'public' AND open AND (NOT selected OR visible_after <= now_)")
def listed_items(t: Tables) -> DataFrame:
    return rows(t).filter(items.listed(now())).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM admitted WHERE visibility = 'public' AND open AND eligible AND selected AND candidate AND visible_after <= now_")
def selected_items(t: Tables) -> DataFrame:
    return rows(t).filter(items.chosen(now())).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM admitted WHERE visibility = 'public' AND open AND eligible AND selected AND candidate AND visible_after <= now_ AND timeline_at >= TIMESTAMP '2023-10-01 16:00:00'")
def featured_items(t: Tables) -> DataFrame:
    return rows(t).filter(items.featured(now())).select("id")


@query(f"WITH {_ITEMS} SELECT id, score FROM admitted WHERE visibility = 'public' AND open AND (NOT selected OR visible_after <= now_) AND (score IS NULL OR score >= 20 OR (selected AND candidate))")
def browse_floor(t: Tables) -> DataFrame:
    return rows(t).filter(items.listed(now()) & items.above_floor()).select("id", "score")


@query(f"WITH {_ITEMS} SELECT 'all' AS channel, count(*) AS n FROM i UNION ALL SELECT 'firstParty', count(*) FROM i WHERE first_party UNION ALL SELECT 'policy', count(*) FROM i WHERE channel = 'policy'")
def channel_filter(t: Tables) -> DataFrame:
    count = lambda c: rows(t).filter(items.in_channel(c)).agg(F.lit(c).alias("channel"), F.count(F.lit(1)).alias("n"))
    return count("all").unionByName(count("firstParty")).unionByName(count("policy"))


@query(f"WITH {_ITEMS} SELECT 'market' AS asked, id FROM i WHERE category IN ('market', 'old_market') UNION ALL SELECT 'split', id FROM i WHERE category IN ('split', 'market', 'project')")
def category_filter(t: Tables) -> DataFrame:
    covers = {"old_market": ["market"], "split": ["market", "project"]}
    found = lambda c: rows(t).filter(items.in_category(c, covers)).select(F.lit(c).alias("asked"), "id")
    return found("market").unionByName(found("split"))


@query(f"WITH {_ITEMS} SELECT 'both' AS asked, count(*) AS n FROM i WHERE timeline_at >= TIMESTAMP '2023-09-01' AND timeline_at < TIMESTAMP '2023-10-01' UNION ALL SELECT 'end', count(*) FROM i WHERE timeline_at < TIMESTAMP '2023-10-01' UNION ALL SELECT 'none', count(*) FROM i")
def optional_bounds(t: Tables) -> DataFrame:
    count = lambda name, a, b: rows(t).filter(items.between_days(a, b)).agg(F.lit(name).alias("asked"), F.count(F.lit(1)).alias("n"))
    return count("both", "2023-09-01", "2023-10-01").unionByName(count("end", None, "2023-10-01")).unionByName(count("none", None, None))


@query(f"WITH {_ITEMS} SELECT id FROM i WHERE list_has_any(tags, ['src3', 'fr']) OR contains(lower(text), 'tion')")
def tag_or_text(t: Tables) -> DataFrame:
    return rows(t).filter(items.tagged(["src3", "fr"], F.contains(F.lower("text"), F.lit("tion")))).select("id")


@query(f"WITH {_ITEMS} SELECT id FROM i WHERE list_contains(tags, 'src4')")
def array_containment(t: Tables) -> DataFrame:
    return rows(t).filter(items.holds("tags", "src4")).select("id")


@query("""WITH g AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 0 THEN 'partial' WHEN quality = 1 AND n_chars > 2000 THEN 'unknown' WHEN quality = 1 THEN 'known' END AS state, CASE WHEN quality = 1 THEN [lang] END AS jurisdictions FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'unknown' AS asked, id FROM g WHERE state IS NULL OR state IN ('unknown', 'partial') UNION ALL SELECT 'none', id FROM g WHERE state = 'none' UNION ALL SELECT 'fr', id FROM g WHERE list_has_any(jurisdictions, ['fr', 'de'])""")
def geography_filter(t: Tables) -> DataFrame:
    good = F.col("quality") == 1
    state = F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 0, "partial").when(good & (F.col("n_chars") > 2000), "unknown").when(good, "known")
    g = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), state.alias("state"), F.when(good, F.array("lang")).alias("jurisdictions"))
    found = lambda c: g.filter(items.located(c, ["fr", "de"])).select(F.lit(c).alias("asked"), "id")
    return found("unknown").unionByName(found("none")).unionByName(found("fr"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])the', 'i')""")
def body_word_start(t: Tables) -> DataFrame:
    return t.documents.filter(items.word_start(F.col("text"), "the")).select("doc_id")


@query("""WITH c AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS title, CAST(o_custkey AS VARCHAR) AS hay, [o_orderstatus] AS cats FROM orders)
SELECT id, list_has_any(cats, ['P']) OR NOT list_has_any(cats, ['P', 'F', 'O']) OR (NOT contains(title || chr(10) || hay, '7') AND (contains(title, 'urgent') OR contains(title || chr(10) || hay, '0'))) AS dropped FROM c""")
def candidate_noise(t: Tables) -> DataFrame:
    markers = {"deny": ["P"], "allow": ["P", "F", "O"], "keep": ["7"], "drop_title": ["URGENT"], "drop": ["0"]}
    return t.orders.select(F.col("o_orderkey").alias("id"), items.noisy(markers, F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.array("o_orderstatus")).alias("dropped"))


@query("""WITH b AS (SELECT o_orderdate AS sort_at, CASE WHEN o_custkey % 3 > 0 AND o_orderstatus <> 'P' THEN 'f' || o_custkey ELSE 'a' || o_orderkey END AS card FROM orders) SELECT card, min(sort_at) AS anchor, count(*) AS members FROM b GROUP BY 1""")
def fact_cards(t: Tables) -> DataFrame:
    fact = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey"))
    cards = t.orders.select(F.col("o_orderkey").alias("id"), fact.alias("fact_id"), F.col("o_orderdate").alias("sort_at"), "o_orderstatus")
    return items.fact_cards(cards, F.col("o_orderstatus") != "P")


@query(f"""WITH {_ITEMS}, w AS (SELECT 'wide' AS slug, ['en', 'src0'] AS tags UNION ALL SELECT 'narrow', ['src7'] UNION ALL SELECT 'empty', ['nowhere']),
m AS (SELECT slug, id, timeline_at FROM w LEFT JOIN i ON list_has_any(i.tags, w.tags)),
c AS (SELECT slug, count(id) AS total, count(*) FILTER (WHERE timeline_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS recent, max(timeline_at) AS latest FROM m GROUP BY 1)
SELECT slug, total, recent, latest, CAST(greatest(1, ceil(total / 20.0)) AS BIGINT) AS pages, total >= 50 OR (total >= 20 AND recent > 0) AS indexable FROM c""")
def topic_counts(t: Tables) -> DataFrame:
    topics = t.spark.createDataFrame([("wide", ["en", "src0"]), ("narrow", ["src7"]), ("empty", ["nowhere"])], "slug string, tags array<string>")
    return items.topic_counts(rows(t), topics, now())


@query("""WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS issue, o_orderkey AS id, o_custkey % 100 AS story, CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'follow_up' ELSE 'old' END AS freshness, CAST(o_totalprice AS DOUBLE) / 5000 AS importance, o_orderpriority = '1-URGENT' AS follow_up, o_orderpriority = '2-HIGH' AS developed FROM orders),
m AS (SELECT DISTINCT issue, story FROM e WHERE importance > 60),
s AS (SELECT e.*, CASE WHEN freshness = 'old' THEN 2 ELSE 0 END + CASE WHEN m.story IS NOT NULL AND NOT developed THEN 1 ELSE 0 END AS late, importance - CASE WHEN follow_up AND NOT developed THEN 6.0 ELSE 0.0 END AS weight FROM e LEFT JOIN m ON m.issue = e.issue AND m.story = e.story)
SELECT issue, id, CAST(row_number() OVER (PARTITION BY issue ORDER BY late, weight DESC, id) AS INTEGER) AS place FROM s""")
def issue_order(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "follow_up").otherwise("old")
    entries = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("issue"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("story"), status.alias("freshness"), (F.col("o_totalprice").cast("double") / 5000).alias("importance"), (F.col("o_orderpriority") == "1-URGENT").alias("follow_up"), (F.col("o_orderpriority") == "2-HIGH").alias("developed"))
    return items.issue_order(entries, entries.filter("importance > 60")).select("issue", "id", "place")


@query("""WITH b AS (SELECT c_nationkey AS board, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, c_custkey AS story FROM customer),
f AS (SELECT c_custkey AS story, c_mktsegment = 'BUILDING' AS fresh FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT board, rank, b.story, CAST(row_number() OVER (PARTITION BY board ORDER BY CASE WHEN fresh = false THEN 1 ELSE 0 END, rank) AS INTEGER) AS place FROM b LEFT JOIN f ON f.story = b.story""")
def fresh_first(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    board = t.customer.select(F.col("c_nationkey").alias("board"), n.alias("rank"), F.col("c_custkey").alias("story"))
    fresh = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("story"), (F.col("c_mktsegment") == "BUILDING").alias("fresh"))
    return items.fresh_first(board, fresh, "board").select("board", "rank", "story", "place")


@query("""WITH b AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY max(o_totalprice) DESC, o_orderpriority) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, o_orderkey FROM orders JOIN b USING (o_custkey, o_orderpriority) WHERE n <= 2""")
def top_facts(t: Tables) -> DataFrame:
    return items.top_facts(t.orders, "o_custkey", "o_orderpriority", "o_totalprice", 2).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey AS query, l_linenumber AS id, l_partkey AS fact, CAST(l_discount AS DOUBLE) AS score, l_shipdate AS seen, l_quantity = 50 AS same_url, l_quantity = 49 AS same_hash, CASE WHEN l_quantity = 48 THEN l_suppkey % 7 END AS apart_bits, l_quantity = 47 AS certain, l_quantity > 25 AS date_apart FROM lineitem),
q AS (SELECT o_orderkey AS query, CASE WHEN o_orderpriority = '5-LOW' THEN 'late' END AS gate, o_orderstatus <> 'P' AS specific, o_custkey % 5 > 0 AND o_orderpriority <> '4-NOT SPECIFIED' AS has_vector, o_orderstatus = 'F' AS scope_known FROM orders),
l AS (SELECT query, fact FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seen, id, fact) AS n FROM c WHERE same_url) WHERE n = 1), h AS (SELECT query, fact FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seen, id, fact) AS n FROM c WHERE same_hash) WHERE n = 1),
k AS (SELECT query, fact FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY apart_bits, score DESC, id, fact) AS n FROM c WHERE apart_bits IS NOT NULL) WHERE n = 1), s AS (SELECT query, fact FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id, fact) AS n FROM c WHERE certain) WHERE n = 1),
p AS (SELECT query, bool_and(date_apart) AS apart FROM c GROUP BY 1)
SELECT q.query, CASE WHEN gate IS NOT NULL THEN 'not_judged' WHEN l.query IS NOT NULL OR (specific AND h.query IS NOT NULL) OR k.query IS NOT NULL OR s.query IS NOT NULL THEN 'same_fact' WHEN apart OR NOT has_vector THEN 'undecided' WHEN p.query IS NULL AND scope_known THEN 'new_event' ELSE 'undecided' END AS verdict,
  CASE WHEN gate IS NOT NULL THEN gate WHEN l.query IS NOT NULL THEN 'same_url' WHEN specific AND h.query IS NOT NULL THEN 'content_hash' WHEN k.query IS NOT NULL THEN 'fingerprint' WHEN s.query IS NOT NULL THEN 'certain_duplicate' WHEN apart THEN 'date_apart' WHEN NOT has_vector THEN 'vector_missing' WHEN p.query IS NULL THEN 'no_candidate' ELSE 'similar_unsure' END AS rule,
  CASE WHEN gate IS NOT NULL THEN NULL WHEN l.query IS NOT NULL THEN l.fact WHEN specific AND h.query IS NOT NULL THEN h.fact WHEN k.query IS NOT NULL THEN k.fact ELSE s.fact END AS fact
FROM q LEFT JOIN l ON l.query = q.query LEFT JOIN h ON h.query = q.query LEFT JOIN k ON k.query = q.query LEFT JOIN s ON s.query = q.query LEFT JOIN p ON p.query = q.query""")
def event_decision(t: Tables) -> DataFrame:
    n = F.col("l_quantity")
    found = t.lineitem.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("fact"), F.col("l_discount").cast("double").alias("score"), F.col("l_shipdate").alias("at"), (n == 50).alias("same_url"), (n == 49).alias("same_hash"), F.when(n == 48, F.col("l_suppkey") % 7).alias("apart_bits"), (n == 47).alias("certain"), (n > 25).alias("date_apart"))
    asked = t.orders.select(F.col("o_orderkey").alias("query"), F.when(F.col("o_orderpriority") == "5-LOW", "late").alias("gate"), (F.col("o_orderstatus") != "P").alias("specific"), ((F.col("o_custkey") % 5 > 0) & (F.col("o_orderpriority") != "4-NOT SPECIFIED")).alias("has_vector"), (F.col("o_orderstatus") == "F").alias("scope_known"))
    return grouping.decide(asked, found)


@query("""SELECT event_id, unnest(json_keys(props)) AS key FROM events""")
def props_entries(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS counts FROM c GROUP BY 1""")
def json_counts(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n"))))).alias("counts"))


@query("""WITH d AS (SELECT event_type AS path, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2), l AS (SELECT max(day) AS today FROM d)
SELECT path, count(*) AS days, floor(avg(views) * 10 + 0.5) / 10 AS views, floor(avg(visitors) * 10 + 0.5) / 10 AS visitors FROM d, l WHERE day >= today - 7 AND day < today GROUP BY 1""")
def week_average(t: Tables) -> DataFrame:
    from riverbed.functions.calendar import local_day

    days = t.events.groupBy(F.col("event_type").alias("path"), local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("visitors"))
    today = days.agg(F.max("day").alias("today"))  # one row
    week = days.join(F.broadcast(today), F.expr("day >= date_sub(today, 7) and day < today"))
    mean = lambda c: (F.floor(F.avg(c) * 10 + 0.5) / 10).alias(c)
    return week.groupBy("path").agg(F.count(F.lit(1)).alias("days"), mean("views"), mean("visitors"))
