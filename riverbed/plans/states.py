"""Queries over states, versions, links and meters: the latest of each key, coverage, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions import text as text_
from riverbed.operators import joins, latest, meters
from riverbed.plans.registry import Tables, query
from riverbed.sources import html


def as_of(t: Tables):
    return F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND ts > now_ - INTERVAL 24 HOUR) AS failures FROM events, a GROUP BY 1)
SELECT r.user_id, event_id, event_type, failures FROM r JOIN f ON f.user_id = r.user_id WHERE n = 1""")
def latest_run(t: Tables) -> DataFrame:
    last = latest.latest_per_key(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    failed = (F.col("event_type") == "error") & (F.col("ts") > as_of(t) - F.expr("interval 24 hours"))
    counts = t.events.groupBy("user_id").agg(F.count_if(failed).alias("failures"))
    return last.join(counts, "user_id").select("user_id", "event_id", "event_type", "failures")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events) SELECT user_id, event_type, max(event_id) AS event_id FROM events, a WHERE ts > now_ - INTERVAL 48 HOUR GROUP BY 1, 2""")
def latest_in_window(t: Tables) -> DataFrame:
    recent = t.events.filter(F.col("ts") > as_of(t) - F.expr("interval 48 hours"))
    return latest.latest_per_key(recent.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.desc("event_id"))


@query("""SELECT l_orderkey AS report, l_partkey AS fact, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_partkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def listed_fact(t: Tables) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "R", "report").otherwise("background")
    links = t.lineitem.select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("fact"), F.col("l_linenumber").alias("line"), role.alias("role"))
    return latest.latest_per_key(links, ["report"], (F.col("role") == "primary").desc(), (F.col("role") == "report").desc(), F.asc("fact"), F.asc("line")).drop("role")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) FILTER (WHERE event_type NOT IN ('view', 'error')) AS last_ok FROM events GROUP BY 1""")
def fetch_health(t: Tables) -> DataFrame:
    waits, failed = F.col("event_type") == "view", F.col("event_type") == "error"  # views stand in for quota waits
    return t.events.groupBy("user_id").agg(F.count_if(~waits).alias("attempts"), F.count_if(failed).alias("failed"), F.max(F.when(~waits & ~failed, F.col("ts"))).alias("last_ok"))


@query("""SELECT source, count(*) FILTER (WHERE n_chars > 500) AS due, count(*) FILTER (WHERE n_chars > 500 AND l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def translation_lag(t: Tables) -> DataFrame:
    due, made = F.col("n_chars") > 500, t.labels.select("doc_id", F.lit(True).alias("made"))
    joined = t.documents.select("doc_id", "source", "n_chars").join(made, "doc_id", "left")
    return joined.groupBy("source").agg(F.count_if(due).alias("due"), F.count_if(due & F.col("made").isNull()).alias("missing"))


_PATHS = """p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages)"""


def _paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1).alias("path"))


@query(f"""WITH {_PATHS} SELECT p.page_id, count(*) AS linked_from FROM p JOIN l ON l.path = p.path WHERE p.path <> '' GROUP BY 1""")
def linked_pages(t: Tables) -> DataFrame:
    found = html.links(t.pages).filter("href like '/%'").select(F.col("page_id").alias("origin"), F.col("href").alias("path")).distinct()
    return _paths(t).filter("path <> ''").join(found, "path").groupBy("page_id").agg(F.count(F.lit(1)).alias("linked_from"))


@query(f"""WITH {_PATHS} SELECT host, count(*) AS pages, count(*) FILTER (WHERE page_id IN (SELECT page_id FROM l)) AS covered FROM p GROUP BY 1""")
def link_coverage(t: Tables) -> DataFrame:
    linking = html.links(t.pages).filter("href like '/%'").select("page_id", F.lit(True).alias("has")).distinct()
    return _paths(t).join(linking, "page_id", "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("has").alias("covered"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def manual_holds(t: Tables) -> DataFrame:
    sets = (t.orders.filter("o_totalprice > 400000").select("o_orderkey"), t.lineitem.filter("l_quantity = 50").select("l_orderkey"), t.orders.filter("o_orderstatus = 'P'").select("o_orderkey"))
    return sets[0].union(sets[1]).union(sets[2]).distinct().withColumnRenamed("o_orderkey", "id")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events) SELECT count(*) FILTER (WHERE user_id = 7) AS by_account, count(*) FILTER (WHERE event_type = 'error') AS by_source, count(*) AS total FROM events, a WHERE ts > now_ - INTERVAL 72 HOUR""")
def attempt_counters(t: Tables) -> DataFrame:
    recent = t.events.filter(F.col("ts") > as_of(t) - F.expr("interval 72 hours"))
    return recent.agg(F.count_if(F.col("user_id") == 7).alias("by_account"), F.count_if(F.col("event_type") == "error").alias("by_source"), F.count(F.lit(1)).alias("total"))


@query("""SELECT doc_id FROM documents WHERE sha256(text) = sha256(trim(lower(text), ' '))""")
def valid_hashes(t: Tables) -> DataFrame:
    stored = t.documents.select("doc_id", F.sha2(F.trim(F.lower("text")), 256).alias("text_hash"))
    return joins.same_version(t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash")), stored, ["doc_id", "text_hash"]).select("doc_id")


@query("""WITH l AS (SELECT o_orderkey AS id, o_orderdate AS revision, nullif(o_orderpriority, '5-LOW') AS analysis FROM orders), r AS (SELECT o_orderkey AS id, o_orderdate AS revision, CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE nullif(o_orderpriority, '5-LOW') END AS analysis, o_totalprice AS reading FROM orders WHERE o_orderstatus <> 'F')
SELECT l.id, reading FROM l LEFT JOIN r ON l.id = r.id AND l.revision = r.revision AND l.analysis IS NOT DISTINCT FROM r.analysis""")
def version_join(t: Tables) -> DataFrame:
    low = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    left = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("revision"), low.alias("analysis"))
    right = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("revision"), F.when(F.col("o_orderstatus") == "P", "other").otherwise(low).alias("analysis"), F.col("o_totalprice").alias("reading"))
    return joins.same_version(left, right, ["id", "revision"], ["analysis"], "left").select("id", "reading")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(substring(coalesce(text, ''), 1, 60)), '[\\p{L}\\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) AS g FROM d),
q AS (SELECT list_distinct(flatten(list_transform(['the', 'station'], lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) AS q),
s AS (SELECT doc_id, round(1 - len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS distance FROM g, q)
SELECT doc_id, distance FROM s ORDER BY distance, doc_id LIMIT 20""")
def trigram_order(t: Tables) -> DataFrame:
    head = t.documents.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("head"))
    return head.select("doc_id", F.round(text_.trigram_distance(F.col("head"), F.lit("the station")), 6).alias("distance")).orderBy("distance", "doc_id").limit(20)


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE WHEN value >= 200 THEN true WHEN value < 160 THEN false END AS said FROM events),
s AS (SELECT user_id, event_id, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS open FROM m) SELECT user_id, event_id, open FROM s""")
def budget_hysteresis(t: Tables) -> DataFrame:
    used = t.events.select("user_id", "event_id", "ts", (F.col("value") / 200).alias("share"))
    return meters.hysteresis(used, "user_id", "share", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "open")


@query("""SELECT l_orderkey, list_aggregate(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey), 'string_agg', ',') AS parts, list(l_partkey ORDER BY l_linenumber, l_partkey)[1] AS first FROM lineitem GROUP BY 1""")
def ordered_parts(t: Tables) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    grouped = t.lineitem.groupBy("l_orderkey").agg(lines.alias("all"))
    return grouped.select("l_orderkey", F.array_join(F.transform("all", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.get("all", F.lit(0))["l_partkey"].alias("first"))


@query("""SELECT l_returnflag AS currency, l_linestatus AS basis, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS VARCHAR) AS cost, count(*) AS calls FROM lineitem GROUP BY 1, 2""")
def exact_cost(t: Tables) -> DataFrame:
    cost = F.sum(F.col("l_extendedprice").cast("decimal(18,4)"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("currency"), F.col("l_linestatus").alias("basis")).agg(cost.cast("string").alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("""WITH a AS (SELECT l_shipdate::DATE AS day, l_partkey AS id, CASE WHEN l_quantity < 3 THEN NULL WHEN l_returnflag = 'A' THEN 'no' WHEN l_returnflag = 'R' THEN 'star' ELSE 'yes' END AS answer, l_orderkey AS o, l_linenumber AS l FROM lineitem),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, id ORDER BY o DESC, l DESC) AS r FROM a) WHERE r = 1 AND answer IS NOT NULL),
c AS (SELECT DISTINCT l_shipdate::DATE AS day, l_partkey AS id, CASE l_partkey % 3 WHEN 0 THEN 'selected' WHEN 1 THEN 'kept' ELSE 'blocked' END AS system FROM lineitem WHERE l_partkey % 7 > 0)
SELECT count(DISTINCT day) AS days, count(*) AS answered, count(*) FILTER (WHERE answer = 'no') AS no, count(*) FILTER (WHERE answer = 'yes') AS yes, count(*) FILTER (WHERE answer = 'star') AS star,
  count(*) FILTER (WHERE answer = 'star' AND system IS DISTINCT FROM 'selected') AS missed, count(*) FILTER (WHERE answer <> 'star' AND system = 'selected') AS extra, count(*) FILTER (WHERE answer <> 'no' AND system = 'blocked') AS widened FROM n LEFT JOIN c USING (day, id)""")
def answer_tally(t: Tables) -> DataFrame:
    keys = [F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").alias("id")]
    said = F.when(F.col("l_quantity") < 3, F.lit(None).cast("string")).when(F.col("l_returnflag") == "A", "no").when(F.col("l_returnflag") == "R", "star").otherwise("yes")
    answers = t.lineitem.select(*keys, said.alias("answer"), "l_orderkey", "l_linenumber")
    part = F.col("l_partkey")
    cards = t.lineitem.filter(part % 7 > 0).select(*keys, F.when(part % 3 == 0, "selected").when(part % 3 == 1, "kept").otherwise("blocked").alias("system")).distinct()
    return meters.tally(answers, cards, ["day", "id"], "day", ["l_orderkey", "l_linenumber"])


@query("""WITH j AS (SELECT l_shipdate::DATE AS day, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'R' AS blocked, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS score, 50.0 AS threshold, l_suppkey % 14 AS gap,
  l_quantity >= 25 AS selected, sha256((l_orderkey * 10 + l_linenumber)::VARCHAR || l_shipdate::DATE::VARCHAR) AS h FROM lineitem),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY gap DESC, h) AS n FROM j WHERE NOT blocked AND score IS NOT NULL AND gap >= 10) WHERE n <= 2),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h) AS n FROM j WHERE blocked) WHERE n <= 3),
ne AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY abs(score - threshold), h) AS n FROM j WHERE NOT blocked AND score IS NOT NULL AND id NOT IN (SELECT id FROM sp)),
tk AS (SELECT day, count(*) AS k FROM (SELECT day FROM sp UNION ALL SELECT day FROM bl) GROUP BY 1),
al AS (SELECT day, id, h, 'split' AS kind, CASE WHEN selected THEN 'selected' ELSE 'kept' END AS system FROM sp UNION ALL SELECT day, id, h, 'blocked', 'blocked' FROM bl
  UNION ALL SELECT ne.day, id, h, CASE WHEN selected THEN 'near_pass' ELSE 'near_miss' END, CASE WHEN selected THEN 'selected' ELSE 'kept' END FROM ne LEFT JOIN tk USING (day) WHERE n <= 8 - coalesce(k, 0))
SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY h) AS INTEGER) AS place, id, kind, system FROM al""")
def review_deck(t: Tables) -> DataFrame:
    day, line = F.col("l_shipdate").cast("date"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    judged = t.lineitem.select(day.alias("day"), line.alias("id"), (F.col("l_returnflag") == "R").alias("blocked"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2).alias("score"), F.lit(50.0).alias("threshold"), (F.col("l_suppkey") % 14).alias("gap"), (F.col("l_quantity") >= 25).alias("selected"))
    return latest.stratified_deck(judged, seats=8, split=2, blocked=3, seed=F.col("day").cast("string"))
