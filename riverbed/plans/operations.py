"""Queries over bookkeeping rules: priorities, budgets, retention, versions, coverage, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions import calendar
from riverbed.operators import entities, graphs, latest, ranks, rules
from riverbed.plans.events import as_of, signals
from riverbed.plans.registry import Tables, query
from riverbed.sources import feeds


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_suppkey % 7 = l_partkey % 7 THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS INTEGER) AS priority FROM lineitem""")
def publisher_priority(t: Tables) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", "first").otherwise("other")
    role = F.when(F.col("l_linestatus") == "F", "report").otherwise("repeat")
    return t.lineitem.select("l_orderkey", "l_linenumber", rules.publisher_priority(tier, F.col("l_suppkey") % 7, F.col("l_partkey") % 7, role).alias("priority"))


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 'o' || (user_id // 3) % 10 ELSE 's' || user_id END AS participant, count(*) AS signals FROM events GROUP BY 1""")
def participants(t: Tables) -> DataFrame:
    owner = F.when(F.col("user_id") % 3 == 0, F.floor(F.col("user_id") / 3) % 10)
    return t.events.groupBy(rules.participant(owner, F.col("user_id")).alias("participant")).agg(F.count(F.lit(1)).alias("signals"))


@query("""WITH a AS (SELECT max(o_orderdate) AS now_ FROM orders)
SELECT o_orderkey FROM orders, a WHERE o_orderdate >= CAST(CAST(now_ + INTERVAL 8 HOUR AS DATE) - INTERVAL 3 MONTH AS TIMESTAMP) - INTERVAL 8 HOUR AND o_orderstatus = 'O'""")
def featured_window(t: Tables) -> DataFrame:
    now = F.lit(t.orders.agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")
    return t.orders.filter((F.col("o_orderdate") >= rules.featured_since(now)) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events) SELECT event_id FROM events, a WHERE (epoch_us(now_) - epoch_us(ts)) / 1e6 / 86400 <= CASE WHEN event_type = 'error' THEN 20 ELSE 10 END""")
def retention(t: Tables) -> DataFrame:
    return rules.retained(t.events.withColumn("failed", F.col("event_type") == "error"), as_of(t), 10, 20).select("event_id")


@query("""WITH d AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value * 1000000) AS BIGINT)) AS BIGINT) AS micros FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
a AS (SELECT CAST(max(ts) AS DATE) AS today FROM events), m AS (SELECT account, sum(micros) AS spent, count(DISTINCT day) AS days FROM d, a WHERE day < today AND day >= today - 7 AND micros > 0 GROUP BY 1),
b AS (SELECT DISTINCT user_id AS account, user_id * 10000000 AS micros, user_id % 11 = 0 AS stale FROM events),
j AS (SELECT b.account, stale, b.micros, CASE WHEN NOT stale THEN b.micros * days / CAST(spent AS DOUBLE) END AS left_ FROM b LEFT JOIN m USING (account))
SELECT account, round(left_, 6) AS days_left, CASE WHEN stale THEN 'stale' WHEN left_ < 3 THEN 'warn' WHEN left_ IS NULL AND micros < 50000000 THEN 'warn' ELSE 'ok' END AS state FROM j""")
def days_left(t: Tables) -> DataFrame:
    daily = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("account"), F.col("ts").cast("date").alias("day")).agg(F.sum(F.floor(F.col("value") * 1000000)).alias("micros"))
    balances = t.events.select(F.col("user_id").alias("account")).distinct().select("account", (F.col("account") * 10000000).alias("micros"), (F.col("account") % 11 == 0).alias("stale"))
    return rules.days_left(daily, balances, as_of(t).cast("date"), floor=50_000_000)


@query("""SELECT o_custkey % 300 AS source, count(*) AS readings, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, bool_and(strftime(o_orderdate, '%H:%M:%S') = '00:00:00') AS midnight,
  count(*) >= 3 AND count(DISTINCT CAST(o_orderdate AS DATE)) >= 2 AND bool_and(strftime(o_orderdate, '%H:%M:%S') = '00:00:00') AS date_only FROM orders GROUP BY 1""")
def midnight_placeholders(t: Tables) -> DataFrame:
    return rules.midnight_placeholders(t.orders.select((F.col("o_custkey") % 300).alias("source"), F.col("o_orderdate").alias("ts")))


@query("""WITH p AS (SELECT event_id, ts AS a, ts + to_minutes(CAST(floor(value) AS BIGINT) * 5) AS b, user_id % 2 = 0 AS ac, event_id % 2 = 0 AS bc FROM events)
SELECT event_id, a = b OR (CAST(a + INTERVAL 8 HOUR AS DATE) = CAST(b + INTERVAL 8 HOUR AS DATE) AND NOT (ac AND bc)) AS agree FROM p""")
def readings_agree(t: Tables) -> DataFrame:
    b = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int") * 5)
    return t.events.select("event_id", rules.readings_agree(F.col("ts"), b, F.col("user_id") % 2 == 0, F.col("event_id") % 2 == 0).alias("agree"))


@query("""WITH a AS (SELECT CAST(max(ts) AS DATE) AS today FROM events), p AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, user_id, value FROM events, a WHERE date_trunc('week', ts) < date_trunc('week', today))
SELECT period, count(*) AS reports, count(DISTINCT user_id) AS sources, CAST(isoyear(period) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(period) AS VARCHAR), 2, '0') AS label FROM p GROUP BY 1""")
def closed_weeks(t: Tables) -> DataFrame:
    period = rules.closed_periods(as_of(t).cast("date"), F.col("ts").cast("date"), "week").alias("period")
    return t.events.select(period, "user_id").filter("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("user_id").alias("sources")).withColumn("label", calendar.week_label(F.col("period")))


@query("""WITH v AS (SELECT conv_id AS doc, turn AS version, role AS lang, turn = 2 AS current, md5(text) AS hash FROM conversations),
n AS (SELECT doc, version AS new, lang, hash FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY current DESC, version DESC) AS r FROM v) WHERE r = 1),
o AS (SELECT n.doc, max(v.version) AS old FROM n JOIN v ON v.doc = n.doc AND v.lang = n.lang AND v.hash <> n.hash AND v.version < n.new GROUP BY 1)
SELECT n.doc, n.new, o.old FROM n LEFT JOIN o USING (doc)""")
def versions_to_compare(t: Tables) -> DataFrame:
    return rules.versions_to_compare(t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("version"), F.col("role").alias("lang"), (F.col("turn") == 2).alias("current"), F.md5("text").alias("hash")))


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events), l AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 + user_id AS fact, event_id AS id FROM events),
r AS (SELECT event_id AS id FROM events, a WHERE ts > now_ - INTERVAL 72 HOUR AND ts <= now_) SELECT fact, id FROM l WHERE fact IN (SELECT fact FROM l JOIN r USING (id))""")
def repair_window(t: Tables) -> DataFrame:
    links = t.events.select((F.get_json_object("props", "$.k").cast("bigint") * 1000 + F.col("user_id")).alias("fact"), F.col("event_id").alias("id"))
    return rules.repair_window(t.events.select(F.col("event_id").alias("id"), "ts"), links, as_of(t)).select("fact", "id")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events), f AS (SELECT user_id, min(ts) AS since FROM events GROUP BY 1),
e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story, user_id, max(ts) AS latest FROM events JOIN f USING (user_id), a WHERE since <= now_ - INTERVAL 48 HOUR AND ts > now_ - INTERVAL 48 HOUR AND ts <= now_ GROUP BY 1, 2)
SELECT story, round(sum(power(0.5, (epoch_us(now_) - epoch_us(latest)) / 1e6 / 86400.0)), 6) AS heat, count(*) AS participants FROM e, a GROUP BY 1""")
def comparable_heat(t: Tables) -> DataFrame:
    since = t.events.groupBy(F.col("user_id").alias("participant")).agg(F.min("ts").alias("since"))
    return rules.cohort_heat(signals(t).join(since, "participant"), as_of(t))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'a' WHEN p_size > 5 THEN 'b' ELSE 'c' END AS tier, CASE WHEN p_size % 2 = 0 THEN 'even' WHEN p_size % 3 = 0 THEN 'third' ELSE 'other' END AS kind,
  floor(least(10.0, greatest(0.0, p_size / 4.0 + k)) * 10 + 0.5) AS u, floor(least(10.0, greatest(0.0, CAST(p_retailprice AS DOUBLE) / 200.0 - k)) * 10 + 0.5) AS v,
  CASE p_size % 7 WHEN 0 THEN 30 WHEN 1 THEN 40 WHEN 2 THEN 55 ELSE 100 END AS cap, p_size % 11 = 0 AS unusable FROM part, range(2) g(k) WHERE k = 0 OR p_size % 4 = 0),
s AS (SELECT p_partkey, tier, CAST(floor(least(CASE kind WHEN 'even' THEN u * 6.0 + v * 4.0 WHEN 'third' THEN u * 3.0 + v * 7.0 END, cap * 10, CASE WHEN unusable THEN 300 ELSE 1000 END) + 0.5) AS BIGINT) AS tenths FROM x WHERE kind <> 'other' UNION ALL SELECT p_partkey, tier, NULL FROM x WHERE kind = 'other')
SELECT p_partkey, tier, CAST(sum(tenths) AS BIGINT) AS tenths, count(tenths) AS votes, coalesce(count(tenths) > 0 AND sum(tenths) >= round(CASE tier WHEN 'a' THEN 60.0 WHEN 'b' THEN 35.5 END * count(tenths) * 10), false) AS selected FROM s GROUP BY 1, 2""")
def attention_score(t: Tables) -> DataFrame:
    size, k = F.col("p_size"), F.col("k")
    votes = t.part.withColumn("k", F.explode(F.when(size % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    noise = F.when(size % 7 == 0, "out_of_scope").when(size % 7 == 1, "price_tick").when(size % 7 == 2, "junior_routine")
    tier = F.when(size > 25, "a").when(size > 5, "b").otherwise("c")
    kind = F.when(size % 2 == 0, "even").when(size % 3 == 0, "third").otherwise("other")
    axes = votes.select("p_partkey", tier.alias("tier"), kind.alias("kind"), (size / 4.0 + k).alias("u"), (F.col("p_retailprice").cast("double") / 200.0 - k).alias("v"), noise.alias("noise"), (size % 11 == 0).alias("unusable"))
    scored = ranks.attention(axes, {"even": {"u": 6, "v": 4}, "third": {"u": 3, "v": 7}})
    return ranks.selected(scored, "p_partkey", {"a": 60.0, "b": 35.5})


@query("""WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS issue, o_custkey % 100 AS story, o_orderkey AS id, o_totalprice / 5000 AS score, o_custkey % 9 AS participants, o_orderpriority = '1-URGENT' AS official, o_orderstatus = 'P' AS follow_up FROM orders),
m AS (SELECT DISTINCT o_custkey % 100 AS story FROM orders WHERE o_orderkey % 97 = 0),
w AS (SELECT *, round(score + 5 * log2(1 + participants) + CASE WHEN official THEN 5 ELSE 0 END - CASE WHEN follow_up THEN 6 ELSE 0 END, 6) AS weight FROM e WHERE follow_up OR story NOT IN (SELECT story FROM m))
SELECT issue, story, id, weight FROM (SELECT *, row_number() OVER (PARTITION BY issue, story ORDER BY weight DESC, id) AS n FROM w) WHERE n = 1""")
def daily_edition(t: Tables) -> DataFrame:
    story = (F.col("o_custkey") % 100).alias("story")
    entries = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("issue"), story, F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 5000).alias("score"), (F.col("o_custkey") % 9).alias("participants"), (F.col("o_orderpriority") == "1-URGENT").alias("official"), (F.col("o_orderstatus") == "P").alias("follow_up"))
    return ranks.edition(entries, t.orders.filter("o_orderkey % 97 = 0").select(story)).select("issue", "story", "id", "weight")


@query("""WITH w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_custkey % 50 AS story, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, max(o_totalprice) AS best, bool_or(o_orderpriority = '1-URGENT') AS lead FROM orders GROUP BY 1, 2)
SELECT period, story, round(best / 5000 + CASE WHEN lead THEN 6 ELSE 3 END + 4 * (days - 1), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY best / 5000 + CASE WHEN lead THEN 6 ELSE 3 END + 4 * (days - 1) DESC, story) AS n FROM w) WHERE n <= 10""")
def period_report(t: Tables) -> DataFrame:
    grouped = t.orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"), (F.col("o_custkey") % 50).alias("story")).agg(F.count_distinct(F.col("o_orderdate").cast("date")).alias("days"), F.max("o_totalprice").alias("best"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("lead"))
    weight = F.col("best") / 5000 + F.when(F.col("lead"), 6).otherwise(3) + 4 * (F.col("days") - 1)
    top = latest.first_per_key(grouped.withColumn("w", weight), ["period"], 10, F.desc("w"), F.asc("story"))
    return top.select("period", "story", F.round("w", 6).alias("weight"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS u, s_suppkey + 1 + s_nationkey % 3 AS v FROM supplier WHERE s_suppkey % 4 > 0), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS reach FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.reach),
n AS (SELECT s_suppkey AS node, CASE WHEN s_acctbal < 0 THEN NULL ELSE DATE '2024-01-01' + CAST(s_suppkey % 90 AS INTEGER) END AS day FROM supplier),
c AS (SELECT n.node, n.day, coalesce((SELECT min(reach) FROM r WHERE r.node = n.node), n.node) AS component FROM n)
SELECT node, component, first_value(node) OVER (PARTITION BY component ORDER BY day IS NULL, day, node) AS thread FROM c""")
def relation_threads(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    edges = t.supplier.filter("s_suppkey % 4 > 0").select(k.alias("u"), (k + 1 + F.col("s_nationkey") % 3).alias("v"))
    days = t.supplier.select(k.alias("node"), F.when(F.col("s_acctbal") >= 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int"))).alias("day"))
    return graphs.threads(edges, days)


@query("""WITH u AS (SELECT 'https://x/p/' || p_partkey AS url, 0 AS kind FROM part WHERE p_size < 20 UNION ALL SELECT 'https://x/p/' || p_partkey, 1 FROM part WHERE p_size < 30)
SELECT url, CAST(min(kind) AS INTEGER) AS kind FROM u GROUP BY 1""")
def sitemap_entries(t: Tables) -> DataFrame:
    part = lambda most: t.part.filter(F.col("p_size") < most).select(F.concat(F.lit("https://x/p/"), F.col("p_partkey")).alias("url"), F.lit(None).cast("date").alias("changed"))
    return feeds.sitemap([part(20), part(30)]).select("url", F.split("file", "-")[0].cast("int").alias("kind"))


@query()
def entity_mentions(t: Tables) -> DataFrame:
    names = t.nation.select(F.lower("n_name").alias("name"), F.col("n_name").alias("entity")).unionByName(t.spark.createDataFrame([("the", "THE"), ("of the", None), ("was", "WAS")], "name string, entity string"))
    return entities.link(t.documents, names)


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events)
SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS clients, min(ts) AS first_at, max(ts) AS last_at FROM events, a WHERE ts > now_ - INTERVAL 7 DAY GROUP BY 1""")
def feedback_week(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") > calendar.shift(as_of(t), -168)).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("clients"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""WITH ids AS (SELECT s_suppkey FROM supplier), a AS (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
c AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT s_suppkey, coalesce(lines, 0) AS lines, coalesce(orders, 0) AS orders, coalesce(parts, 0) AS parts, coalesce(lines, 0) + coalesce(orders, 0) AS total FROM ids LEFT JOIN a ON a.l_suppkey = s_suppkey LEFT JOIN b ON b.l_suppkey = s_suppkey LEFT JOIN c ON c.l_suppkey = s_suppkey""")
def target_evidence(t: Tables) -> DataFrame:
    # one pass over the lines instead of one for each count
    line = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(F.when(F.col("l_returnflag") == "N", F.col("l_orderkey"))).alias("orders"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("parts"))
    return t.supplier.select("s_suppkey").join(line, "s_suppkey", "left").na.fill(0).withColumn("total", F.col("lines") + F.col("orders"))


@query("""WITH c AS (SELECT o_custkey AS anchor, o_orderkey AS other, round(o_totalprice / 500000, 6) AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS n FROM c WHERE score >= 0.25) SELECT anchor, max(score) AS best, count(*) AS candidates, arg_max(other, score) AS top FROM r WHERE n <= 10 GROUP BY 1""")
def group_candidates(t: Tables) -> DataFrame:
    scored = t.orders.select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("other"), F.round(F.col("o_totalprice") / 500000, 6).alias("score")).filter("score >= 0.25")
    top = latest.first_per_key(scored, ["anchor"], 10, F.desc("score"), F.asc("other"))
    return top.groupBy("anchor").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("candidates"), F.max_by("other", F.struct("score", -F.col("other"))).alias("top"))


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority AS old FROM orders), m AS (SELECT '1-URGENT' AS old, 'top' AS new UNION ALL SELECT '2-HIGH', 'top' UNION ALL SELECT '5-LOW', 'rest'),
j AS (SELECT o_orderkey, d.old, m.new FROM d LEFT JOIN m USING (old)) SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'current' WHEN new IS NOT NULL THEN 'mapped' WHEN o_orderkey % 3 = 0 THEN 'model' ELSE 'none' END AS plan, count(*) AS n FROM j GROUP BY 1""")
def category_migration(t: Tables) -> DataFrame:
    mapped = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")
    plan = rules.first_match((F.col("o_orderkey") % 50 == 0, "current"), (mapped, "mapped"), (F.col("o_orderkey") % 3 == 0, "model"), otherwise="none")
    return t.orders.groupBy(plan.alias("plan")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT event_id, user_id, ts, value > 250 AS strong FROM events WHERE event_type = 'click'), l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM c)
SELECT user_id, count(*) AS bursts, sum(CASE WHEN strong THEN 1 ELSE 0 END)::BIGINT AS strong FROM l WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR GROUP BY 1""")
def burst_starts(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    clicks = t.events.filter("event_type = 'click'").withColumn("before", F.lag("ts").over(w))
    starts = clicks.filter(F.col("before").isNull() | (calendar.seconds_between(F.col("before"), F.col("ts")) > 6 * 3600))
    return starts.groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.count_if(F.col("value") > 250).alias("strong"))
