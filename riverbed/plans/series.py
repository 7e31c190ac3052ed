"""Queries over versioned price series and dated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators import joins, ranks, series
from riverbed.plans.registry import Tables, query


def prices(t: Tables) -> DataFrame:
    """Parts as series, order months as periods, order lines as fetched versions."""
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select((F.col("l_partkey") % 200).alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).cast("decimal(18,2)").alias("value"), F.col("l_shipdate").alias("first_fetched"), F.col("o_orderdate").alias("released"), F.format_string("%012d-%d-%09d", "l_orderkey", "l_linenumber", "l_partkey").alias("label"))


_PRICES = """p AS (SELECT l_partkey % 200 AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(floor(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(18,2)) AS value,
  l_shipdate AS first_fetched, o_orderdate AS released, printf('%012d-%d-%09d', l_orderkey, l_linenumber, l_partkey) AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, period ORDER BY first_fetched DESC, released DESC NULLS LAST, label DESC) AS n FROM p) WHERE n = 1)"""


@query(f"""WITH {_PRICES} SELECT series, period, value, label FROM v""")
def price_versions(t: Tables) -> DataFrame:
    return series.current_versions(prices(t)).select("series", "period", "value", "label")


@query(f"""WITH {_PRICES}, c AS (SELECT series, period, value, lag(period) OVER w AS previous_period, lag(value) OVER w AS previous, lead(period) OVER w AS next_period FROM v WINDOW w AS (PARTITION BY series ORDER BY period))
SELECT series, period, value, previous_period, previous, next_period, CASE WHEN previous > 0 THEN CAST(round(CAST((value - previous) * 100 AS DOUBLE) / CAST(previous AS DOUBLE), 6) AS DECIMAL(18,6)) END AS change FROM c""")
def period_change(t: Tables) -> DataFrame:
    found = series.with_previous(series.current_versions(prices(t)))
    exact = F.when(F.col("previous") > 0, F.round(((F.col("value") - F.col("previous")) * 100).cast("double") / F.col("previous").cast("double"), 6).cast("decimal(18,6)"))
    return found.select("series", "period", "value", "previous_period", "previous", "next_period", exact.alias("change"))


@query("""WITH l AS (SELECT o_orderkey, o_custkey % 50 AS currency, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT o_custkey % 50 AS currency, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS rate FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2),
j AS (SELECT l.*, r.day AS asof_day, r.rate, row_number() OVER (PARTITION BY l.o_orderkey ORDER BY r.day DESC) AS n FROM l LEFT JOIN r ON r.currency = l.currency AND r.day <= l.day AND r.day >= l.day - 10)
SELECT o_orderkey, currency, day, asof_day, rate FROM j WHERE n = 1""")
def asof_backward(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date").alias("day")
    left = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_custkey") % 50).alias("currency"), day)
    right = t.orders.filter("o_orderpriority = '5-LOW'").groupBy((F.col("o_custkey") % 50).alias("currency"), day).agg(F.max("o_totalprice").alias("rate"))
    return joins.asof_backward(left, right, ["currency"], "day", "day", 10, ["rate"])


@query("""WITH s AS (SELECT o_orderkey, o_custkey % 100 AS k, o_orderdate AS lo, o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS hi FROM orders WHERE o_orderpriority = '2-HIGH'),
e AS (SELECT l_orderkey, l_linenumber, l_suppkey % 100 AS k, l_shipdate AS seen_at FROM lineitem WHERE l_quantity = 1)
SELECT o_orderkey, l_orderkey, l_linenumber, seen_at FROM s JOIN e USING (k) WHERE seen_at > lo AND seen_at <= hi""")
def interval_join(t: Tables) -> DataFrame:
    spans = t.orders.filter("o_orderpriority = '2-HIGH'").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 20).cast("int"))).alias("hi"))
    points = t.lineitem.filter("l_quantity = 1").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("k"), F.col("l_shipdate").alias("seen_at"))
    return joins.in_interval(points, spans, ["k"], "seen_at", "lo", "hi", 10 * 86400).select("o_orderkey", "l_orderkey", "l_linenumber", "seen_at")


@query()
def price_plausibility(t: Tables) -> DataFrame:
    """Each source publishes ten series once a month."""
    versions = series.current_versions(prices(t)).withColumn("source", F.col("series") % 20)
    return series.plausibility(versions, "month")


_REPORTS = """r AS (SELECT l_orderkey AS id, l_linenumber AS line, o_orderdate AS reported, CASE WHEN l_linenumber = 6 THEN o_orderdate - to_hours(CAST(l_quantity AS INTEGER) + 24) END AS recollected_from,
  CASE WHEN l_returnflag = 'A' THEN CAST(o_orderdate AS DATE) - CAST(l_suppkey % 9 AS INTEGER) END AS own_day, CASE WHEN l_linestatus = 'F' THEN CAST(o_orderdate AS DATE) - CAST(l_suppkey % 10 AS INTEGER) END AS fact_day,
  CASE l_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'agreed' ELSE 'single' END AS fact_basis, CASE WHEN l_linenumber <> 5 THEN o_orderdate - to_hours(CAST(l_partkey % 120 AS INTEGER)) END AS first_reported,
  o_orderdate - to_hours(CAST(l_partkey % 120 + l_suppkey % 13 AS INTEGER)) AS story_reported, o_orderdate - to_hours(2) AS listed_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
q AS (SELECT *, coalesce(own_day, CASE WHEN fact_basis IN ('verified', 'agreed') THEN fact_day END) AS day, CAST(reported + INTERVAL 8 HOUR AS DATE) AS reported_day FROM r),
f AS (SELECT *, CASE WHEN recollected_from IS NOT NULL AND reported - recollected_from >= INTERVAL 48 HOUR THEN 'recollected' WHEN day IS NULL AND reported - first_reported > INTERVAL 72 HOUR THEN 'late_report' WHEN own_day IS NOT NULL THEN 'own_date' WHEN day IS NOT NULL THEN 'fact_date' ELSE 'no_evidence' END AS basis FROM q),
g AS (SELECT *, CASE WHEN basis IN ('recollected', 'late_report') OR date_diff('day', day, reported_day) > 4 THEN 'old' WHEN first_reported - story_reported > INTERVAL 6 HOUR THEN 'follow_up' ELSE 'new' END AS freshness, CASE WHEN basis <> 'recollected' THEN day END AS occurred_on FROM f),
h AS (SELECT *, CASE WHEN freshness = 'old' THEN least(listed_at, CASE WHEN basis = 'recollected' THEN recollected_from WHEN occurred_on IS NOT NULL THEN CAST(occurred_on AS TIMESTAMP) - INTERVAL 8 HOUR WHEN basis = 'late_report' THEN first_reported END) END AS rank_anchor FROM g)"""


def reports(t: Tables) -> DataFrame:
    """Order lines as reports, with days and hours on both sides of every threshold."""
    back = lambda hours: F.col("o_orderdate") - F.make_dt_interval(hours=hours.cast("int"))
    day = lambda n: F.date_sub(F.col("o_orderdate").cast("date"), n.cast("int"))
    basis = F.when(F.col("l_suppkey") % 3 == 0, "verified").when(F.col("l_suppkey") % 3 == 1, "agreed").otherwise("single")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").alias("reported"),
        F.when(F.col("l_linenumber") == 6, back(F.col("l_quantity").cast("int") + 24)).alias("recollected_from"),
        F.when(F.col("l_returnflag") == "A", day(F.col("l_suppkey") % 9)).alias("own_day"), F.when(F.col("l_linestatus") == "F", day(F.col("l_suppkey") % 10)).alias("fact_day"), basis.alias("fact_basis"),
        F.when(F.col("l_linenumber") != 5, back(F.col("l_partkey") % 120)).alias("first_reported"), back(F.col("l_partkey") % 120 + F.col("l_suppkey") % 13).alias("story_reported"), back(F.lit(2)).alias("listed_at"),
    )


@query(f"""WITH {_REPORTS} SELECT id, line, freshness, basis, occurred_on FROM h""")
def freshness(t: Tables) -> DataFrame:
    return ranks.freshness(reports(t)).select("id", "line", "freshness", "basis", "occurred_on")


@query(f"""WITH {_REPORTS} SELECT id, coalesce(min(reported) FILTER (WHERE rank_anchor IS NULL), min(rank_anchor)) AS anchor FROM h GROUP BY 1""")
def card_anchor(t: Tables) -> DataFrame:
    placed = ranks.rank_anchor(ranks.freshness(reports(t)))
    return ranks.card_anchor(placed.withColumn("sort_at", F.col("reported")), "id")


@query("""WITH f AS (SELECT l_orderkey AS fact, l_linenumber AS id, l_quantity AS score, l_returnflag = 'A' AS official, l_linestatus = 'F' AS major, l_shipdate < TIMESTAMP '1996-01-01' AS old FROM lineitem)
SELECT fact, id, 50 + CASE WHEN official THEN 5 ELSE 0 END + CASE WHEN major THEN 2 ELSE 0 END - CASE WHEN old THEN 30 ELSE 0 END + score - 50 AS importance FROM f""")
def importance(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "A").alias("official"), (F.col("l_linestatus") == "F").alias("major"), (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("old"))
    return rows.select("fact", "id", ranks.importance().alias("importance"))


@query("""WITH m AS (SELECT l_orderkey AS fact, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'A' AS verified, l_linenumber AS line FROM lineitem),
v AS (SELECT fact, min(day) AS day FROM m WHERE verified GROUP BY 1),
a AS (SELECT fact, day, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT fact, day FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY n DESC, day) AS r FROM a) WHERE r = 1),
f AS (SELECT fact, min(day) AS day FROM m WHERE line = 1 GROUP BY 1)
SELECT fact, coalesce(v.day, b.day, f.day) AS day, CASE WHEN v.day IS NOT NULL THEN 'verified' WHEN b.day IS NOT NULL THEN 'agreed' WHEN f.day IS NOT NULL THEN 'founder' ELSE 'none' END AS basis
FROM (SELECT DISTINCT fact FROM m) LEFT JOIN v USING (fact) LEFT JOIN b USING (fact) LEFT JOIN f USING (fact)""")
def fact_timing(t: Tables) -> DataFrame:
    claims = t.lineitem.select(F.col("l_orderkey").alias("fact"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_returnflag") == "A").alias("verified"), (F.col("l_linenumber") == 1).alias("founder"))
    return ranks.fact_timing(claims)
