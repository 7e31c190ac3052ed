"""Queries over the event stream: heat, visits, usage, series of days."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions import calendar
from riverbed.operators import heat, heat_store, rollups, visits
from riverbed.plans.registry import Tables, query
from riverbed.sources.shared import shared_dir
from riverbed.streaming import late

#: Event types that count as editorial signals.
EDITORIAL = ("purchase", "signup")

_SIGNALS = """
s AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story, user_id AS participant,
  event_type IN ('purchase', 'signup') AS editorial, ts FROM events),
a AS (SELECT max(ts) AS now_ FROM events)"""


def signals(t: Tables) -> DataFrame:
    return t.events.select(F.get_json_object("props", "$.k").cast("bigint").alias("story"), F.col("user_id").alias("participant"), F.col("event_type").isin(*EDITORIAL).alias("editorial"), "ts")


def as_of(t: Tables) -> Column:
    """The table's last instant: queries never read a clock."""
    return F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


@query(f"""WITH {_SIGNALS},
e AS (SELECT story, participant, max(ts) AS latest, bool_or(editorial) AS editorial FROM s, a
  WHERE ts > now_ - INTERVAL 72 HOUR AND ts <= now_ GROUP BY 1, 2)
SELECT story, round(sum(power(0.5, (epoch_us(now_) - epoch_us(latest)) / 1e6 / 86400.0)), 6) AS heat, count(*) AS participants,
  count(*) FILTER (WHERE editorial) AS editorial, max(latest) AS latest FROM e, a
GROUP BY story HAVING count(*) >= 2 AND count(*) FILTER (WHERE editorial) >= 1
ORDER BY heat DESC, latest DESC, story LIMIT 50""")
def heat_ranking(t: Tables) -> DataFrame:
    return heat.ranking(signals(t), as_of(t))


@query(f"""WITH {_SIGNALS},
o AS (SELECT story, participant, max(ts) FILTER (WHERE ts > now_ - INTERVAL 72 HOUR) AS last_at, min(ts) FILTER (WHERE ts > now_ - INTERVAL 72 HOUR) AS first_at,
  max(ts) FILTER (WHERE ts <= now_ - INTERVAL 6 HOUR) AS last_prev, participant % 17 = 0 AS behind, participant % 11 = 0 AS late FROM s, a WHERE ts > now_ - INTERVAL 78 HOUR AND ts <= now_ GROUP BY 1, 2),
d AS (SELECT *, power(0.5, (epoch_us(now_) - epoch_us(last_at)) / 1e6 / 86400.0) AS dn, power(0.5, (epoch_us(now_ - INTERVAL 6 HOUR) - epoch_us(last_prev)) / 1e6 / 86400.0) AS dp FROM o, a),
g AS (SELECT story, count(last_at) AS participants, floor(round(coalesce(sum(dn), 0.0), 6) * 100 + 0.5) / 10 AS heat_now, floor(round(coalesce(sum(dp), 0.0), 6) * 100 + 0.5) / 10 AS heat_before,
  floor(round(coalesce(sum(dn) FILTER (WHERE NOT behind AND NOT late), 0.0), 6) * 100 + 0.5) / 10 AS now_obs, floor(round(coalesce(sum(dp) FILTER (WHERE NOT behind AND NOT late), 0.0), 6) * 100 + 0.5) / 10 AS prev_obs,
  count(*) FILTER (WHERE behind OR late) AS uncomparable, count(*) FILTER (WHERE first_at > now_ - INTERVAL 6 HOUR) AS recent FROM d GROUP BY 1),
b AS (SELECT story, min(ts) AS begun FROM s GROUP BY 1),
p AS (SELECT *, CASE WHEN uncomparable > 0 THEN now_obs ELSE heat_now END AS cur, CASE WHEN uncomparable > 0 THEN prev_obs ELSE heat_before END AS prev FROM g JOIN b USING (story) WHERE participants > 0),
c AS (SELECT *, CASE WHEN prev > 0 THEN (cur - prev) / prev END AS pct, recent >= 3 AND recent / participants >= 0.5 AS surge FROM p)
SELECT story, heat_now, heat_before, CASE WHEN heat_before <= 0 THEN 'new' WHEN pct IS NULL THEN 'unknown' WHEN pct > 0.1 THEN 'up' WHEN pct < -0.1 THEN 'down' ELSE 'flat' END AS trend,
  floor(pct * 1000 + 0.5) / 10 AS trend_pct, surge, begun > now_ - INTERVAL 6 HOUR AS fresh, coalesce(NOT surge AND pct > 0.15, false) AS rising FROM c, a""")
def heat_trend(t: Tables) -> DataFrame:
    at, who = as_of(t), F.col("participant")
    sources = t.events.select(F.col("user_id").alias("participant")).distinct()
    since = F.when(who % 11 == 0, calendar.shift(at, -10)).otherwise(calendar.shift(at, -9999))
    return heat.trend(signals(t), sources.select("participant", (who % 17 == 0).alias("behind"), since.alias("since")), at)


@query(f"""WITH {_SIGNALS},
g AS (SELECT unnest(generate_series(date_trunc('hour', now_) - INTERVAL 23 HOUR, date_trunc('hour', now_), INTERVAL 1 HOUR)) AS hour FROM a),
e AS (SELECT story, hour, participant, max(ts) AS latest FROM s, g WHERE ts <= hour AND ts > hour - INTERVAL 72 HOUR GROUP BY 1, 2, 3)
SELECT story, hour, round(sum(power(0.5, (epoch_us(hour) - epoch_us(latest)) / 1e6 / 86400.0)), 6) AS heat, count(*) AS participants FROM e GROUP BY 1, 2""")
def heat_hourly(t: Tables) -> DataFrame:
    at = as_of(t)
    hour = F.date_trunc("hour", at)
    spine = t.spark.range(1).select(F.explode(F.sequence(calendar.shift(hour, -23), hour, F.expr("interval 1 hour"))).alias("hour")).select(F.col("hour").cast("timestamp_ntz").alias("hour"))
    recent = signals(t).filter((F.col("ts") > calendar.shift(at, -96)) & (F.col("ts") <= at))
    return heat.hourly(recent, F.broadcast(spine))  # the spine has 24 rows


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events),
s AS (SELECT user_id AS source, 10 + user_id % 120 AS interval_minutes FROM (SELECT DISTINCT user_id FROM events)),
l AS (SELECT user_id AS source, max(ts) AS last_ok FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT source, interval_minutes, last_ok, last_ok IS NULL OR (epoch_us(now_) - epoch_us(last_ok)) / 1e6 > greatest(3 * interval_minutes, 90) * 60 AS behind
FROM s LEFT JOIN l USING (source), a""")
def sources_behind(t: Tables) -> DataFrame:
    sources = t.events.select(F.col("user_id").alias("source")).distinct().withColumn("interval_minutes", 10 + F.col("source") % 120)
    fetches = t.events.select(F.col("user_id").alias("source"), (F.col("event_type") != "error").alias("ok"), "ts")
    return heat.behind(fetches, sources, as_of(t))


@query("""WITH f AS (SELECT user_id AS source, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent FROM events GROUP BY 1)
SELECT source, recent, CAST(CASE WHEN recent / 7.0 <= 0.15 THEN 60 ELSE floor(least(60, greatest(15, 24 * 60.0 / (recent / 7.0 * 3))) + 0.5) END AS BIGINT) AS interval_minutes FROM f""")
def adaptive_interval(t: Tables) -> DataFrame:
    return rollups.adaptive_interval(t.events.select(F.col("user_id").alias("source"), "ts"), as_of(t))


@query("""SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1""")
def distinct_visitors(t: Tables) -> DataFrame:
    return t.events.groupBy(calendar.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("visitors"))


@query("""WITH RECURSIVE v AS (SELECT user_id AS client, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type AS path, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS m FROM events GROUP BY ALL),
nx AS (SELECT client, day, path, m, min(m) OVER (PARTITION BY client, day, path ORDER BY m RANGE BETWEEN 30 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM v),
k AS (SELECT client, day, path, min(m) AS m FROM v GROUP BY 1, 2, 3 UNION ALL SELECT k.client, k.day, k.path, nx.after FROM k JOIN nx USING (client, day, path, m) WHERE nx.after IS NOT NULL)
SELECT day, path, count(*) AS views FROM k GROUP BY 1, 2""")  # six paths: the cap of 60 a minute never binds here, tests/test_visits.py has it
def repeat_suppressed(t: Tables) -> DataFrame:
    views = t.events.select(F.col("user_id").alias("client"), F.col("event_type").alias("path"), "ts", "event_id")
    return visits.first_views(views).groupBy(calendar.local_day(F.col("ts")).alias("day"), "path").agg(F.count(F.lit(1)).alias("views"))


@query("""WITH d AS (SELECT unnest(generate_series(min(CAST(ts AS DATE)) - INTERVAL 3 DAY, max(CAST(ts AS DATE)), INTERVAL 1 DAY))::DATE AS day FROM events),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS views, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT day, coalesce(views, 0) AS views, coalesce(total, 0.0) AS total FROM d LEFT JOIN c USING (day)""")
def gap_filled_days(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    spine = t.events.agg(F.date_sub(F.min(day), 3).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    counted = t.events.filter("event_type = 'purchase'").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("views"), F.round(F.sum("value"), 2).alias("total"))
    return rollups.fill_gaps(spine, counted, ["day"], {"views": 0, "total": 0.0})


@query("""WITH d AS (SELECT DISTINCT user_id AS source, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events WHERE event_type = 'signup'),
g AS (SELECT source, day, date_diff('day', lag(day) OVER (PARTITION BY source ORDER BY day), day) AS gap FROM d)
SELECT source, count(*) AS days, CAST(median(gap) AS DOUBLE) AS median_gap, CAST(date_diff('day', max(day), (SELECT max(CAST(ts + INTERVAL 8 HOUR AS DATE)) FROM events)) AS INTEGER) AS quiet_days FROM g GROUP BY 1""")
def output_rhythm(t: Tables) -> DataFrame:
    made = t.events.filter("event_type = 'signup'").select(F.col("user_id").alias("source"), "ts")
    return rollups.rhythm(made, calendar.local_day(as_of(t)))


@query("""SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n FROM events GROUP BY 1""")
def percentile_by_group(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events)
SELECT event_type, count(*) FILTER (WHERE ts > now_ - INTERVAL 7 DAY) AS this_week, count(*) FILTER (WHERE ts > now_ - INTERVAL 14 DAY AND ts <= now_ - INTERVAL 7 DAY) AS last_week,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE ts > now_ - INTERVAL 7 DAY), 0) AS DECIMAL(28,6)) AS this_value,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE ts > now_ - INTERVAL 14 DAY AND ts <= now_ - INTERVAL 7 DAY), 0) AS DECIMAL(28,6)) AS last_value
FROM events, a GROUP BY 1""")
def weekly_compare(t: Tables) -> DataFrame:
    at = as_of(t)
    this = F.col("ts") > calendar.shift(at, -168)
    last = (F.col("ts") > calendar.shift(at, -336)) & ~this
    money = F.col("value").cast("decimal(18,6)")
    total = lambda when: F.coalesce(F.sum(F.when(when, money)), F.lit(0)).cast("decimal(28,6)")
    return t.events.groupBy("event_type").agg(F.count_if(this).alias("this_week"), F.count_if(last).alias("last_week"), total(this).alias("this_value"), total(last).alias("last_value"))


@query("""WITH e AS (SELECT event_type, CAST(user_id % 5 AS VARCHAR) AS lane, strftime(ts, '%Y-%m') AS month, CAST(value AS DECIMAL(18,6)) AS cost FROM events)
SELECT CASE WHEN grouping(event_type) = 0 THEN 'service' WHEN grouping(lane) = 0 THEN 'lane' ELSE 'month' END AS dimension,
  coalesce(event_type, lane, month) AS value, count(*) AS attempts, CAST(sum(cost) AS DECIMAL(28,6)) AS cost
FROM e GROUP BY GROUPING SETS ((event_type), (lane), (month))""")
def usage_rollup(t: Tables) -> DataFrame:
    attempts = t.events.select(F.col("event_type").alias("service"), (F.col("user_id") % 5).cast("string").alias("lane"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("value").cast("decimal(18,6)").alias("cost"))
    return rollups.by_each(attempts, ["service", "lane", "month"], F.count(F.lit(1)).alias("attempts"), F.sum("cost").cast("decimal(28,6)").alias("cost"))


@query("""WITH e AS (SELECT user_id AS object, CAST(value * 1000000 AS BIGINT) AS micros FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)),
o AS (SELECT object, CAST(sum(micros) AS BIGINT) AS micros FROM e GROUP BY 1),
r AS (SELECT *, sum(micros) OVER (ORDER BY micros DESC, object ROWS UNBOUNDED PRECEDING) - micros AS before, sum(micros) OVER () AS total FROM o)
SELECT object, micros FROM r WHERE before * 2 < total""")
def half_covering_contributors(t: Tables) -> DataFrame:
    last = calendar.shift(as_of(t), 0).cast("date")
    spent = t.events.filter(F.col("ts").cast("date") == last).select(F.col("user_id").alias("object"), F.round(F.col("value") * 1000000).cast("bigint").alias("micros"))
    return rollups.half_covering(spent.groupBy("object").agg(F.sum("micros").alias("micros")), "object", "micros")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events)
SELECT user_id AS client, count(*) FILTER (WHERE ts > now_ - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > now_ - INTERVAL 1 DAY) AS last_day,
  bool_or(event_type = 'error' AND ts > now_ - INTERVAL 1 DAY) AS failed_today, count(*) FILTER (WHERE event_type = 'error') * 4 > count(*) AS breaker FROM events, a GROUP BY 1 HAVING count(*) FILTER (WHERE ts > now_ - INTERVAL 1 DAY) > 0""")
def sliding_counters(t: Tables) -> DataFrame:
    at, failed = as_of(t), F.col("event_type") == "error"
    hour, day = F.col("ts") > calendar.shift(at, -1), F.col("ts") > calendar.shift(at, -24)
    counted = t.events.groupBy(F.col("user_id").alias("client")).agg(F.count_if(hour).alias("last_hour"), F.count_if(day).alias("last_day"), F.bool_or(failed & day).alias("failed_today"), (F.count_if(failed) * 4 > F.count(F.lit(1))).alias("breaker"))
    return counted.filter("last_day > 0")


@query("""WITH e AS (SELECT user_id % 20 AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS gold, value > 50 AS said, event_type = 'error' AS failed FROM events)
SELECT model, count(*) FILTER (WHERE NOT failed AND gold AND said) AS tp, count(*) FILTER (WHERE NOT failed AND NOT gold AND said) AS fp, count(*) FILTER (WHERE NOT failed AND NOT gold AND NOT said) AS tn,
  count(*) FILTER (WHERE NOT failed AND gold AND NOT said) AS fn, count(*) FILTER (WHERE failed) AS error,
  round(count(*) FILTER (WHERE NOT failed AND gold AND said) / nullif(count(*) FILTER (WHERE NOT failed AND said), 0), 6) AS "precision",
  round(count(*) FILTER (WHERE NOT failed AND gold AND said) / nullif(count(*) FILTER (WHERE NOT failed AND gold), 0), 6) AS recall FROM e GROUP BY 1""")
def confusion_metrics(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 20).alias("model"), (F.get_json_object("props", "$.k").cast("bigint") % 2 == 0).alias("gold"), (F.col("value") > 50).alias("said"), (F.col("event_type") == "error").alias("failed"))
    return rollups.confusion(rows, "model")


@query("""WITH e AS (SELECT event_type, user_id % 4 AS model, value FROM events)
SELECT event_type AS case_id, round(avg(value) FILTER (WHERE model = 0), 6) AS model_0, round(avg(value) FILTER (WHERE model = 1), 6) AS model_1, round(avg(value) FILTER (WHERE model = 2), 6) AS model_2, round(avg(value) FILTER (WHERE model = 3), 6) AS model_3 FROM e GROUP BY 1""")
def model_comparison(t: Tables) -> DataFrame:
    return t.events.withColumn("model", (F.col("user_id") % 4).cast("string")).groupBy(F.col("event_type").alias("case_id")).pivot("model", ["0", "1", "2", "3"]).agg(F.round(F.avg("value"), 6)).select("case_id", *(F.col(str(k)).alias(f"model_{k}") for k in range(4)))


@query("""WITH e AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, CAST(round(value * 1000000) AS BIGINT) AS micros FROM events), l AS (SELECT CAST(max(ts) + INTERVAL 8 HOUR AS DATE) AS today, min(CAST(ts + INTERVAL 8 HOUR AS DATE)) AS first FROM events),
s AS (SELECT today, least(7, greatest(0, today - first)) AS days, coalesce(sum(micros) FILTER (WHERE day = today), 0)::HUGEINT AS micros, coalesce(sum(micros) FILTER (WHERE day < today AND day >= today - 7), 0)::HUGEINT AS past FROM l, e GROUP BY today, first)
SELECT today, CAST(micros AS BIGINT) AS micros, CAST(days AS INTEGER) AS days, CASE WHEN days > 0 AND past > 0 THEN micros > 1000000 AND micros * days > past * 3 ELSE micros > 5000000 END AS open,
  CASE WHEN days > 0 AND past > 0 THEN micros * 10 >= 1000000 * 8 AND micros * days * 10 >= past * 3 * 8 ELSE micros * 10 >= 5000000 * 8 END AS warning FROM s""")
def spend_breaker(t: Tables) -> DataFrame:
    day = calendar.local_day(F.col("ts"))
    daily = t.events.groupBy(day.alias("day")).agg(F.sum(F.round(F.col("value") * 1000000).cast("bigint")).alias("micros"))
    first = F.lit(t.events.agg(F.min(day)).first()[0]).cast("date")
    return rollups.spend_breaker(daily, calendar.local_day(as_of(t)), first, floor=1_000_000, no_history=5_000_000, multiple=3, days=7)


@query("""WITH r AS (SELECT user_id, event_type, props, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, props, n - 1 AS repeats, first_at, last_at FROM r WHERE n > 1""")
def repeated_inputs(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type", "props").agg((F.count(F.lit(1)) - 1).alias("repeats"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).filter("repeats > 0")


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, unnest([{'facet': 'type', 'value': event_type}, {'facet': 'item', 'value': json_extract_string(props, '$.k')}, {'facet': 'user', 'value': CAST(user_id AS VARCHAR)}]) AS f FROM events),
c AS (SELECT day, f.facet AS facet, f.value AS value, count(*) AS views FROM f GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY day, facet ORDER BY views DESC, value) AS rank FROM c)
SELECT day, facet, value, views, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def facet_top(t: Tables) -> DataFrame:
    faceted = t.events.select(F.col("ts").cast("date").alias("day"), F.explode(F.array(F.struct(F.lit("type").alias("facet"), F.col("event_type").alias("value")), F.struct(F.lit("item").alias("facet"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("user").alias("facet"), F.col("user_id").cast("string").alias("value")))).alias("f")).select("day", "f.*")
    counted = faceted.groupBy("day", "facet", "value").agg(F.count(F.lit(1)).alias("views"))
    w = Window.partitionBy("day", "facet").orderBy(F.desc("views"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(w)).filter("rank <= 15")


@query("""WITH a AS (SELECT max(ts) AS now_ FROM events),
s AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story, max(ts) AS latest FROM events GROUP BY 1)
SELECT story, latest, CASE WHEN latest > now_ - INTERVAL 24 HOUR THEN 'active' WHEN latest > now_ - INTERVAL 72 HOUR THEN 'watching' ELSE 'settled' END AS status FROM s, a""")
def story_status(t: Tables) -> DataFrame:
    at = as_of(t)
    latest = signals(t).groupBy("story").agg(F.max("ts").alias("latest"))
    status = F.when(F.col("latest") > calendar.shift(at, -24), "active").when(F.col("latest") > calendar.shift(at, -72), "watching").otherwise("settled")
    return latest.withColumn("status", status)


@query("""WITH e AS (SELECT event_id, ts AS claimed, ts + to_minutes(CAST(floor(value) AS BIGINT) - 120) AS discovered FROM events)
SELECT event_id, CASE WHEN claimed > discovered + INTERVAL 1 HOUR THEN 'unknown' WHEN claimed < discovered - INTERVAL 2 HOUR THEN 'backfill' ELSE 'live' END AS mode,
  CASE WHEN claimed > discovered + INTERVAL 1 HOUR THEN discovered WHEN claimed < discovered - INTERVAL 2 HOUR THEN claimed ELSE discovered END AS filed_at FROM e""")
def timeline_decision(t: Tables) -> DataFrame:
    found = t.events.select("event_id", F.col("ts").alias("claimed"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int") - 120)).alias("discovered"))
    future = F.col("claimed") > calendar.shift(F.col("discovered"), 1)
    old = F.col("claimed") < calendar.shift(F.col("discovered"), -2)
    return found.select("event_id", F.when(future, "unknown").when(old, "backfill").otherwise("live").alias("mode"), F.when(~future & old, F.col("claimed")).otherwise(F.col("discovered")).alias("filed_at"))


def clocks(t: Tables, hours: int) -> DataFrame:
    """How far each source has been read: one in thirteen some hours less than the others."""
    at, who = as_of(t), F.col("user_id")
    return t.events.select(who.alias("participant"), F.when(who % 13 == 0, calendar.shift(at, -hours)).otherwise(at).alias("fetched_to")).distinct()


_STORED_HEAT = """c AS (SELECT DISTINCT user_id AS participant, CASE WHEN user_id % 13 = 0 AND user_id % 2 = 1 THEN now_ - INTERVAL 5 HOUR ELSE now_ END AS fetched_to FROM events, a),
e AS (SELECT story, hour, participant, max(ts) AS latest, bool_or(editorial) AS editorial FROM s, g WHERE ts <= hour AND ts > hour - INTERVAL 72 HOUR GROUP BY 1, 2, 3)
SELECT story, hour, floor(round(sum(power(0.5, (epoch_us(hour) - epoch_us(latest)) / 1e6 / 86400.0)), 6) * 100 + 0.5) / 10 AS heat, count(*) AS participants, count(*) FILTER (WHERE editorial) AS editorial,
  NOT bool_or(fetched_to < hour) AS complete FROM e JOIN c USING (participant) GROUP BY 1, 2"""


@query(f"WITH {_SIGNALS}, g AS (SELECT unnest([date_trunc('hour', now_ - INTERVAL 3 HOUR), date_trunc('hour', now_)]) AS hour FROM a), {_STORED_HEAT}")
def heat_repair(t: Tables) -> DataFrame:
    """Two snapshots; at the second the even ones of the sources that were behind have caught up."""
    root = f"{shared_dir(t.spark)}/riverbed-heat-{uuid.uuid4().hex}"
    at, said = as_of(t), signals(t)
    heat_store.snapshot(t.spark, f"{root}/heat", said, clocks(t, 5), calendar.shift(at, -3), root)
    later = clocks(t, 5).withColumn("fetched_to", F.when(F.col("participant") % 2 == 0, at).otherwise(F.col("fetched_to")))
    heat_store.snapshot(t.spark, f"{root}/heat", said, later, at, root)
    return heat_store.stored(t.spark, f"{root}/heat")


@query(f"""WITH {_SIGNALS}, w AS (SELECT story, date_trunc('hour', min(ts)) AS first, date_trunc('hour', least(max(now_), max(ts) + INTERVAL 72 HOUR)) AS last FROM s, a WHERE story % 10 = 0 GROUP BY 1),
h AS (SELECT story, unnest(generate_series(greatest(first, last - INTERVAL 168 HOUR), last, INTERVAL 1 HOUR)) AS hour FROM w), c AS (SELECT DISTINCT user_id AS participant, CASE WHEN user_id % 13 = 0 THEN now_ - INTERVAL 5 HOUR ELSE now_ END AS fetched_to FROM events, a),
e AS (SELECT story, hour, participant, max(ts) AS latest, bool_or(editorial) AS editorial FROM s JOIN h USING (story) WHERE ts <= hour AND ts > hour - INTERVAL 72 HOUR GROUP BY 1, 2, 3)
SELECT story, hour, floor(round(sum(power(0.5, (epoch_us(hour) - epoch_us(latest)) / 1e6 / 86400.0)), 6) * 100 + 0.5) / 10 AS heat, count(*) AS participants, count(*) FILTER (WHERE editorial) AS editorial,
  NOT bool_or(fetched_to < hour) AS complete FROM e JOIN c USING (participant) GROUP BY 1, 2""")
def heat_backfill(t: Tables) -> DataFrame:
    """The last week of the stories that were regrouped (every tenth stands for them)."""
    root = f"{shared_dir(t.spark)}/riverbed-heat-{uuid.uuid4().hex}"
    said = signals(t)
    heat_store.backfill(t.spark, f"{root}/heat", said, said.filter("story % 10 = 0").select("story"), clocks(t, 5), as_of(t), root)
    return heat_store.stored(t.spark, f"{root}/heat")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN ts END AS claimed, ts + to_minutes(CAST(floor(value) AS BIGINT) * 60 - 120) AS discovered FROM events),
p AS (SELECT *, CASE WHEN claimed <= discovered + INTERVAL 1 HOUR THEN claimed END AS published FROM e),
r AS (SELECT *, CASE WHEN published IS NULL THEN 'unknown-publication-time' WHEN published < discovered - INTERVAL 48 HOUR THEN 'stale-on-discovery' END AS reason FROM p)
SELECT event_id, published, reason, CASE WHEN reason IS NOT NULL AND published IS NOT NULL THEN published ELSE discovered END AS filed_at, reason IS NOT NULL AS historical FROM r""")
def late_filing(t: Tables) -> DataFrame:
    arrivals = t.events.select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("ts")).alias("claimed"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int") * 60 - 120)).alias("discovered"))
    return late.filed(arrivals).select("event_id", "published", "reason", "filed_at", "historical")
