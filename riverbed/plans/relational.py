"""Queries over the relational core: joins, latest rows, pages, sets, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators import changes, graphs, joins, latest
from riverbed.plans.registry import Tables, query

#: The pairs of about so many order lines are counted by one task (a fixed value).
PAIRED_LINES = 250_000


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return latest.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def top_per_key(t: Tables) -> DataFrame:
    return latest.first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("""WITH m AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_quantity AS score, CAST(l_suppkey % 4 AS INTEGER) AS priority, l_returnflag = 'N' AS full_body, l_shipdate AS seen_at FROM lineitem),
b AS (SELECT *, max(score) OVER (PARTITION BY grp) AS best FROM m)
SELECT grp, id, score, priority, full_body, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY priority, full_body DESC, score DESC, seen_at, id) AS n FROM b WHERE score > best - 3) WHERE n = 1""")
def representative(t: Tables) -> DataFrame:
    members = t.lineitem.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("score"), (F.col("l_suppkey") % 4).cast("int").alias("priority"), (F.col("l_returnflag") == "N").alias("full_body"), F.col("l_shipdate").alias("seen_at"))
    return latest.representative(members, "grp")


@query("""SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 100) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(t: Tables) -> DataFrame:
    import datetime

    return latest.page_after(t.orders.select("o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderdate", "o_orderkey"], (datetime.datetime(1998, 1, 1), 100), 50)


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, CAST(ceil((SELECT count(*) FROM orders) / 25.0) AS BIGINT) AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def offset_page(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count(F.lit(1)).alias("total"))
    page = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).offset(50).limit(25)
    return page.crossJoin(total).withColumn("pages", F.ceil(F.col("total") / 25.0))


@query("""SELECT c_custkey, 'buys' AS side FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
UNION ALL SELECT c_custkey, 'never' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_semi_pairs(t: Tables) -> DataFrame:
    buyers = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    semi = t.customer.select("c_custkey").join(buyers, "c_custkey", "left_semi").withColumn("side", F.lit("buys"))
    anti = t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").withColumn("side", F.lit("never"))
    return semi.unionByName(anti)


@query("""WITH d AS (SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size < 10)
SELECT coalesce(d.partkey, b.partkey) AS partkey, CAST(CASE WHEN d.partkey IS NULL THEN 0 ELSE 3 END + CASE WHEN b.partkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS points FROM d FULL OUTER JOIN b USING (partkey)""")
def full_outer_scores(t: Tables) -> DataFrame:
    return joins.overlap_scores(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("partkey")), t.part.filter("p_size < 10").select(F.col("p_partkey").alias("partkey")), "partkey")


@query("""SELECT c.c_custkey, c.c_name, n.n_name, r.r_name, o.o_orderkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 200000""")
def dimension_joins(t: Tables) -> DataFrame:
    large = t.orders.filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_custkey")
    # nation and region have 25 and 5 rows at every scale
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_name", "r_name", "o_orderkey")


@query("""SELECT a.o_orderkey, b.o_orderkey AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderpriority = a.o_orderpriority WHERE a.o_totalprice > 300000""")
def self_join_earlier(t: Tables) -> DataFrame:
    a = t.orders.filter("o_totalprice > 300000").alias("a")
    return a.join(t.orders.alias("b"), F.expr("a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate and b.o_orderpriority = a.o_orderpriority")).select("a.o_orderkey", F.col("b.o_orderkey").alias("earlier"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n <= 2""")
def lateral_top(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.lateral_top(t.customer.select("c_custkey"), right, "c_custkey", 2, F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT conv_id, turn, fresh.text AS text, old.text AS before FROM conversations fresh LEFT JOIN (SELECT conv_id AS c, turn + 1 AS t, text FROM conversations) old ON old.c = conv_id AND old.t = turn""")
def previous_revision(t: Tables) -> DataFrame:
    old = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return t.conversations.select("conv_id", "turn", "text").join(old, ["conv_id", "turn"], "left")


@query("""SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0 UNION SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0""")
def union_distinct(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    s = t.supplier.filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(c.unionByName(s).distinct(), "n_nationkey", "left_semi").select(F.col("n_name").alias("name")).distinct()


@query("""SELECT s_suppkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS round FROM supplier""")
def round_robin(t: Tables) -> DataFrame:
    return latest.round_robin(t.supplier, "s_nationkey", F.desc("s_acctbal"), F.asc("s_suppkey")).select("s_suppkey", "s_name", "round")


@query("""WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS issue, o_custkey % 10 AS source, o_orderkey AS id, o_totalprice AS score FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY issue, source ORDER BY score DESC, id) AS n FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY score DESC, id) AS place FROM s WHERE n <= 2)
SELECT issue, source, id, score, CAST(place AS INTEGER) AS place FROM q WHERE place <= 12""")
def quota_selection(t: Tables) -> DataFrame:
    entries = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("issue"), (F.col("o_custkey") % 10).alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return latest.limited_selection(entries, quota=12, per_source=2)


@query("""SELECT p_partkey FROM part ORDER BY sha256(CAST(p_partkey AS VARCHAR) || 'audit-1'), p_partkey LIMIT 40""")
def seeded_sample(t: Tables) -> DataFrame:
    return latest.seeded_sample(t.part.select("p_partkey"), "p_partkey", "audit-1", 40)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 40 = 0 OR p_partkey <= 5 THEN NULL WHEN p_partkey % 41 = 0 THEN p_partkey + 1 WHEN p_partkey % 41 = 1 THEN p_partkey - 1 WHEN p_partkey % 97 = 0 THEN -1 ELSE p_partkey - 1 - p_partkey % 4 END AS target FROM part),
c AS (SELECT node, node AS here, 0 AS hops FROM p UNION ALL SELECT c.node, p.target, hops + 1 FROM c JOIN p ON p.node = c.here WHERE p.target IS NOT NULL AND hops < 10)
SELECT c.node, max(CASE WHEN p.node IS NOT NULL AND p.target IS NULL THEN c.here END) AS root FROM c LEFT JOIN p ON p.node = c.here GROUP BY 1""")
def merge_chain(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    target = F.when((k % 40 == 0) | (k <= 5), None).when(k % 41 == 0, k + 1).when(k % 41 == 1, k - 1).when(k % 97 == 0, F.lit(-1)).otherwise(k - 1 - k % 4)
    pointers = t.part.select(k.alias("node"), target.alias("target"))
    return graphs.resolve_chain(pointers)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS u, o_custkey + 7 * (o_orderkey % 11) AS v FROM orders WHERE o_totalprice > 250000 AND o_orderkey % 11 > 0),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS reach FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def union_find_groups(t: Tables) -> DataFrame:
    edges = t.orders.filter("o_totalprice > 250000 and o_orderkey % 11 > 0").select(F.col("o_custkey").alias("u"), (F.col("o_custkey") + 7 * (F.col("o_orderkey") % 11)).alias("v"))
    return graphs.components(edges)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 > 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 6 > 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'remove' ELSE 'upsert' END AS op, n.o_orderstatus, n.o_totalprice
FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def state_changes(t: Tables) -> DataFrame:
    columns = ["o_orderstatus", "o_totalprice"]
    old = t.orders.filter("o_orderkey % 5 > 0").select("o_orderkey", *columns)
    new = t.orders.filter("o_orderkey % 6 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).select("o_orderkey", *columns)
    return changes.changed(old, new, ["o_orderkey"], columns)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, 0 AS v FROM orders), n AS (SELECT o_orderkey, 'X' AS o_orderstatus, 1 AS v FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 1000000000, 'N', 1 FROM orders WHERE o_orderkey % 9 = 0)
SELECT o_orderkey, o_orderstatus FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, o_orderstatus FROM n""")
def merge_upsert(t: Tables) -> DataFrame:
    new = t.orders.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")).unionByName(t.orders.filter("o_orderkey % 9 = 0").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return changes.merge_by_key(t.orders.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


_LEDGER = """l AS (SELECT event_id AS seq, user_id AS article, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS visible_at FROM events),
w AS (SELECT coalesce(min(seq) FILTER (WHERE visible_at > (SELECT max(ts) FROM events)), max(seq) + 1) - 1 AS watermark FROM l)"""


@query(f"""WITH {_LEDGER} SELECT article, seq, visible_at, watermark FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY seq DESC) AS n FROM l, w WHERE seq <= watermark) WHERE n = 1 AND op = 'upsert'""")
def ledger_snapshot(t: Tables) -> DataFrame:
    ledger = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("article"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("visible_at"))
    at = F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    mark = changes.release_watermark(ledger, at)
    return changes.snapshot(ledger.crossJoin(F.broadcast(mark)), "article", F.col("watermark")).select("article", "seq", "visible_at", "watermark")


@query("""WITH g AS (SELECT n_name, p.prio FROM nation, (SELECT DISTINCT o_orderpriority AS prio FROM orders) p),
c AS (SELECT n_name, o_orderpriority AS prio, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000 GROUP BY 1, 2)
SELECT n_name, prio, coalesce(customers, 0) AS customers, coalesce(orders, 0) AS orders FROM g LEFT JOIN c USING (n_name, prio)""")
def coverage_matrix(t: Tables) -> DataFrame:
    grid = t.nation.select("n_name").crossJoin(F.broadcast(t.orders.select(F.col("o_orderpriority").alias("prio")).distinct()))  # 25 rows by a handful
    orders = t.orders.filter("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    cells = orders.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.col("o_orderpriority").alias("prio")).agg(F.count_distinct("c_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"))
    return grid.join(cells, ["n_name", "prio"], "left").na.fill(0, ["customers", "orders"])


@query("""WITH a AS (SELECT n_nationkey AS code, 'nation ' || n_name AS place FROM nation UNION ALL SELECT n_nationkey, 'region ' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey, 'world' FROM nation),
s AS (SELECT DISTINCT s_suppkey, place FROM supplier JOIN a ON code = s_nationkey) SELECT place, count(*) AS suppliers FROM s GROUP BY 1""")
def hierarchy_counts(t: Tables) -> DataFrame:
    up = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.array(F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), "r_name"), F.lit("world"))).alias("place"))
    return t.supplier.join(F.broadcast(up), "s_nationkey").select("s_suppkey", "place").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("suppliers"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS modes FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def string_aggregate(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("modes"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT CASE WHEN c_acctbal < 0 THEN 'owing' WHEN orders IS NULL THEN 'silent' WHEN last < TIMESTAMP '1998-01-01' THEN 'lapsed' ELSE 'active' END AS reason, count(*) AS customers FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1""")
def silence_reasons(t: Tables) -> DataFrame:
    made = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last"))
    reason = F.when(F.col("c_acctbal") < 0, "owing").when(F.col("orders").isNull(), "silent").when(F.col("last") < F.lit("1998-01-01").cast("timestamp_ntz"), "lapsed").otherwise("active")
    return t.customer.join(made, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("customers"))


@query("""SELECT 'orders' AS item, o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 2
UNION ALL SELECT 'lines', l_linestatus, count(*), min(l_shipdate), max(l_shipdate) FROM lineitem GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*), min(ts), max(ts) FROM events GROUP BY 2""")
def operational_snapshot(t: Tables) -> DataFrame:
    def part(df: DataFrame, item: str, status: str, at: str) -> DataFrame:
        return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).select(F.lit(item).alias("item"), "status", "n", "first_at", "last_at")

    return part(t.orders, "orders", "o_orderstatus", "o_orderdate").unionByName(part(t.lineitem, "lines", "l_linestatus", "l_shipdate")).unionByName(part(t.events, "events", "event_type", "ts"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey FROM lineitem), q AS (SELECT DISTINCT a.l_orderkey AS basket, a.l_partkey AS x, b.l_partkey AS y FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT x, y, count(*) AS together FROM q GROUP BY 1, 2 HAVING count(*) >= 2""")
def pairs_related(t: Tables) -> DataFrame:
    # an order has at most seven lines, so its pairs are few
    p = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    pairs = p.alias("a").join(p.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey")).select(F.col("a.l_partkey").alias("x"), F.col("b.l_partkey").alias("y"))
    # most pairs are there once, so they are dealt out before they are counted; a task's share does not grow with the table
    return pairs.repartition(-(-t.lineitem.count() // PAIRED_LINES) or 1, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("together")).filter("together >= 2")


@query("""SELECT * FROM (SELECT o_custkey AS place, o_orderkey, o_orderdate, 'newest' AS slot FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 9)
UNION ALL SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, 'oldest' FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1)""")
def due_queue(t: Tables) -> DataFrame:
    due = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("place"), "o_orderkey", "o_orderdate")
    newest = due.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(9).withColumn("slot", F.lit("newest"))
    return newest.unionByName(due.orderBy(F.asc("o_orderdate"), F.asc("o_orderkey")).limit(1).withColumn("slot", F.lit("oldest")))


@query("""SELECT l_shipmode, l_orderkey, cost FROM (SELECT l_returnflag AS l_shipmode, l_orderkey, round(sum(l_extendedprice), 2) AS cost, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(sum(l_extendedprice), 2) DESC, l_orderkey) AS n FROM lineitem GROUP BY 1, 2) WHERE n <= 10""")
def top_cost_objects(t: Tables) -> DataFrame:
    cost = t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode"), "l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    return latest.first_per_key(cost, ["l_shipmode"], 10, F.desc("cost"), F.asc("l_orderkey"))


@query("""WITH f AS (SELECT s_suppkey, s_nationkey FROM supplier), w AS (SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT s_suppkey, coalesce(lines, 0) AS lines, coalesce(parts, 0) AS parts, coalesce(returned, 0) AS returned, coalesce(returned, 0) * 4 > coalesce(lines, 0) AS unhealthy FROM f LEFT JOIN w ON l_suppkey = s_suppkey""")
def source_health(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return t.supplier.select("s_suppkey").join(lines, "s_suppkey", "left").na.fill(0).withColumn("unhealthy", F.col("returned") * 4 > F.col("lines"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS suppliers""")
def dashboard_row(t: Tables) -> DataFrame:
    one = lambda df, c, name: df.agg(c.alias(name))
    row = one(t.customer, F.count(F.lit(1)), "customers").crossJoin(one(t.orders, F.count(F.lit(1)), "orders"))
    return row.crossJoin(one(t.lineitem, F.count(F.lit(1)), "lines")).crossJoin(one(t.lineitem, F.count_distinct("l_suppkey"), "suppliers"))


