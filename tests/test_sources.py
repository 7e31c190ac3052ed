"""Sources, sinks, entities and versions on small rows."""

import random

from pyspark.sql import functions as F

from riverbed.operators import entities, joins, provisions, rollups
from riverbed.sources import feeds

RSS = """<rss><channel><title>Feed</title>
<item><title><![CDATA[A & B]]></title><link>http://x/1</link><guid>1</guid><description>Short… </description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>
<item><title>Two</title><link>http://x/2</link></item><item><title>C &amp; D &#8212; &lt;b&gt;</title><link>http://x/4?a=1&amp;b=2</link></item></channel></rss>"""
ATOM = '<feed><entry><title type="text">Three</title><link rel="alternate" href="http://x/3"/><id>urn:3</id><updated>2024-01-01T00:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None)], "source string, content string")
    got = {(r.source, r.title): r for r in feeds.feed_items(df).collect()}
    assert got["r", "A & B"].url == "http://x/1" and got["r", "A & B"].id == "1" and got["r", "Two"].id is None
    assert got["a", "Three"].url == "http://x/3" and got["a", "Three"].published == "2024-01-01T00:00:00Z" and len(got) == 4 and got["r", "C & D — <b>"].url == "http://x/4?a=1&b=2"
    kinds = spark.createDataFrame([("x" * 281,), ("read more",), ("hello",), ("x" * 400 + " Continue reading",), ("x " * 600 + "read more",)], "t string").select(feeds.text_kind(F.col("t"))).collect()
    assert [k[0] for k in kinds] == ["body", "teaser", "short", "teaser", "body"]


def test_json_lists(spark):
    df = spark.createDataFrame([(1, '{"data": {"rows": [{"a": {"b": [1, 2]}, "t": "x"}, {"t": null}]}}'), (2, "{}"), (3, "broken")], "id long, json string")
    got = feeds.json_list(df, "data.rows", {"second": "a.b[1]", "title": "t"}).collect()
    assert [(r.id, r.second, r.title) for r in got] == [(1, "2", "x"), (1, None, None)]
    one = df.filter("id = 1").select(feeds.template(["/p/", feeds.json_path(F.col("json"), "data.rows[0].t")]), feeds.template(["/p/", feeds.json_path(F.col("json"), "no")])).first()
    assert tuple(one) == ("/p/x", None)


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("f", str(k), f"T<{k}", f"http://x/{k}", f"2024-01-{k + 1:02d}") for k in range(5)], "feed string, id string, title string, url string, published string")
    top = feeds.newest(items, "feed", 2)
    assert {r.id for r in top.collect()} == {"3", "4"}
    text = feeds.rss("News & more", top)
    assert text.index("T&lt;4") < text.index("T&lt;3") and "News &amp; more" in text
    maps = feeds.sitemap([items, items.withColumn("changed", F.lit("x"))] if "changed" in items.columns else [items.withColumn("changed", F.col("published")), items.withColumn("changed", F.lit("later"))], capacity=2)
    rows = maps.collect()
    assert len(rows) == 5 and all(r.changed != "later" for r in rows)
    assert max(r["count"] for r in maps.groupBy("file").count().collect()) <= 2
    days = spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    feeds.replace_partitions(days, str(tmp_path / "d"), "day")
    feeds.replace_partitions(spark.createDataFrame([("b", 3)], "day string, n int"), str(tmp_path / "d"), "day")
    assert sorted((r.day, r.n) for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [("a", 1), ("b", 3)]


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Río-Tinto plc met Tinto. New Mexico and " + "word " * 12 + "Mexico again"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("Rio Tinto Ltd", "E1"), ("Tinto", "E2"), ("Mexico", "E3"), ("New Mexico", None)], "name string, entity string")
    found = entities.link(docs, names)
    assert {(r.entity, r.mentions, r.role) for r in found.collect()} == {("E1", 1, "subject"), ("E2", 1, "subject"), ("E3", 1, "mention")}
    rng = random.Random(2)
    vocabulary = ["río", "rio", "Tinto", "new", "MEXICO", "gold", "x"]
    many = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(40)]
    pool = [("Río Tinto", "A"), ("rio tinto gold", None), ("Gold", "B"), ("gold new", "C"), ("new mexico", None), ("mexico", "D"), ("Rio", "B"), ("GOLD plc", "E")]
    keys = {}
    for name, entity in pool:
        keys.setdefault(entities.lookup_key(name), set()).update([entity] if entity else [])
    want = set()
    for k, text in many:
        words, at, seen = [w.replace("í", "i").lower() for w in text.split()], 0, {}
        while at < len(words):
            n = next((n for n in (3, 2, 1) if " ".join(words[at : at + n]) in keys and at + n <= len(words)), 0)
            for e in keys.get(" ".join(words[at : at + n]), ()) if n else ():
                seen.setdefault(e, []).append(at)
            at += n or 1
        want |= {(k, e, len(p), "subject" if min(p) < 12 else "mention") for e, p in seen.items()}
    got = entities.link(spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame(pool, "name string, entity string"))
    assert {tuple(r) for r in got.select("doc_id", "entity", "mentions", "role").collect()} == want
    tags = spark.createDataFrame([(1, ["E1", "E9"]), (2, ["E1"])], "doc_id long, tags array<string>")
    assert {r.doc_id: r.tags for r in entities.grounded_tags(tags, found).collect()} == {1: ["E1"], 2: []}


def test_versions(spark):
    old = "Title\nArticle 1 Copper is taxed at two percent.\nArticle 2 Exports need a permit.\nsee Article 1\nArticle 3 This ends."
    new = "Title\nArticle 1 Copper is taxed at three percent.\nArticle 2 Miners pay for water.\nArticle 3 Exports need a permit.\nArticle 4 This ends."
    assert [p[0] for p in provisions.split(old)] == ["head", "1", "2", "3"]
    rows = provisions.compare_versions(spark.createDataFrame([(7, old, new), (8, "", None)], "pair_id long, old string, new string")).collect()
    got = {(r.old_number, r.new_number): r.state for r in rows if r.pair_id == 7}
    assert got[("head", "head")] == "same" and got[("1", "1")] == "changed" and got[(None, "2")] == "added" and ("2", "3") in got and ("3", "4") in got
    assert [r for r in rows if r.pair_id == 8] == []


def test_gaps_and_scores(spark):
    spine = spark.createDataFrame([(1,), (2,)], "k long")
    assert {(r.k, r.n) for r in rollups.fill_gaps(spine, spark.createDataFrame([(2, 5)], "k long, n long"), ["k"], {"n": 0}).collect()} == {(1, 0), (2, 5)}
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert {(r.k, r.points) for r in joins.overlap_scores(a, b, "k").collect()} == {(1, 3), (2, 4), (3, 1)}
