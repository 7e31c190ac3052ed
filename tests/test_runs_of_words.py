"""Runs of words meet phrases and names without all words being shuffled."""

import random

from measured import shuffled
from pyspark.sql import functions as F
from riverbed.operators import entities, joins, phrases


def _texts(n, words):
    rng = random.Random(2)
    return [(k, " ".join(f"w{rng.randint(0, 300)}" for _ in range(words))) for k in range(n)]


def test_search_shuffles_places_not_words(spark, tmp_path):
    df = spark.createDataFrame(_texts(200, 300), "doc long, text string")
    asked = df.filter("doc % 10 = 0").select(F.col("doc").alias("phrase"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))

    def search():
        phrases.build(df, str(tmp_path / "index"))
        return phrases.search(phrases.load(spark, str(tmp_path / "index")), asked).collect()

    found, records = shuffled(spark, search)
    assert {(r.phrase, r.doc, r.pos) for r in found} >= {(k, k, 0) for k in range(0, 200, 10)}
    assert records < 5_000  # of 60,000 words; each was shuffled for the index and again for the search


def test_long_phrases_by_their_runs(spark, tmp_path):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(60)]
    asked = [(k, " ".join(rng.choice("ab") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12] * 3)] + [(99, "a " * 15)]
    phrases.build(spark.createDataFrame(texts, "doc long, text string"), str(tmp_path / "index"))
    got = [tuple(r) for r in phrases.search(phrases.load(spark, str(tmp_path / "index")), spark.createDataFrame(asked, "phrase long, text string")).collect()]
    want = {(p, d, i) for p, t in asked for d, text in texts for i in range(len(text.split())) if text.split()[i : i + len(t.split())] == t.split()}
    assert set(got) == want and len(got) == len(want) > 1000


def test_linking_shuffles_names_not_words(spark):
    df = spark.createDataFrame(_texts(200, 300), "doc_id long, text string")
    names = spark.createDataFrame([("w7 w8", "A"), ("w9", None), ("nowhere", "B"), ("w10", "C")], "name string, entity string")
    got, records = shuffled(spark, lambda: entities.link(df, names).collect())
    want = {(k, "C"): t.split().count("w10") for k, t in _texts(200, 300) if "w10" in t.split()}
    assert {(r.doc_id, r.entity): r.mentions for r in got if r.entity == "C"} == want and records < 5_000  # of 120,000 runs


def test_map_leaves_no_key_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAP_WORDS", 4)
    df, others = spark.range(2000).selectExpr("id", "id % 1000 as key"), spark.range(0, 1000, 50).withColumnRenamed("id", "key")
    kept = joins.maybe_among(df, others, "key")
    assert kept.columns == ["id", "key"] and kept.join(others, "key").count() == 40 and kept.count() < 1000
