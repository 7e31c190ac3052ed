"""Quality rules against SQL, the classifier on held-out labels, decontamination under edits."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import same  # noqa: E402
from riverbed.llm import queries  # noqa: E402
from riverbed.llm.decontaminate import best_distance, contaminated  # noqa: E402
from riverbed.llm.quality_classifier import Crf, N_ROW, classify, fit, held_out, line_features  # noqa: E402
from riverbed.llm.quality_rules import keep_good, quality_rules  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    assert same(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name]) is None


def test_rules_on_odd_rows(spark):
    say = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [None, "", " \n\t ", "too few words", say, f"{say} {say}", "a\n\na\nb\n \na", "# * $ %" * 5, f"{say} x é   漢", "w " * 3000]
    df = spark.createDataFrame([(i if i != 4 else None, t, True, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, words string")
    trusted = spark.createDataFrame([(8,), (8,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules(df, trusted).collect()}
    assert [(got[i].n_words, got[i].kept) for i in (0, 1, 2, 3)] == [(0, False), (0, False), (0, False), (3, False)]
    assert (got[None].n_words, got[None].n_repeat_words, got[None].base_failed) == (12, 0, False)
    assert (got[5].n_repeat_words, got[5].base_failed) == (24, True)
    assert (got[6].n_dup_lines, got[7].n_symbols) == (2, 20)
    assert got[8].n_words == 15  # other white space parts no words
    assert got[9].n_repeat_words == 3000
    kept = keep_good(df, trusted)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    empty = trusted.filter("false")
    assert {r.doc_id for r in quality_rules(df, empty).filter("kept").collect()} == {None, 8}
    assert quality_rules(df.filter("false"), trusted).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    crf = Crf(rng.normal(size=N_ROW + 5))
    _, trans, first = crf._parts()
    emit = rng.normal(size=(1, 5))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> t & 1 for t in range(5)]
        p = np.exp(sum(emit[0, t] * y[t] for t in range(5)) + first * y[0] + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    log_z, got, pairs = crf.batch(emit, np.ones((1, 5), bool))
    assert np.isclose(np.exp(log_z[0]), total) and np.allclose(got[0], good / total) and np.isclose(pairs.sum(), 4)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = classify(docs, fit(docs, labels.filter(~held_out(labels["doc_id"]))))
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_classifier_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (None, "a\n\nb", 3.0), (3, "漢字 😀 " * 3000, 3.0), (4, "\n" * 50, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    for model in (Crf(), fit(df, labels), fit(df, labels.filter("false"))):
        rows = classify(df, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert [r.predicted for r in rows] == [int(r.score >= 0.3) for r in rows]
    assert classify(df.filter("false"), Crf()).collect() == []
    assert line_features("a\n\nb c")[0].shape == (3, N_ROW)


def brute_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_distances():
    rng = random.Random(5)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc ") for _ in range(n)) for n in (rng.randint(1, 20), rng.randint(0, 60)))
        assert best_distance(item, text, 99) == brute_distance(item, text)


def test_planted_items_are_found(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def edit(text, share):
        out = list(text)
        for _ in range(int(len(text) * share)):
            k = rng.randrange(len(out))
            out[k] = rng.choice(["", out[k] + rng.choice("xyz"), rng.choice("xyz")])
        return "".join(out)

    items = [prose(n) for n in (8, 15, 30, 40, 60) for _ in range(8)]
    plant = [(k, share, f"{prose(60)}\n{edit(items[k], share)} {prose(60)}") for share in (0, 0.02, 0.05) for k in range(len(items))]
    texts = [t for *_, t in plant] + [prose(300) for _ in range(60)] + [None, "", items[0].upper().replace(" ", "\n"), items[3] * 3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item string")
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, " "), (None, prose(20)), (902, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in contaminated(docs, bench).collect()}
    found = {s: np.mean([(i, k) in got for i, (k, share, _) in enumerate(plant) if share == s]) for s in (0, 0.02, 0.05)}
    assert found[0] == 1 and found[0.02] >= 0.97 and found[0.05] >= 0.9, found
    for (doc, item), d in got.items():
        if item < 900:
            plain = " ".join((texts[doc] or "").lower().split())
            assert d == brute_distance(items[item], plain) <= 0.1 * len(items[item])
    clean = range(len(plant), len(plant) + 60)
    assert not [k for k in got if k[0] in clean and k[1] < 900]
    assert (len(plant) + 62, 0) in got and (len(plant) + 63, 3) in got
    assert contaminated(docs.filter("false"), bench).collect() == [] and contaminated(docs, bench.filter("false")).collect() == []
