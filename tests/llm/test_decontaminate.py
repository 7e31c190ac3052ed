"""Decontamination where the edits stand together, and of short items."""

import random

import pytest

from riverbed.llm import decontaminate
from riverbed.llm.decontaminate import best_distance, contaminated, normal

RNG = random.Random(31)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(800)]


def prose(chars):
    return " ".join(RNG.choice(WORDS) for _ in range(chars))[:chars].strip()


def rewritten(text, place, cut):
    """A tenth of the text in one piece, at its head, middle or tail, rewritten or left out."""
    n = len(text) // 10
    at = {"head": 0, "middle": len(text) // 2, "tail": len(text) - n}[place]
    return text[:at] + ("" if cut else "".join(RNG.choice("xyz") for _ in range(n))) + text[at + n :]


def spread(text):
    out = list(text)
    for at in RNG.sample(range(len(out)), len(out) // 10):
        out[at] = "z"
    return "".join(out)


def check(spark, items, plant, found_at_least):
    docs = spark.createDataFrame([(i, f"{prose(300)} {t} {prose(200)}") for i, (_, t) in enumerate(plant)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in contaminated(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    # collapsing white space at a cut can be one edit more
    within = [(i, k) for i, (k, _) in enumerate(plant) if best_distance(items[k], texts[i], len(items[k])) <= len(items[k]) // 10]
    assert len(within) >= 0.9 * len(plant) and sum(x in got for x in within) >= found_at_least * len(within)
    for (d, k), e in got.items():
        assert e == best_distance(items[k], texts[d], len(items[k])) <= len(items[k]) // 10


def test_edits_at_head_middle_and_tail(spark):
    items = [prose(n) for n in (90, 150, 240, 390, 950) for _ in range(6)]
    plant = [(k, rewritten(t, place, cut)) for k, t in enumerate(items) for place in ("head", "middle", "tail") for cut in (False, True)]
    check(spark, items, plant, 1)
    check(spark, items, [(k, spread(t)) for k, t in enumerate(items) for _ in range(3)], 0.97)


def test_short_items_are_met_exactly(spark):
    items = [prose(n) for n in (8, 11, 14, 22, 35, 50, 70) for _ in range(5)] + ["短い文章は一字だけ違う", "ab"]
    plant = [(k, f(t)) for k, t in enumerate(items) for f in (lambda t: t, spread, lambda t: rewritten(t, "head", True), lambda t: rewritten(t, "middle", False))]
    check(spark, items, plant, 1)


def every(text, step, at, how):
    """Every ``step``-th character changed, left out or followed by another one."""
    return "".join({"change": "z", "drop": "", "add": c + "z"}[how] if k % step == at else c for k, c in enumerate(text))


@pytest.mark.parametrize("how", ["change", "drop", "add"])
@pytest.mark.parametrize("at", [0, 4, 9])
def test_edits_at_even_distances(spark, how, at):
    # a tenth of the characters, and no white space at the ends
    items = ["a" + prose(n + 20)[: n - 2].strip().ljust(n - 2, "b") + "a" for n in (100, 150, 240, 390, 790) for _ in range(8)]
    check(spark, items, [(k, every(t, 10, at, how)) for k, t in enumerate(items)], 0.9)


def test_given_items_at_even_distances(spark):
    given = [normal(r.text).decode() for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    given = [t[: len(t) // 10 * 10 - 1] + "e" for t in given]  # whole tens, no white space at the end
    for at in (0, 4, 9):
        check(spark, given, [(k, every(t, 10, at, "change")) for k, t in enumerate(given)], 0.9)


def test_equal_to_brute_force(spark):
    """All pairs of documents and items, whatever the documents hold."""
    items = [prose(n) for n in (5, 15, 30, 60, 100, 130, 180)] + ["短い文章は一字だけ違うものです", "é" * 12, "", "  "]
    texts = [None, "", "x", prose(4000), "a" * 3000]
    for t in items[:-2]:
        texts += [t, f"{prose(50)}\n\t{spread(t)}  {prose(40)}", prose(80) + rewritten(t, "middle", True), t[: len(t) * 9 // 10], t[len(t) // 10 :] + t, spread(spread(t))]
    docs = [(k, t, 1) for k, t in enumerate(texts)] + [(None, items[4], 1), (3, texts[3], 1)]
    bench = [(k, t, 2) for k, t in enumerate(items)] + [(None, items[4], 2), (1, items[1], 2)]
    got = {(r.doc_id, r.item_id): r.edit_distance for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string, item long"), spark.createDataFrame(bench, "item_id long, text string, d int")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            plain, most = normal(item).decode(), len(normal(item).decode()) // 10
            if plain and (e := best_distance(plain, normal(t).decode(), most)) <= most:
                want[d, k] = e
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and all(want[x] == e for x, e in got.items())


def test_very_long_texts(spark):
    item = prose(300)
    docs = spark.createDataFrame([(1, "the same word " * 150_000 + spread(item) + " tail" * 50_000), (2, "ab" * 1_000_000)], "doc_id long, text string")
    found = contaminated(docs, spark.createDataFrame([(7, item), (8, "the same word the same word the same word"), (9, "ab" * 50)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 7), (1, 8), (2, 9)]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2000)
    monkeypatch.setattr(decontaminate, "SCAN", 5000)
    items = [prose(200) for _ in range(40)]
    check(spark, items, [(k, rewritten(t, "head", False)) for k, t in enumerate(items)], 1)


def test_counts_in_turns_change_nothing(monkeypatch):
    items = tuple((k, prose(n)) for k, n in enumerate([40, 70, 90, 150, 240, 390] * 4)) + ((90, "ab"), (91, "短い文章は一字だけ違う" * 12))
    texts = [prose(60) for _ in range(20)] + [f"{prose(700)} {spread(t)} {prose(900)} {t}" for _, t in items] + ["", "x", prose(30_000)]
    block, data = decontaminate.Block(items, 0.1), [decontaminate.normal(t) for t in texts]
    at_once = sorted(block.find(data))
    monkeypatch.setattr(decontaminate, "COUNTS", 300)
    monkeypatch.setattr(decontaminate, "STARTS", 70)
    assert sorted(block.find(data)) == at_once
    # the items' own copies are there, and nothing that brute force does not find
    assert {(20 + k, k) for k in range(len(items))} <= {(d, i) for d, i, _ in at_once}
    for d, i, e in at_once:
        item = items[i][1]
        assert e == best_distance(item, data[d].decode(), len(item)) <= len(item) // 10
    assert list(block.find(["".encode()])) == []
