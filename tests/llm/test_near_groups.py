"""Near links against all pairs: a large group of edited copies, and lines around the threshold."""

import random

import numpy as np
from riverbed.llm import near
from riverbed.llm.line_dedup import dedup_lines


def components(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_one_bucket_of_edited_copies(spark, monkeypatch):
    """All sets share one bucket; small groups are not compared directly, so every bound is at work."""
    monkeypatch.setattr(near, "FEW", 1)
    rng = random.Random(12)
    bases, sets = [list(range(k * 1000, k * 1000 + 100)) for k in range(3)], []
    bases[1][:60] = bases[0][:60]
    for k in range(260):
        items = set(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 3, 6, 10, 14, 18))):
            kind = rng.random()
            if kind < 0.7:
                items.discard(rng.choice(sorted(items)))
            if kind > 0.3:
                items.add(rng.randrange(5000, 5300))
        sets.append(sorted(items))
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    held = np.zeros((len(sets), 6000), np.int32)
    for k, s in enumerate(sets):
        held[k, s] = 1
    both, size = held @ held.T, held.sum(axis=1)
    linked = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size[None, :] - both), 1))
    want = components(len(sets), linked.tolist())
    assert len(linked) < len(sets) ** 2 // 4 and len(set(want)) > 20  # most pairs are no links
    members = spark.createDataFrame([(1, k) for k in range(len(sets))], "bucket long, id long")
    items = spark.createDataFrame([*enumerate(sets)], "id long, items array<long>")
    links, groups = near.near_links(members, items, lambda ids: items.join(ids, "id", "left_semi"), 80, None)
    found = {r.node: r.component for r in groups.collect()}
    assert [found.get(k, k) for k in range(len(sets))] == want
    true = {tuple(x) for x in linked.tolist()}
    assert all((min(r.a, r.b), max(r.a, r.b)) in true for r in links.collect())


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def test_lines_around_the_threshold(spark):
    """Each line has one edited copy; the exact similarity decides, and at least nine in ten links are found."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    lines, near_pairs, far_pairs = [], [], []
    for k in range(400):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))
        copy = list(line)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = rng.choice("0123456789")
        copy = "".join(copy)
        a, b = shingles(line), shingles(copy)
        share = len(a & b) / len(a | b)
        if 0.7 <= share < 0.9:
            (near_pairs if share >= 0.8 else far_pairs).append(2 * k + 1)
        lines += [line, copy]
    assert len(near_pairs) > 60 and len(far_pairs) > 40
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    removed = {r.doc_id for r in dedup_lines(docs).collect() if r.n_removed}
    assert not removed & set(far_pairs)
    assert len(removed & set(near_pairs)) >= 0.9 * len(near_pairs)


def test_short_and_blank_lines(spark):
    docs = spark.createDataFrame([(1, "}\n\n}\nYes."), (2, "Yes.\n\n No ."), (3, "No.")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in dedup_lines(docs).collect()}
    assert got == {1: "}\n\nYes.", 2: "\n No .", 3: "No."}
