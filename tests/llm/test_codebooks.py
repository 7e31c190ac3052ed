"""Vector codes against a plain version that compares every part with every entry."""

import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest

from riverbed.llm import codebooks
from riverbed.llm.codebooks import Tree, compress

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import same  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    wide = len(whole[0]) // 16
    cut = [[w[p * wide : (p + 1) * wide] for p in range(16)] for w in whole]
    books = [[cut[e][p] for e in range(min(64, len(cut)))] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(2):
        fresh = []
        for p in range(16):
            mine = {}
            for c in cut:
                mine.setdefault(near(c[p], books[p])[1], []).append(c[p])
            fresh.append([[sum(x) // len(mine[k]) for x in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])])
        books = fresh
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(16)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, la), e in zip(kept, errors):
        labels[la] = labels.get(la, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[la], sha) for (i, _, la), f, e in zip(kept, found, errors)), key=str)


def rows_of(n, wide, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(wide)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def got(spark, rows):
    return sorted((tuple(r) for r in compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_equal_to_the_plain_version(spark):
    rows = rows_of(300, 32, 1)
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] + [0.0] * 31, 0), (1003, [float("inf")] + [0.0] * 31, 0)]
    rows += [(2000 + i, rows[5][1], i % 2) for i in range(100)] + [rows[7], rows[7]]
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_ties_and_few_rows(spark):
    coarse = [(i, [random.Random(i).randint(-2, 2) / 256 for _ in range(64)], 0) for i in range(200)]
    assert got(spark, coarse) == plain(coarse)
    assert got(spark, coarse[:5]) == plain(coarse[:5])
    assert got(spark, [(1, None, 0)]) == [] and got(spark, []) == []


def test_odd_rows(spark):
    mixed = [(5, [1.0] * 16, 0), (9, [2.0] * 32, 0), (None, [3.0] * 16, None)]
    assert [(r[0], r[1]) for r in got(spark, mixed)] == [(5, "00" * 16), (None, "01" * 16)]
    uneven = got(spark, [(1, [0.5] * 20, 0), (2, [0.25] * 20, 0)])
    assert [(r[1], r[2]) for r in uneven] == [("00" * 16, 0), ("01" * 10 + "00" * 6, 0)]
    huge = got(spark, [(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0)])
    assert [r[2] for r in huge] == [0, 0]
    clash = spark.createDataFrame([(1, [1.0] * 16, 0, "x", 5)], SCHEMA + ", code string, id long")
    assert compress(clash).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and compress(clash).count() == 1


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_tree_finds_what_a_scan_finds(span):
    rng = np.random.default_rng(span)
    for n in (1, 2, 5, 63, 64):
        entries, points = rng.integers(-span, span + 1, (n, 4)), rng.integers(-span, span + 1, (500, 4))
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = Tree(entries).nearest(points)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_one_batch_or_many(spark, monkeypatch):
    rows = rows_of(120, 16, 4)
    before = got(spark, rows)
    monkeypatch.setattr(codebooks, "ROWS", 7)
    assert got(spark, rows) == before


def test_equal_to_its_sql(spark):
    from riverbed.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    assert same(queries()["op13_vector_codes"](spark, sf), sf, oracle_sql()["op13_vector_codes"]) is None
