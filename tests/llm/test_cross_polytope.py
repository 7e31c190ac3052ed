"""Nearest vectors against all pairs."""

import random

import numpy as np
import pytest

from riverbed.llm import cross_polytope
from riverbed.llm.cross_polytope import nearest, rotated, shape_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, count=20, every=20):
    kept = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in kept if i % every == 0):
        others = sorted((-float((kept[q] * v).sum()), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))
        out[q] = [(i, -s) for s, i in others[:count]]
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in nearest(df, df.vec_id % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(found, best):
    assert set(found) <= set(best)
    hit = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in b}) for q, b in best.items())
    return hit / sum(map(len, best.values()))


def right_scores(found, rows):
    kept = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v is not None}
    for q, answers in found.items():
        assert len({i for i, _ in answers}) == len(answers) <= 20 and q not in dict(answers)
        assert answers == sorted(answers, key=lambda a: (-a[1], a[0]))
        for i, s in answers:
            assert s == pytest.approx(float((kept[q] * kept[i]).sum()), abs=1e-12)


def random_rows(n, wide, seed, unit=True):
    x = np.random.default_rng(seed).normal(size=(n, wide))
    x /= np.linalg.norm(x, axis=1)[:, None] if unit else np.random.default_rng(seed + 1).uniform(0.02, 3, (n, 1))
    return [(i, r) for i, r in enumerate(x.tolist())]


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_tables(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = got(spark, rows)
    assert recall(found, plain(rows)) >= 0.9
    right_scores(found, rows)


def test_recall_with_lengths_of_their_own(spark):
    rows = random_rows(3000, 32, 5, unit=False)
    found = got(spark, rows)
    assert recall(found, plain(rows)) >= 0.9
    right_scores(found, rows)


def test_copies_and_near_copies(spark, monkeypatch):
    rows = random_rows(1500, 16, 7)
    rng = random.Random(8)
    rows += [(5000 + i, rows[3][1]) for i in range(700)]
    near = [(8000 + i, [x + rng.gauss(0, 0.01) for x in rows[9][1]]) for i in range(700)]
    rows += near
    rng.shuffle(rows)
    best, found = plain(rows), got(spark, rows)
    # all of the copies' best are the smallest other ids
    assert all(found[q] == best[q] for q in best if 5000 <= q < 5700)
    assert recall(found, best) >= 0.9
    monkeypatch.setattr(cross_polytope, "BLOCK", 50)
    assert got(spark, rows) == found
    monkeypatch.setattr(cross_polytope, "HOT", 0)
    assert got(spark, rows) == found


def test_odd_rows(spark):
    assert got(spark, []) == {} and got(spark, [(20, [1.0, 0.0])]) == {}
    rows = [(None, [1.0, 2.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (20, [1.0, 0.0, 1.0]), (40, [-1.0, 0.0]), (60, [])]
    found = got(spark, rows)
    assert found == {0: [(1, 2.0), (2, 2.0), (40, -1.0)], 40: [(2, 0.0), (0, -1.0), (1, -2.0)]}
    clash = spark.createDataFrame([(0, [1.0], 0, 1, 2.0), (1, [3.0], 0, 1, 2.0)], SCHEMA + ", id int, score double")
    assert [tuple(r) for r in nearest(clash, clash.vec_id == 0).collect()] == [(0, 1, 1, 3.0)]


def test_rotations_keep_lengths_and_shapes_grow():
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    y = rotated(x, 3, 1)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-5) and np.allclose(x @ x.T, y @ y.T, atol=1e-3)
    assert (rotated(x[:7], 3, 1) == y[:7]).all()
    sizes = [np.prod([2 * a for a in shape_of(n, 64)[0]]) for n in (1, 500, 10_000, 51_200, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[3] == 128 and all(p <= max(1, s) for s, (_, p) in zip(sizes, (shape_of(n, 64) for n in (1, 500, 10_000, 51_200, 10**6, 10**9))))
