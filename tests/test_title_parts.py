"""Near titles of large blocks meet part by part."""

import random

import pytest
from measured import shuffled
from riverbed.operators import similarity


def _brute(rows, least):
    sets = {}
    for k, t, *b in rows:
        plain = "".join(c for c in (t or "").lower() if c.isalnum())[:300]
        if len(plain) > 1:
            at = (*b, plain)
            sets[at] = min(k, sets.get(at, k))
    made = [(b, k, {p[i : i + 2] for i in range(len(p) - 1)}) for (*b, p), k in sets.items()]
    out = {}
    for i, (b, k, x) in enumerate(made):
        for c, m, y in made[:i]:
            if b == c and len(x & y) / len(x | y) >= least:
                out[min(k, m), max(k, m)] = round(len(x & y) / len(x | y), 6)
    return out


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
@pytest.mark.parametrize("wide", [False, True])
def test_parts_against_brute_force(spark, monkeypatch, wide, least):
    monkeypatch.setattr(similarity, "TITLES", 20)
    if wide:
        monkeypatch.setattr(similarity, "PLACES", 16)
    rng = random.Random(5)
    letters = "abcdefgh" if not wide else "abcdefghγδ𝒳字"
    rows = []
    for k in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 40, 60])))
        if rows and rng.random() < 0.5:
            t = rows[-1][1][: rng.randint(0, 60)] + t[:3]
        rows.append((k, t, rng.choice(["x", "x", "x", None])))
    rows.append((400, None, "x"))
    got = similarity.title_pairs(spark.createDataFrame(rows, "id long, title string, s string"), ["s"], least).collect()
    want = _brute(rows, least)
    assert {(r.a, r.b): r.score for r in got} == want and len(got) == len(want)
    assert least == 1.0 or len(want) > 20


def test_titles_are_not_shuffled_by_their_pairs(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), "s") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, title string, s string")
    got, records = shuffled(spark, lambda: similarity.title_pairs(df, ["s"], 0.6).collect())
    assert got == [] and records < 5_000  # a row for each character pair made 400,000 and more
