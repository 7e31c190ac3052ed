"""Issues against a plain walk, copies by title and day."""

import datetime as dt
import random

from riverbed.operators import edition

SCHEMA = "issue string, id long, rank int, story long, importance double, source long, sources array<long>, mentions array<long>, previous boolean, commentary boolean, authority int"


def walk(entries):
    stories = {e["story"]: e for e in entries if e["story"] is not None}
    added, folded = {}, set()
    for e in entries:
        hosts = [stories[m] for m in e["mentions"] if m in stories and stories[m] is not e]
        if hosts:
            host = hosts[0]
            for h in hosts[1:]:
                host = h if h["importance"] > host["importance"] else host
            added.setdefault(host["id"], []).append(e)
            folded.add(e["id"])
    live = [dict(e, n=len(set(e["sources"]).union(*(a["sources"] for a in added.get(e["id"], [])))), folded=len(added.get(e["id"], []))) for e in entries if e["id"] not in folded]
    earns = lambda e: (not e["previous"] and not e["commentary"]) or (e["authority"] < 3 and not e["commentary"]) or e["n"] >= 3
    fresh, main, rest, used = any(map(earns, live)), [], [], {}
    for e in live:
        if len(main) < 12 and used.get(e["source"], 0) < 2 and (not fresh or earns(e)):
            main.append(e)
            used[e["source"]] = used.get(e["source"], 0) + 1
        else:
            rest.append(e)
    return [(part, k, e["id"], e["n"], e["folded"]) for part, some in (("main", main), ("flash", rest[:10])) for k, e in enumerate(some, 1)]


def test_equal_to_a_walk(spark):
    rng = random.Random(2)
    names, rows, want = [f.split(" ")[0] for f in SCHEMA.split(", ")], [], []
    for issue in range(12):
        n = rng.choice([0, 3, 20, 60])
        stories = rng.sample(range(1000 * issue, 1000 * issue + 200), n)
        entries = [dict(zip(names, (str(issue), 1000 * issue + k, k, rng.choice([stories[k], None]), rng.choice([1.0, 2.0, 3.0, 4.0]), rng.randint(0, rng.choice([3, 20])), [rng.randint(0, 9) for _ in range(rng.randint(0, 3))], [rng.choice(stories) for _ in range(rng.choice([0, 0, 0, 1, 2]))], issue % 3 == 0 or rng.random() < 0.5, issue % 3 == 0 or rng.random() < 0.3, 4 if issue % 3 == 0 else rng.randint(0, 5)), strict=True)) for k in range(n)]
        rows += [tuple(e[f] for f in names) for e in entries]
        want += [(str(issue), *r) for r in walk(entries)]
    rng.shuffle(rows)
    got = [(r.issue, r.part, r.place, r.id, r.n_sources, r.folded) for r in edition.arrange(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(want)


def test_copies(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "k", at(3), False), (2, "k", at(2), False), (3, "k", at(15), True), (4, "k", at(17), False), (5, None, at(2), True), (6, None, at(2), True), (7, "l", None, True), (8, "m", at(1), None), (9, "m", at(1), False)]
    got = {r.id: (r.keeper, r.copies) for r in edition.fold_copies(spark.createDataFrame(rows, "id long, key string, at timestamp_ntz, official boolean")).collect()}
    assert got == {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 2), 9: (8, 2)}
