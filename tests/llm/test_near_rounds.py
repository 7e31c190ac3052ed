"""What large groups without links cost: buckets are settled one by one, not by all that meet one leader."""

import random

from riverbed.llm import near


def recorded(spark, monkeypatch, sets, buckets):
    """The components, and the tables of items that members have and their leaders have not."""
    written, cut = [], near.cut

    def noted(df, name):
        out = cut(df, name)
        written.extend([sum(len(r.rest) for r in out.select("rest").collect())] if name == "apart" else [])
        return out

    monkeypatch.setattr(near, "cut", noted)
    members = spark.createDataFrame([(b, k) for b, own in enumerate(buckets) for k in own], "bucket long, id long")
    items = spark.createDataFrame([*enumerate(sets)], "id long, items array<long>")
    _, groups = near.near_links(members, items, lambda ids: items.join(ids, "id", "left_semi"), 80, None)
    return {r.node: r.component for r in groups.collect()}, written


def test_buckets_of_two_lay_out_no_items(spark, monkeypatch):
    """One set meets forty others in a bucket each: every pair has been compared with that."""
    hub = list(range(20))
    others = [[*range(10), *range(100 * k, 100 * k + 10)] for k in range(1, 41)]
    got, written = recorded(spark, monkeypatch, [hub, *others], [(0, k) for k in range(1, 41)])
    assert (got, written) == ({}, [])


def test_large_buckets_of_the_same_sets_take_one_leader(spark, monkeypatch):
    """Set 0 leads the first and the third bucket; the second lacks it, its members meet it all the same."""
    sets = [[*range(20)], *([*range(20), *range(100 * k, 100 * k + 20)] for k in range(1, 41))]
    sets += [[*sets[7], 99_999], *([*range(10), *range(100 * k, 100 * k + 20)] for k in range(50, 100))]
    got, written = recorded(spark, monkeypatch, sets, [range(42), range(1, 42), [0, *range(42, 92)]])
    assert got == {7: 7, 41: 7}
    assert sum(written) <= 91 * 21  # each member's items once, not once for each bucket


def test_sets_that_share_a_passage_are_held_against_each_other_once(spark, monkeypatch):
    """Sets with one passage in common and no links took a round for each leader; no more is written now if their number grows."""
    written = {}
    for most in (60, 240):
        cut, rng, names = near.cut, random.Random(9), []
        sets = [[*range(60), *rng.sample(range(1000, 1400), 90)] for _ in range(most)]
        sets += [[*sets[k][:-2], 2000 + k] for k in range(0, most, 10)]
        monkeypatch.setattr(near, "cut", lambda df, name: names.append(name) or cut(df, name))  # noqa: B023
        members = spark.createDataFrame([(b, k) for b in range(3) for k in range(len(sets)) if k % 7 != b], "bucket long, id long")
        items = spark.createDataFrame([*enumerate(sets)], "id long, items array<long>")
        _, groups = near.near_links(members, items, lambda ids, items=items: items.join(ids, "id", "left_semi"), 80, None)
        monkeypatch.setattr(near, "cut", cut)
        want = {x: k for j, k in enumerate(range(0, most, 10)) for x in (k, most + j)}
        assert {r.node: r.component for r in groups.collect()} == want
        written[most] = len(names)
    assert max(written.values()) <= 25


def test_parts_of_a_large_bucket(spark, monkeypatch):
    """Every pair of a bucket that is dealt into parts is handed on once."""
    monkeypatch.setattr(near, "BLOCK", 5)
    monkeypatch.setattr(near, "LEADERS", 0)
    sets = [[*range(20)], *([*range(10), *range(100 * k, 100 * k + 20)] for k in range(1, 31))]
    sets += [[*sets[k], 99_999 + k] for k in range(1, 31)]
    pairs, cut = [], near.cut

    def noted(df, name):
        out = cut(df, name)
        pairs.extend([(r.a, r.b) for r in out.collect()] if name == "pairs" and not pairs else [])
        return out

    monkeypatch.setattr(near, "cut", noted)
    members = spark.createDataFrame([(b, k) for b in range(2) for k in range(len(sets))], "bucket long, id long")
    items = spark.createDataFrame([*enumerate(sets)], "id long, items array<long>")
    _, groups = near.near_links(members, items, lambda ids: items.join(ids, "id", "left_semi"), 80, None)
    assert {r.node: r.component for r in groups.collect()} == {x: k for k in range(1, 31) for x in (k, k + 30)}
    assert len(pairs) == len(set(pairs)) and {(k + 30, k) for k in range(1, 31)} <= set(pairs)
