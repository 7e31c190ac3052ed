"""Line similarity reads every character of a line."""

import random

from riverbed.llm.line_dedup import dedup_lines
from riverbed.llm.near import near_links


def test_long_words_are_read_whole(spark):
    rng = random.Random(7)
    run = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    head, same = run(8), run(150)
    texts = [head + run(140), head + run(140), "T" + same, "G" + same]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}  # one shingle in common is no near line; all but one are


def test_fringe_at_exactly_two_distances(spark):
    """The leader's own 1 and the far 2 are linked; 2 is at exactly 0.6 from the leader."""
    sets = {0: [*range(8)], 1: [*range(10)], 2: [*range(2, 10)]}
    assert len({*sets[0]} & {*sets[2]}) * 100 == 60 * len({*sets[0]} | {*sets[2]})
    members = spark.createDataFrame([(1, k) for k in sets], "bucket long, id long")
    items = spark.createDataFrame([*sets.items()], "id long, items array<long>")
    _, groups = near_links(members, items, lambda ids: items.join(ids, "id", "left_semi"), 80, None)
    assert {r.node: r.component for r in groups.collect()} == {0: 0, 1: 0, 2: 0}
