"""The prefix trie against a plain one of dictionaries, and against its SQL."""

import hashlib
import os
import random
import sys
import zlib

import pytest

from riverbed.llm.prefix_trie import prefix_trie, rebuilt

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import same  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0, digest(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = own.get(base, [])[:h] + ts[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq)))
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(k)))
        least = min(c for c, _ in m)
        parent = min(c for c, _ in members[k[:-1]]) if k else None
        out.append((least, len(k), parent, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=None):
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))
        return sorted((tuple(r) for r in df.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def some(seed, n, words, longest=7):
    rng = random.Random(seed)
    ids = rng.sample(range(-300, 3000), n)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in ids for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("parts", [None, 3, 40])
def test_equal_to_a_plain_trie(spark, parts):
    few = some(1, 120, ["a", "bb", "", None])
    many = some(2, 60, [f"text {i}" for i in range(50)])
    copies = [(5000 + c, t, "user", f"same {t}") for c in range(70) for t in range(9)]
    near = [(7000 + c, t, "user", f"same {t}" if t < 8 else f"own {c}") for c in range(70) for t in range(9)]
    long = [(9000 + c, t, "user", "x" * (t % 5)) for c in range(4) for t in range(150 + 30 * c)]
    rows = few + many + copies + near + long
    random.Random(3).shuffle(rows)
    assert got(spark, rows, parts) == plain(rows)


def test_odd_rows(spark):
    assert got(spark, []) == []
    rows = [(None, 1, "user", "gone"), (7, None, "user", "first"), (7, 1, None, None), (7, 1, None, None), (7, 2, "é", "ü" * 3), (200, 0, "user", "only"), (203, 0, "user", "short"), (-5, 3, "u", "minus")]
    rows += [(300, 0, "a", "bc"), (307, 0, "ab", "c"), (309, 1, "user", "y" * 200_000)] + [(400 + i, 5, "t", f"tie {i % 2}") for i in range(6) for _ in range(2)]
    assert got(spark, rows) == plain(rows)
    clash = spark.createDataFrame([(*r, 1, "x", [1]) for r in rows], SCHEMA + ", n long, key string, turns array<int>")
    assert sorted((tuple(r) for r in prefix_trie(rebuilt(clash)).collect()), key=str) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # the block's first conversation is absent, and the own turns are fewer than the head
    ids = [c for c in range(1001, 1099) if zlib.crc32(str(c).encode()) % 6 >= 2][:10]
    rows = [(c, 0, "user", "hello") for c in ids]
    assert got(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_equal_to_its_sql(spark):
    from riverbed.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    assert same(queries()["op11_prefix_trie"](spark, sf), sf, oracle_sql()["op11_prefix_trie"]) is None
