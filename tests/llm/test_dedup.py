"""Deduplication operators against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter

from riverbed.llm.chunk_dedup import chunks, dedup_chunks
from riverbed.llm.components import components
from riverbed.llm.line_dedup import clean_lines, dedup_lines
from riverbed.llm.near_dup import near_duplicates
from riverbed.llm.substring_dedup import remove_repeats, shared_windows, segments

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, id int").repartition(4)


def samples(n):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit {n}").fetchall()]


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        yield len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    any_ = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    texts = samples(60)
    for passage in map(any_, (199, 200, 201, 350, 900)):
        texts += [any_(50) + passage + any_(80) for _ in range(3)]
    texts += [None, "", "a" * 199, "b" * 200, "c" * 201, "xyz" * 400, any_(100) + "xyz" * 300, any_(500), "d" * 3000]
    texts += [texts[3], texts[3][:400] + "!" + texts[3][400:], texts[70]]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats(texts, 200))
    assert remove_repeats(frame(spark, texts).filter("false")).collect() == []


def test_segments_cover_every_window():
    data = prose(3000).encode()
    runs = sorted((f, e) for first, last, *_ in segments(data, 200) for f, e in zip(first.tolist(), last.tolist(), strict=True))
    assert runs[0][0] == 0 and runs[-1][1] == len(data) - 200
    assert all(b[0] == a[1] + 1 for a, b in zip(runs, runs[1:]))


def test_column_order_finds_shared_windows():
    import numpy as np

    rng = np.random.default_rng(0)
    columns = rng.integers(0, 2, (40, 60)).astype(np.uint16)
    columns[:7, 3] = columns[35:, 8] = 256
    group = np.repeat(np.arange(6), 10)
    got = shared_windows(columns, group, 30, 10)
    for c in range(30):
        seen = Counter((g, tuple(w)) for g, w in zip(group, columns[c : c + 10].T, strict=True))
        for d in range(60):
            w = columns[c : c + 10, d]
            assert got[c, d] == (256 not in w and seen[group[d], tuple(w)] > 1)


def test_chunks_resist_shifts_and_rebuild():
    text = prose(400).encode()
    cut = list(chunks(text))
    assert b"".join(text[a:b] for a, b, _ in cut) == text
    moved = {d for *_, d in chunks(b"some words before " + text)}
    assert sum(d in moved for *_, d in cut) >= len(cut) - 3


def plain_chunks(data):
    """A byte at a time: the hash of the last 32 bytes ends a chunk of 32 to 1024 bytes."""
    from riverbed.llm.chunk_dedup import _GEAR

    out, start, h = [], 0, 0
    for i, c in enumerate(data):
        h = (h << 1) + int(_GEAR[c]) & 0xFFFFFFFF
        if i + 1 - start >= 32 and h < 1 << 27 or i + 1 - start == 1024:
            out.append((start, i + 1, data[start : i + 1]))
            start = i + 1
    return out + [(start, len(data), data[start:])] * (start < len(data))


def test_chunk_dedup_equals_brute_force(spark):
    passage = prose(60)
    texts = samples(40) + [None, "", "short", prose(50) + passage + prose(40), passage + prose(30), prose(300)]
    texts += [texts[2], texts[3] + texts[3], "z" * 5000, "short", "a common begin of some forty characters " + prose(90), "a common begin of some forty characters " + prose(90), prose(9000)]
    first = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert [data[a:b] for a, b, _ in chunks(data)] == [c for *_, c in plain_chunks(data)]
        for *_, c in plain_chunks(data):
            first.setdefault(c, i)
    got = {r.doc_id: r for r in dedup_chunks(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data, own, marks = (t or "").encode(), set(), bytearray(len(t.encode() if t else b""))
        for a, b, c in plain_chunks(data):
            if first[c] != i or c in own:
                marks[a:b] = b"x" * (b - a)
            own.add(c)
        spans = [(m.start(), m.end()) for m in re.finditer(b"x+", bytes(marks)) if m.end() - m.start() >= 96 or m.end() - m.start() == len(data)]
        kept = b"".join(data[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(data), 0)]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert got[44].n_shared_chunks > 0 and got[44].n_removed > 100 and got[45].n_removed == 0
    # a short copy goes whole, a short common begin stays
    assert got[49].n_removed == 5 and got[51].n_removed == 0
    assert dedup_chunks(frame(spark, texts).filter("false")).collect() == []


def test_null_ids_take_no_part(spark):
    text = prose(120)
    rows = spark.createDataFrame([(None, text), (None, text), (1, text), (2, text), (2, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in dedup_chunks(rows).collect()), key=str)
    assert got == [(1, 0), (2, len(text.encode())), (2, len(text.encode())), (None, 0), (None, 0)]
    # repeated strings count whatever the rows' ids are
    assert [r.n_removed for r in remove_repeats(rows).collect()] == [len(text.encode())] * 5


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(sets):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def edited(text, k, rng):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    texts = samples(60) + [None, "", " \n ", "one two", "ONE two", "one two three four five", "É É é"]
    base = prose(150, rng)
    texts += [edited(base, rng.randint(0, 4), rng) for _ in range(120)]  # a large group at all distances
    texts += [edited(prose(20, rng), 0, rng) for _ in range(5)] + [texts[5], texts[6].upper()]
    chain = prose(120, rng).split(" ")
    texts += [" ".join(chain[k * 3 : k * 3 + 80]) for k in range(10)]  # each near the next only
    got = {r.doc_id: r for r in near_duplicates(frame(spark, texts)).collect()}
    want = brute_groups([shingle_set(t) for t in texts])
    for i, t in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingle_set(t)), want[i], want[i] == i), t
    assert near_duplicates(frame(spark, texts).filter("false")).collect() == []


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b = prose(60), prose(60)
    df = spark.createDataFrame([(1, a), (1, a), (None, a), (None, a), (2, a), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_lines(spark):
    rng = random.Random(1)
    line, short = prose(30, rng), "Yes."
    near = edited(line, 1, rng)
    other = [prose(25, rng) for _ in range(4)]
    han = "".join(chr(0x4E00 + 7 * k) for k in range(90))
    texts = [f"{other[0]}\n{line}\n{short}", f"{near}\n{other[1]}\n{short}\n{other[1]}", line, None, "", f"{other[2]}\n\n{other[3]}", han, han + "、"]
    got = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    assert got[0].kept_text == texts[0] and got[5].kept_text == texts[5]
    assert got[1].kept_text == other[1] and got[1].n_removed == 3 and got[1].n_lines == 4
    assert got[2].kept_text == "" and got[2].n_removed == 1
    assert (got[3].kept_text, got[3].n_lines, got[4].kept_text) == ("", 1, "")
    assert got[6].n_removed == 0 and got[7].n_removed == 1
    kept = clean_lines(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "kept", "id"]
    assert {r.doc_id for r in kept.collect()} == {0, 1, 3, 4, 5, 6}
    nulls = spark.createDataFrame([(None, line), (None, line), (7, line)], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_lines(nulls).collect()) == [0, 0, 0]
    assert dedup_lines(frame(spark, texts).filter("false")).collect() == []


def test_line_groups_find_near_lines(spark):
    """Recall against the exact similarity of all pairs of edited lines."""
    rng = random.Random(8)
    lines = [prose(40, rng) for _ in range(150)]
    texts = [x for line in lines for x in (line, edited(line, 1, rng))]
    removed = sum(r.n_removed for r in dedup_lines(frame(spark, texts)).collect())
    assert removed >= 145


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None), (None, None)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in list(root)}
