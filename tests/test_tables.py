"""Text diffs against a plain shortest script, and the table functions in SQL."""

import random

from pyspark.sql import functions as F

from riverbed.operators import diff
from riverbed.sources import tables


def edits(a, b):
    """The fewest insertions and deletions, by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def applied(spans):
    return "".join(t for op, t in spans if op != "insert"), "".join(t for op, t in spans if op != "delete")


def test_spans_give_both_texts():
    rng = random.Random(1)
    words = ["a", "bb", " ", "  ", "\n", "中", "文", "x1", ",", "é", "かな", "\u0301"]
    for _ in range(400):
        old = "".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        new = "".join(w if rng.random() > 0.2 else rng.choice(words) for w in diff.tokens(old) if rng.random() > 0.1) if rng.random() < 0.7 else "".join(rng.choice(words) for _ in range(20))
        assert "".join(diff.tokens(old)) == old
        for most in (1500, 3):
            spans = diff.spans(old, new, most)
            assert applied(spans) == (old, new) and all(t for _, t in spans)
            for (x, _), (y, _) in zip(spans, spans[1:]):
                assert x != y and (x, y) != ("insert", "delete")
        a, b = diff.tokens(old), diff.tokens(new)
        runs = diff.equal_runs(a, b)
        assert len(a) + len(b) - 2 * sum(n for *_, n in runs) == edits(a, b) and all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert diff.equal_runs(a, b, edits(a, b)) is not None and (edits(a, b) == 0 or diff.equal_runs(a, b, edits(a, b) - 1) is None)


def test_changes_are_readable():
    assert diff.spans("same", "same") == [("equal", "same")] and diff.spans("", None) == [] and diff.spans(None, "x") == [("insert", "x")]
    assert diff.spans("the tax is two percent.", "the tax is three percent.") == [("equal", "the tax is "), ("delete", "two"), ("insert", "three"), ("equal", " percent.")]
    # a short stretch between two changes goes into them, a long one stays
    assert diff.spans("行使国家对", "代表国家行使") == [("delete", "行使国家对"), ("insert", "代表国家行使")]
    assert diff.spans("one word two", "1 word 2") == [("delete", "one"), ("insert", "1"), ("equal", " word "), ("delete", "two"), ("insert", "2")]
    # beyond the bound all between the common begin and end is changed
    assert diff.spans("head a b c d tail", "head w x y z tail", most=2) == [("equal", "head "), ("delete", "a b c d"), ("insert", "w x y z"), ("equal", " tail")]


def test_diff_column(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, None)], "x string, y string").select(diff.diff(F.col("x"), F.col("y")).alias("d"))
    assert [[(s.op, s.text) for s in r.d] for r in df.collect()] == [[("equal", "a "), ("delete", "b"), ("insert", "c")], []]


def test_table_functions(spark):
    tables.register(spark)
    texts = spark.createDataFrame([(1, '<a href="/x">X <b>y</b></a> <a>no</a><a href="http://z">Z</a>', "Title\nArticle 1 a\nArticle 2 b", "<rss><item><title><![CDATA[A & B]]></title><link>http://x/1</link></item><entry><title>T &amp; U</title><link href=\"http://y?a&amp;b\"/><id>9</id></entry><item></item></rss>"), (2, None, None, None)], "k long, html string, law string, feed string")
    got = spark.sql("SELECT t.k, l.* FROM {t} t, LATERAL html_links(t.html) l", t=texts).collect()
    assert [tuple(r) for r in got] == [(1, 0, "/x", "X y"), (1, 1, "http://z", "Z")]
    got = spark.sql("SELECT t.k, p.place, p.number, p.text FROM {t} t, LATERAL provisions(t.law) p", t=texts).collect()
    assert [tuple(r) for r in got] == [(1, 0, "head", "Title"), (1, 1, "1", "Article 1 a"), (1, 2, "2", "Article 2 b")]
    got = spark.sql("SELECT t.k, i.* FROM {t} t, LATERAL feed_items(t.feed) i", t=texts).collect()
    assert [tuple(r)[1:5] for r in got] == [(0, "A & B", "http://x/1", None), (1, "T & U", "http://y?a&b", "9"), (2, None, None, None)]


def test_provisions_rise_and_annexes_count_anew():
    from riverbed.operators import provisions

    law = "某法\n第一章 总则\n第一条 为了管理\n第九条 见下文\n第二条规定的除外\n“第三十条”如下\n第十条 施行\n第二章 附则\n第二十一条 完\n附件1：名录\n第一条 甲\n第二条 乙\n附件 本附件说明。\n附件2\n第一条 丙"
    got = provisions.split(law)
    assert [p[0] for p in got] == ["head", "1", "9", "10", "21", "附件-1/1", "附件-1/2", "附件-2/1"]
    text = {p[0]: p[1] for p in got}
    assert text["9"] == "第九条 见下文\n第二条规定的除外\n“第三十条”如下" and text["10"] == "第十条 施行" and text["head"] == "某法" and text["附件-1/2"] == "第二条 乙\n附件 本附件说明。"
    act = "Act\nChapter I\nArticle 1 a\nArticle 2 b\nArticle 1 refers back\nSchedule A\nArticle 1 c\nSchedule A\nArticle 1 d"
    assert [p[0] for p in provisions.split(act)] == ["head", "1", "2", "schedule-A/1", "schedule-A/1#2"] and provisions.split("") == [] and provisions.split(None) == []
