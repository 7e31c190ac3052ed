"""Phrases against a scan, tables with spans, fixings."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riverbed.operators import phrases
from riverbed.sources import prices


def test_equal_to_a_scan(spark, tmp_path):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["a", "b", "the", "the", "the", "mine", "Río", "x1"]) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(100, None), (None, "a b"), (101, "the " * 500), (102, "A-b, THE!")]
    phrases.build(spark.createDataFrame(texts, "doc long, text string"), str(tmp_path / "index"))
    asked = [(k, " ".join(rng.choice(["a", "b", "the", "mine", "RÍO", "x1"]) for _ in range(rng.randint(1, 4)))) for k in range(40)] + [(50, "nowhere the"), (51, ""), (52, None), (53, "the the"), (53, "the the"), (54, "a b the")]
    index = phrases.load(spark, str(tmp_path / "index"))
    found = [tuple(r) for r in phrases.search(index, spark.createDataFrame(asked, "phrase long, text string")).collect()]
    want = set()
    for p, t in asked:
        words = (t or "").lower().split()
        for d, text in texts:
            have = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
            want |= {(p, d, i) for i in range(len(have) - len(words) + 1) if words and d is not None and have[i : i + len(words)] == words}
    assert set(found) == want and len(found) == len(want) and len(want) > 500
    # the same index serves another search
    assert phrases.search(index, spark.createDataFrame([(1, "A B the")], "phrase long, text string")).filter("doc = 102").count() == 1


def test_typed_phrases(spark):
    texts = ["The Alpha Ridge project and mina Del Sol; Decreto Nº 12/2024, Ley 24.196", "project The Bravo, Charlie Corp mine, mine El", "推进 Delta项目", None, "project One. project Two. project Three. project Four"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", phrases.anchors(F.col("t")).alias("a")).orderBy("k")
    got = [[(a.kind, a.text) for a in r.a] for r in df.collect()]
    assert got[0] == [("project", "Alpha Ridge"), ("mine", "Del Sol"), ("document", "12/2024")]
    assert got[1] == [("project", "Bravo")] and got[2] == [("project", "Delta")] and got[3] == [] and len(got[4]) == 3


def test_spans_are_laid_out(spark):
    html = "<table><tr><th>N</th><th colspan=2>U</th></tr><tr><td rowspan=2>a<td>1<td>2</tr><tr><td>3</td><td rowspan='9'>4</td></tr><tr><td colspan=0>b</td></tr></table><table><tr><td><table><td>in</table> out</td></tr></table><table></table>"
    first, second, third, empty = prices.grids(html)
    grid = {(y, x): t for y, x, t in first}
    assert [[grid.get((y, x)) for x in range(3)] for y in range(4)] == [["N", "U", "U"], ["a", "1", "2"], ["a", "3", "4"], ["b", None, "4"]]
    assert second == [(0, 0, "out")] and third == [(0, 0, "in")] and empty == [] and prices.grids(None) == []
    pages = [(1, "<table><tr><td>N<td>U<td>V</tr><tr><td>x<td rowspan=2>kg<td>1,000.5</tr><tr><td>y<td>2</tr></table>" * 2), (2, "<table><tr><td>N<td>U<td>V</tr><tr><td>x<td>kg<td>1</tr></table><table><tr><td>N<td>U<td>V</tr><tr><td>x<td>kg<td>9</tr></table>"), (3, "<table><tr><td>Z</table>"), (4, None)]
    got = prices.table_prices(spark.createDataFrame(pages, "page long, html string"), ["N", "U", "V"]).collect()
    assert sorted(map(tuple, got)) == [(1, "x", "kg", "1000.5", False), (1, "y", "kg", "2", False), (2, "x", "kg", "1", True)]


def test_fixings(spark):
    xml = '<Metall FromDate="a"><Record Date="02.03.2024" Code="1"><Buy>1,5</Buy><Sell>1,5</Sell></Record><Record Date="01.03.2024" Code="2"><Buy>1,5</Buy><Sell>1,6</Sell></Record><Record Date="31.02.2024" Code="3"><Buy>1</Buy></Record><Record Date="01.01.2024" Code="4"><Buy>7</Buy><Sell>7</Sell></Record></Metall>'
    got = prices.fixings(spark.createDataFrame([(1, xml), (2, "broken"), (3, None), (4, "<Metall/>")], "file long, xml string")).collect()
    assert sorted(map(tuple, got)) == [(1, dt.date(2023, 12, 31), "4", "7", "not a decimal with a comma"), (1, dt.date(2024, 2, 29), "2", "1.5", "buy and sell differ"), (1, dt.date(2024, 3, 1), "1", "1.5", None)]
