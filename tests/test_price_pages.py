"""Pages cut at their tags are read as the parser reads them."""

import random

from measured import shuffled
from riverbed.sources import prices


def _parsed(html):
    page = prices._Cells()
    page.feed(html)
    page.close()
    return page.tables


def test_cut_pages_equal_the_parser():
    rng = random.Random(8)
    bits = ["<table>", "</table>", "<TR>", "</tr>", "<td>", "<td rowspan=2>", "<th colspan='3' x>", '<td class="a b" ROWSPAN="0">', "</td>", "</th>", "<p>", "<b>", "</b>", "x", " 1,000 ", "\n", "a > b"]
    odd = ["<br/>", "&amp;", "<!-- <td> -->", "<script><td></script>", "a < b", "</td x>", "<td", "<td a='<'>", "<title>", "<td a=1 a=2>", '<td rowspan="2"colspan=2>']
    for k in range(3000):
        html = "".join(rng.choice(bits + odd if k % 2 else bits) for _ in range(rng.randint(0, 25)))
        assert prices._read(html).tables == _parsed(html), html


def test_cells_are_not_shuffled(spark):
    head, row = "<table><tr><td>N<td>U<td>V</tr>", "<tr><td>x<td>kg<td>1,{}</tr>"
    pages = spark.createDataFrame([(k, head + "".join(row.format(i) for i in range(20)) + "</table>") for k in range(100)], "page long, html string")
    got, records = shuffled(spark, lambda: prices.table_prices(pages, ["N", "U", "V"]).collect())
    assert len(got) == 2000 and records == 0  # 2,100 rows and more before
