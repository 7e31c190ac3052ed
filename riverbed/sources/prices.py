"""Price sources: tables of HTML pages laid out to grids, and fixings in XML."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Cells that a span may reach over in a row or a column; larger ones are cut to it, as browsers do (fixed values).
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Cells(HTMLParser):
    """The tables of a page in the order of their begin: rows of ``(text, rows, columns)``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[list[list[list]]] = []
        self.cells: list[list | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
            self.cells.append(None)
        elif self.open and tag == "tr":
            self.open[-1].append([])
            self.cells[-1] = None
        elif self.open and tag in ("td", "th"):
            span = lambda name, most: min(max(int(v), 0 if name == "rowspan" else 1), most) if (v := (dict(attrs).get(name) or "").strip()).isdigit() else 1
            if not self.open[-1]:
                self.open[-1].append([])
            self.cells[-1] = ["", span("rowspan", MOST_ROWS), span("colspan", MOST_COLUMNS)]
            self.open[-1][-1].append(self.cells[-1])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.cells.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.cells[-1] = None

    def handle_data(self, data):
        if self.open and self.cells[-1] is not None:
            self.cells[-1][0] += data


#: A tag that a page can be cut at; pages with anything else in angle brackets, or with references, are parsed sign by sign.
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \n\t]+[A-Za-z-]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[A-Za-z0-9_-]+))?)*)[ \n\t]*>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:=(?:"([^"]*)"|'([^']*)'|([A-Za-z0-9_-]+)))?""")
#: Tags behind which no other tags count (fixed names).
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _read(html: str) -> _Cells:
    """The page's cells; plain pages are cut at their tags, which is several times faster than the parser."""
    page = _Cells()
    parts = _TAG.split(html)
    names = [t.lower() for t in parts[2::4]]
    if "&" in html or any("<" in text for text in parts[::4]) or not _RAW.isdisjoint(names) or any(a for end, a in zip(parts[1::4], parts[3::4], strict=True) if end):
        page.feed(html)
        page.close()
        return page
    page.handle_data(parts[0])
    for end, name, attributes, text in zip(parts[1::4], names, parts[3::4], parts[4::4], strict=True):
        if end:
            page.handle_endtag(name)
        else:
            page.handle_starttag(name, [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)] if attributes else ())
        if text:
            page.handle_data(text)
    return page


def grids(html: str | None) -> list[list[tuple[int, int, str]]]:
    """``(row, column, text)`` of each table, a cell repeated wherever its spans reach.

    A row span of 0 reaches to the table's end.  Where two cells would share a place, the
    first keeps it.  White space is collapsed.
    """
    page = _read(html or "")
    out = []
    for rows in page.tables:
        taken: dict[tuple[int, int], str] = {}
        for r, cells in enumerate(rows):
            c = 0
            for text, down, across in cells:
                plain = " ".join(text.split())
                while (r, c) in taken:
                    c += 1
                down = min(down or len(rows), len(rows) - r)
                for y in range(r, r + down):
                    for x in range(c, c + across):
                        taken.setdefault((y, x), plain)
                c += across
        out.append([(y, x, t) for (y, x), t in sorted(taken.items())])
    return out


class TableCells:
    """``tab, row, col, text`` of a page's tables."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from ((k, y, x, t) for k, cells in enumerate(grids(html)) for y, x, t in cells)


def priced(html: str | None, header: list[str]) -> tuple[list[tuple[str, str, str]], bool]:
    """The rows of a page's first table with the header that has any, and whether another one has others."""
    copies = []
    for cells in grids(html):
        rows: dict[int, list[str]] = {}
        for y, x, text in cells:
            if x < 3:
                rows.setdefault(y, [""] * 3)[x] = text if x < 2 else text.replace(",", "")
        if rows.get(0) == [header[0], header[1], header[2].replace(",", "")]:
            if body := [(y, *row) for y, row in rows.items() if y > 0 and row[0] != ""]:
                copies.append(body)
    return ([row[1:] for row in copies[0]], any(c != copies[0] for c in copies)) if copies else ([], False)


def register(spark: SparkSession) -> None:
    """Name the table function for SQL: ``LATERAL table_cells(html)``."""
    spark.udtf.register("table_cells", udtf(TableCells, returnType="tab int, row int, col int, text string"))


def table_prices(pages: DataFrame, header: list[str]) -> DataFrame:
    """``page, name, unit, value, held`` from the tables whose first cells are the header's.

    ``pages``: page, html.  The header's three cells head the columns of names, units and
    values.  A page may repeat its table: the first copy counts, and ``held`` says that another one
    has other rows.  Thousands commas are left out of values; pages without such a table
    have no rows.
    """
    register(pages.sparkSession)

    # a page's tables stay in one row, so no cell is shuffled
    @F.arrow_udf("struct<rows: array<struct<name: string, unit: string, value: string>>, held: boolean>")
    def read(html: pa.Array) -> pa.Array:
        found = [priced(h, header) for h in html.to_pylist()]
        ends = pa.array(itertools.accumulate((len(rows) for rows, _ in found), initial=0), pa.int32())
        cells = pa.StructArray.from_arrays([pa.array([r[k] for rows, _ in found for r in rows], pa.string()) for k in range(3)], ["name", "unit", "value"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, cells), pa.array([held for _, held in found], pa.bool_())], ["rows", "held"])

    found = pages.filter("page is not null").select("page", read("html").alias("f"))
    return found.select("page", F.explode("f.rows").alias("r"), "f.held").select("page", "r.name", "r.unit", "r.value", "held")


_FIXING = "_FromDate string, Record array<struct<_Date string, _Code string, Buy string, Sell string>>"
#: Decimals with a comma, as the source writes them (a fixed pattern).
_COMMA = r"^\d+,\d+$"


def source_day(text: Column) -> Column:
    """A ``DD.MM.YYYY`` day, or null for what is none."""
    return F.when(text.rlike(r"^\d{2}\.\d{2}\.[1-9]\d{3}$"), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")).cast("date"))


def fixings(files: DataFrame) -> DataFrame:
    """``file, fixing, code, value, held`` of fixings in XML: records with a day, a code, a buying and a selling price.

    ``files``: file, xml.  A record takes effect on its day and was fixed the day before.  The value
    is the buying price with a point; ``held`` names what is wrong with it: another
    selling price, or no decimal with a comma.  Records without a real day and files that
    are no such XML have no rows.
    """
    read = files.select("file", F.explode(F.from_xml("xml", _FIXING)["Record"]).alias("r"))
    buy, sell = (F.coalesce(F.trim(F.col(f"r.{n}")), F.lit("")) for n in ("Buy", "Sell"))
    wrong = F.array_compact(F.array(F.when(buy != sell, F.lit("buy and sell differ")), F.when(~buy.rlike(_COMMA) | ~sell.rlike(_COMMA), F.lit("not a decimal with a comma"))))
    day = source_day(F.col("r._Date"))
    return read.filter(day.isNotNull()).select("file", F.date_sub(day, 1).alias("fixing"), F.col("r._Code").alias("code"), F.replace(buy, F.lit(","), F.lit(".")).alias("value"), F.nullif(F.array_join(wrong, "; "), F.lit("")).alias("held"))
