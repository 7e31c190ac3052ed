"""Document names, shared facts and certain duplicates."""

import datetime as dt

from pyspark.sql import functions as F

from riverbed.operators import grouping


def test_document_names(spark):
    names = ["中华人民共和国矿产资源法（2024年修订）（征求意见稿）", "中华人民共和国矿产资源管理条例（试行）", "矿产　资源\n管理·条例(试行)", "通知", "人民日报海外版", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k")
    assert [r[0] for r in df.select(grouping.document_key(F.col("n"))).collect()] == ["矿产资源法", "矿产资源管理条例", "矿产资源管理条例", None, None, None]
    df = spark.createDataFrame([("关于《矿产资源 开采登记管理办法》和《三体》、《矿产资源开采登记管理办法》",), (None,)], "t string")
    assert [r[0] for r in df.select(grouping.document_keys(F.col("t"))).collect()] == [["矿产资源开采登记管理办法"], []]


def test_certain_duplicates(spark):
    a, b = dt.datetime(2024, 1, 1, 15, 59), dt.datetime(2024, 1, 1, 16, 1)
    rows = [(0.92, a, a, "x", "x", True, False), (0.91, a, a, "x", "x", True, False), (0.95, a, b, "x", "x", True, False), (0.95, a, a, "x", "y", True, False), (0.95, a, a, None, "y", False, True), (0.95, a, a, "x", "x", False, None), (None, a, a, "x", "x", True, True)]
    df = spark.createDataFrame(rows, "c double, a timestamp_ntz, b timestamp_ntz, x string, y string, t boolean, d boolean")
    got = df.select(grouping.certain_duplicate(F.col("c"), (F.col("a"), F.col("b")), (F.col("x"), F.col("y")), F.col("t"), F.col("d"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False, False]
