"""Words of texts with separators at either end, or with nothing else; no function is called for each word."""

from pyspark.sql import functions as F
from riverbed.llm.common import words_of


def test_words(spark):
    df = spark.createDataFrame([("  a\t\nb\x0b",), ("",), (" \r\f",), ("a",), ("é  x y ",)], "t string").select(words_of(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["a", "b"], [], [], ["a"], ["é", "x y"]]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
