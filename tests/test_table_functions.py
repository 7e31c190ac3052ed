"""Table functions over batches of texts."""

from riverbed.operators import provisions
from riverbed.sources import tables


def test_provisions_come_in_batches(spark):
    tables.register(spark)
    laws = ["Head\nArticle 1 a\nArticle 2 b\nAnnex 2\nArticle 1 c", None, "", "1. x\n２. y\n\"3. z", "第一条 x\n第二条 y"]
    df = spark.sql("SELECT t.k, p.* FROM {t} t, LATERAL provisions(t.law) p", t=spark.createDataFrame(list(enumerate(laws)), "k int, law string"))
    assert sorted(map(tuple, df.collect())) == sorted((k, i, *p) for k, t in enumerate(laws) for i, p in enumerate(provisions.split(t)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan  # a call and a message for each row before
