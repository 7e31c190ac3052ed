"""Rounds of components send no table to the driver, however small their tables are."""

from riverbed.operators import graphs


def test_no_broadcast(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.cache()

    monkeypatch.setattr(graphs, "_kept", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "u long, v long")
    assert sorted(map(tuple, graphs.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
