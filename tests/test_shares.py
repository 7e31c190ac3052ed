"""A task's share of the work does not grow with the table."""

from compare import same
from riverbed.plans import registry, relational


def test_pairs_are_counted_in_shares_of_one_size(spark, monkeypatch):
    registry.load()
    monkeypatch.setattr(relational, "PAIRED_LINES", 500)
    small = "/root/testdata/sf0.001"
    df = registry.QUERIES["pairs_related"](spark, small)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert df.rdd.getNumPartitions() == -(-lines // 500) > 8  # it was the session's number before, or less
    assert same(df, small, registry.SQL["pairs_related"]) is None
