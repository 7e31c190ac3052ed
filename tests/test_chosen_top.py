"""The top candidate where several have the best score."""

import __spark_entry__


def test_top_candidate_of_equal_scores(spark, tmp_path):
    rows = [(key, 1, 400000.0) for key in (9, 3, 7, 5)] + [(1, 1, 300000.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    (row,) = __spark_entry__.queries()["group_candidates"](spark, str(tmp_path)).collect()
    assert (row.anchor, row.candidates, row.top) == (1, 5, 3)
