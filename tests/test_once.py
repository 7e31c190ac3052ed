"""Fingerprints are taken once for each side of the join that reads them."""

import __spark_entry__


def test_fingerprints_once(spark):
    df = __spark_entry__.queries()["simhash_pairs"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2


def test_fingerprints_are_joined_by_one_number(spark):
    """Rows are sorted by a number of 64 bits first, not by which bands it stands for: those are few values."""
    from riverbed.operators import similarity

    plan = similarity.near_fingerprints(spark.range(100).selectExpr("id", "xxhash64(id) as fp"))._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "bands" not in join and "(key#" in join.replace("((", "(")
