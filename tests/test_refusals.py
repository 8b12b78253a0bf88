"""Runs that must be refused, and samples that follow their weights."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import joins, splits, topk


@pytest.mark.parametrize("cand", [[(1, 2.0)], [(1, 2.0), (2, 3.0), (3, 4.0)], [(1, 2.0), (2, 3.0), (2, 3.0)]])
def test_runs_with_other_keys_are_refused(spark, cand):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="differ in their keys"):
        joins.paired(base, spark.createDataFrame(cand, "k int, v double"), ["k"], ["v"]).collect()
    assert sorted(map(tuple, joins.paired(base, base.withColumn("v", F.col("v") * 3), ["k"], ["v"]).collect())) == [(1, 1.0, 3.0), (2, 2.0, 6.0)]


@pytest.mark.parametrize("listed", [[(9, "x")], [(1, "y")], [(1, "x"), (2, "x")]])
def test_quarantine_refuses_rows_that_are_gone_or_changed(spark, listed):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, d string")
    with pytest.raises(Exception, match="not in the table"):
        splits.quarantine(rows, spark.createDataFrame(listed, "k int, d string"), "k", "d").collect()
    kept = splits.quarantine(rows, spark.createDataFrame([(1, "x")], "k int, d string"), "k", "d")
    assert sorted(r.k for r in kept.collect()) == [2, 3]


def test_heavier_rows_are_drawn_more_often(spark):
    rows = spark.range(4_000).selectExpr("id", "'g' g", "if(id % 2 = 0, 9.0, 1.0) w")
    got = topk.weighted_sample(rows, ["g"], "id", F.col("w"), 400, "1").collect()
    assert len(got) == 400 and 340 <= sum(r.id % 2 == 0 for r in got) <= 380
