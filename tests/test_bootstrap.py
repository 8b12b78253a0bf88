"""Bootstrap: draws are many rows made of one, which no driver may gather."""

from textloom.operators import aggregates


def test_draws_are_not_broadcast(spark):
    groups = spark.range(50).selectExpr("id g", "id % 7 errors", "id + 1 words")
    drawn = aggregates.resamples(groups, ["g"], ["errors", "words"], 20)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
    assert drawn.count() == 20
