"""Challenges: what is told once for names and ranks for classes, against all pairs."""

from pyspark.sql import Window, functions as F

from textloom.operators import lessons as L
from textloom.plans import catalog


def test_leading_rows_are_those_of_all_rows(spark):
    members = spark.range(900).selectExpr("if(id % 5 = 0, null, id % 5) c", "(id * 37) % 900 k")
    scored = spark.range(40).selectExpr("id g").crossJoin(members.select("c").distinct()).withColumn("score", F.expr("(g * coalesce(c, 7)) % 3"))
    every = scored.join(members.withColumnRenamed("c", "d"), F.col("c").eqNullSafe(F.col("d"))).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "k")))
    got = L.leading(scored, ["g"], ["c"], members, "k", 61)
    first = got.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "k"))).filter("n <= 61")
    want = every.filter("n <= 61")
    assert sorted(map(tuple, first.select("g", "k", "n").collect())) == sorted(map(tuple, want.select("g", "k", "n").collect()))
    assert got.count() < every.count() / 2


def test_bands_by_a_stated_size_are_those_of_all_rows(spark):
    rows = spark.range(3).selectExpr("id + 1 g", "explode(sequence(1, cast(5 * (id + 1) as int))) k")
    order, hard = [F.col("k")], F.lit("medium")
    whole = sorted(map(tuple, L.in_band(rows, ["g"], order, hard).collect()))
    assert sorted(map(tuple, L.in_band(rows, ["g"], order, hard, size=F.col("g") * 5).collect())) == whole


def test_closeness_is_told_once_for_names(spark, sf):
    """Pairs of parts are many, pairs of their names few: no plan tells likeness behind the join of parts."""
    for name, joins in (("ch1_ch4_w10_choices", 2), ("ch2_eligible", 3), ("ch3_blended_ranks", 2)):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan[: plan.index("array_intersect")].count("Join ") >= joins, name
