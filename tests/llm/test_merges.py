"""Joins of tables that grow with the input are merges: nothing of them passes the driver."""

from textloom.llm import components, mixing, near_copies, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_merged_not_broadcast(spark):
    docs = spark.range(300).selectExpr("id doc_id", "concat('one two three four ', id div 3) text")
    for df in (simhash.simhash_groups(docs), simhash.drop_near_copies(docs), near_copies.drop_near_copies(docs), mixing.apply_mix(docs, docs.selectExpr("doc_id", "1D rate"))):
        df.collect()
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df), plan_of(df)


def test_component_minima_are_merged(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    minima = components.component_minima(spark.range(1, 12).selectExpr("id node", "id value"), edges)
    assert dict(map(tuple, minima.collect())) == {i: {2: 1, 3: 1, 9: 7}.get(i, i) for i in range(1, 12)}
    assert "SortMergeJoin" in plan_of(minima) and "BroadcastHashJoin" not in plan_of(minima)
