"""Connected components by alternating large-star and small-star steps.

Each step is a group-by over edges that sit in a written table; nothing is gathered on
the driver but one count a round.  Joins are merges by hint: a table of links that is small
enough to be broadcast is still one that grows with the input, and a round that follows
another would hold a copy of each on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.runtime import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that the join's sides are plain shuffles and Spark splits a hub's edges.
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-least")
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("v"))
    least = stored(down.groupBy("n").agg(F.min("v").alias("m")), "links-least")
    moved = down.join(least.hint("merge"), "n").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).filter("a < b").distinct()


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, root) for every node of `edges` (a, b): root is its component's smallest node."""
    # Rounds write short tables of their own; `release` deletes them.
    stars = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links-0")
    state = None
    for k in range(max_rounds):
        stars = stored(_small_star(_large_star(stars)), f"links-{k + 1}")
        row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            leaves = stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return leaves.unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = (row.n, row.h)
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def component_minima(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Return (node, value): the smallest `value` of `nodes` (node, value) in each node's component."""
    roots = component_roots(edges)
    placed = nodes.join(roots.hint("merge"), "node", "left").select("node", "value", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("value").alias("least"))
    return placed.join(least.hint("merge"), "root").select("node", F.col("least").alias("value"))
