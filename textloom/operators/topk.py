"""Choosing rows: top k, spaced top k, round robin, shuffles, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each group, numbered from 1.  Spark keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def best(df: DataFrame, by: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """One row of each group, the largest by `order` (plain columns or expressions), as a mergeable aggregate."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_best")).select(*by, "_best.*")


def spaced_top_k(df: DataFrame, by: list[str], position: str, score: str, k: int, gap: int, first: int = 1_000) -> DataFrame:
    """Greedy non-maximum suppression: rows by falling score (ties: smaller position), each more than `gap` from those taken.

    A fold over each group's `first` best rows, which must hold `k` spaced ones; a group
    for which they may not is an error rather than a wrong answer.
    """
    ranked = top_k(df.select(*by, position, score), by, [F.col(score).desc(), F.col(position)], first, "_rank")
    item = F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))
    groups = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kind = groups.schema["_all"].dataType.simpleString()
    taken = F.aggregate("_all", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda y: F.abs(y["p"] - x["p"]) <= gap), F.concat(acc, F.array(x))).otherwise(acc))
    sure = F.when((F.size("_all") < first) | (F.size("_taken") >= k), F.col("_taken")).otherwise(F.raise_error(F.lit("raise `first`: a group's best rows are too close together")).cast(kind))
    out = groups.withColumn("_taken", taken).select(*by, F.posexplode(sure).alias("rank", "_x"))
    return out.select(*by, (F.col("rank") + 1).alias("rank"), F.col("_x.p").alias(position), (-F.col("_x.s")).alias(score))


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first row of each group, then the second of each, up to `limit` rows, numbered in `turn`."""
    turns = df.withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return turns.orderBy("_turn", group).limit(limit).withColumnRenamed("_turn", "turn")


def seeded_order(seed: str, key: Column) -> Column:
    """A sort key that shuffles rows the same way in each run, whatever their partitions."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def weighted_sample(df: DataFrame, by: list[str], key: str, weight: Column, k: int, seed: str) -> DataFrame:
    """`k` rows of each group without replacement, likelier by `weight`: the smallest -ln(u)/w."""
    u = (F.conv(F.substring(seeded_order(seed, F.col(key)), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return top_k(df.withColumn("_draw", -F.log(u) / weight), by, [F.col("_draw"), F.col(key)], k, "_rank").drop("_draw", "_rank")


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges in both directions, each once."""
    return edges.unionByName(edges.withColumns({a: F.col(b), b: F.col(a)})).distinct()
