"""Deterministic splits, leakage checks, quarantine, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.math import hash_unit


def hash_split(key: Column, seed: str, shares: tuple[float, float] = (0.8, 0.9), together: Column | None = None) -> Column:
    """train, validation or test by a key's hash; rows for which `together` holds count as one key."""
    unit_key = F.concat(F.lit(seed + ":"), F.when(together, F.lit("together")).otherwise(key.cast("string")) if together is not None else key.cast("string"))
    u = hash_unit(unit_key)
    return F.when(u < shares[0], "train").when(u < shares[1], "validation").otherwise("test")


def grouped_split(df: DataFrame, group: str, seed: str, share: float = 0.15, least: int = 2, min_groups: int = 10) -> DataFrame:
    """(group, split): groups in order of their hash; the first `share` (at least `least`) validate, as many more test.

    The order is found by one window over the groups, not the rows: the table must have
    few groups (readers, sources).  Fewer than `min_groups` is an error.
    """
    groups = df.select(group).distinct()
    ordered = groups.withColumn("_n", F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(group).cast("string")), 256))))
    counted = ordered.withColumn("_all", F.count("*").over(Window.partitionBy()))
    k = F.greatest(F.lit(least), F.bround(F.col("_all") * share).cast("int"))
    checked = counted.withColumn("_ok", F.assert_true(F.col("_all") >= min_groups, F.lit("too few groups to split"))).filter("_ok is null")
    return checked.select(group, F.when(F.col("_n") <= k, "validation").when(F.col("_n") <= 2 * k, "test").otherwise("train").alias("split"))


def leaks(df: DataFrame, value: str, split: str) -> DataFrame:
    """(value, splits): values that more than one split has."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def seen_in(df: DataFrame, text: str, split: str, name: str = "train") -> DataFrame:
    """Adds text_seen: whether `name` has a row with the same text."""
    known = df.filter(F.col(split) == name).select(F.col(text).alias("_known")).distinct()
    return df.join(known, F.col(text) == F.col("_known"), "left").withColumn("text_seen", F.col("_known").isNotNull()).drop("_known")


def held_out_pairs(pairs: DataFrame, a: str, b: str, seed: str, share: float) -> DataFrame:
    """Pairs of which neither side is held out by its hash."""
    kept = lambda c: hash_unit(F.concat(F.lit(seed + ":"), F.col(c).cast("string"))) >= share
    return pairs.filter(kept(a) & kept(b))


def quarantine(df: DataFrame, listed: DataFrame, key: str, digest: str) -> DataFrame:
    """`df` without listed rows; fails if a listed key is absent or has another digest now."""
    lost = listed.join(df.select(key, digest), [key, digest], "left_anti").agg(F.count("*").alias("_lost"))
    left = df.join(listed.select(key), key, "left_anti")
    return left.crossJoin(F.broadcast(lost)).withColumn("_ok", F.assert_true(F.col("_lost") == 0, F.lit("a listed row is not in the table"))).filter("_ok is null").drop("_ok", "_lost")


def overlay(df: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with `value` from `changes` where that has the key, and `changed`, whether it differs."""
    new = changes.select(key, F.col(value).alias("_new"), F.lit(True).alias("_has"))
    out = df.join(new, key, "left").withColumn("changed", F.coalesce("_has", F.lit(False)) & ~F.col(value).eqNullSafe(F.col("_new")))
    return out.withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_has")


def admit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds refused (names of the checks that do not hold; null counts as failing) and admitted."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return df.withColumn("refused", failed).withColumn("admitted", F.size("refused") == 0)


def propagate_failure(df: DataFrame, by: list[str], order: str, failed: str) -> DataFrame:
    """Adds excluded: a row that failed itself, or whose predecessor did; a failure moves one step only."""
    before = F.lag(failed).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("excluded", F.coalesce(F.col(failed), F.lit(False)) | F.coalesce(before, F.lit(False)))
