"""Joins that a plain equi-join does not state: as-of, intervals, successors, priorities, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, take: list[str]) -> DataFrame:
    """Each left row with the `take` columns of the last right row of its group whose key is at most its own.

    One sort of both sides together; no row meets more than its predecessor.  Of equal
    right keys the largest values of `take` count.  Null keys find nothing.
    """
    lefts = left.select(*by, F.col(left_key).alias("_key"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_found"))
    rights = right.filter(F.col(right_key).isNotNull()).select(*by, F.col(right_key).alias("_key"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.struct(*take).alias("_found"))
    order = Window.partitionBy(*by).orderBy(F.col("_key").asc_nulls_first(), "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    seen = lefts.unionByName(rights).withColumn("_found", F.last("_found", ignorenulls=True).over(order)).filter("_side = 1")
    return seen.select("_row.*", *[F.when(F.col("_key").isNotNull(), F.col(f"_found.{c}")).alias(c) for c in take])


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: int, how: str = "left") -> DataFrame:
    """Points with the intervals [start, end) that hold them, by cells of `width`.

    Both sides are keyed by cell, so the join is an equi-join; an interval is in each
    cell that it touches, a point in one, so no pair is found twice.
    """
    cells = intervals.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    keyed = points.withColumn("_cell", F.floor(F.col(at) / width))
    on = [keyed[c] == cells[c] for c in by] + [keyed["_cell"] == cells["_cell"], keyed[at] >= cells[start], keyed[at] < cells[end]]
    drop = [cells[c] for c in by] + [cells["_cell"]]
    out = keyed.join(cells, on, how)
    for c in drop:
        out = out.drop(c)
    return out.drop("_cell")


def overlap_pairs(intervals: DataFrame, by: list[str], key: str, start: str, end: str, width: int) -> DataFrame:
    """(by, first, second, shared): pairs of intervals of a group that overlap, by cells of `width`.

    A pair is reported by the cell in which the later of the two starts.
    """
    cells = intervals.filter(F.col(start) < F.col(end)).select(*by, F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "cell"]]
    pairs = a.join(b, on).filter("a.k < b.k and a.s < b.e and b.s < a.e").filter(F.col("a.cell") == F.floor(F.greatest("a.s", "b.s") / width))
    return pairs.select(*[F.col(f"a.{c}") for c in by], F.col("a.k").alias("first"), F.col("b.k").alias("second"), (F.least("a.e", "b.e") - F.greatest("a.s", "b.s")).alias("shared"))


def overlaps_before(intervals: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """A sweep: adds `overlaps`, whether an interval begins before one that began earlier has ended."""
    w = Window.partitionBy(*by).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("overlaps", F.coalesce(F.max(end).over(w) > F.col(start), F.lit(False)))


def successor_join(df: DataFrame, by: list[str], position: str, steps: tuple[int, ...], take: str) -> DataFrame:
    """Adds next_<k>: `take` of the row whose position is exactly k further in the group, null where there is none.

    Positions must be whole numbers and different within a group.
    """
    for k in steps:
        w = Window.partitionBy(*by).orderBy(F.col(position).cast("long")).rangeBetween(k, k)
        df = df.withColumn(f"next_{k}", F.first(take).over(w))
    return df


def prioritised_lookup(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, default: Column) -> DataFrame:
    """`value` from the first of `lookups` (table, keys) that has the row's keys, else `default`; `found_by` numbers it from 1."""
    out, values, hits = df, [], []
    for n, (table, keys) in enumerate(lookups, 1):
        one = table.groupBy(*keys).agg(F.min(value).alias(f"_v{n}"), F.lit(n).alias(f"_h{n}"))
        out = out.join(one, keys, "left")
        values.append(f"_v{n}")
        hits.append(f"_h{n}")
    picked = F.coalesce(*[F.when(F.col(h).isNotNull(), F.struct(F.col(h).alias("n"), F.col(v).alias("v"))) for h, v in zip(hits, values, strict=True)])
    return out.withColumn("_pick", picked).withColumn(value, F.when(F.col("_pick").isNotNull(), F.col("_pick.v")).otherwise(default)).withColumn("found_by", F.col("_pick.n")).drop("_pick", *values, *hits)


def paired(baseline: DataFrame, candidate: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One-to-one pairs of two runs over the same keys; fails if a key is missing on one side or repeated."""
    def side(df, name):
        return df.groupBy(*keys).agg(F.count("*").alias(f"_{name}"), *[F.first(v).alias(f"{name}_{v}") for v in values])

    both = side(baseline, "base").join(side(candidate, "cand"), keys, "full_outer")
    ok = F.assert_true((F.coalesce("_base", F.lit(0)) == 1) & (F.coalesce("_cand", F.lit(0)) == 1), F.lit("the runs differ in their keys"))
    return both.withColumn("_ok", ok).filter("_ok is null").drop("_ok", "_base", "_cand")


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, n): each key that is missing, unexpected, repeated or present, with its count in `found`."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n"))
    want = expected.select(*keys).distinct().withColumn("_want", F.lit(True))
    both = want.join(n, keys, "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("n") > 1, "repeated").otherwise("present")
    return both.select(*keys, status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
