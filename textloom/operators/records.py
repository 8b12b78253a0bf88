"""Records: named selections, promotions, verified joins, merges of sources, small array and JSON shapes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F


def select_named(df: DataFrame, column: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Rows whose `column` is among `include` (all, if none is named) and not among `exclude`.

    A name that the column does not hold is an error: only the named values are looked up.
    """
    include, exclude = set(include), set(exclude)
    asked = sorted(include | exclude)
    known = {r[0] for r in df.filter(F.col(column).isin(asked)).select(column).distinct().collect()} if asked else set()
    if missing := [n for n in asked if n not in known]:
        raise ValueError(f"unknown names: {', '.join(missing)}")
    out = df.filter(F.col(column).isin(sorted(include))) if include else df
    return out.filter(~F.col(column).isin(sorted(exclude))) if exclude else out


def only(items: Column) -> Column:
    """The element of an array that has exactly one, else null."""
    return F.when(F.size(items) == 1, items[0])


def safe_path(path: Column) -> Column:
    """Whether a relative path stays where it is: no root, drive, backslash, or step upwards."""
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|\x00"), F.lit(False))


def visible(rules: Column, registry: DataFrame, hidden: list[str], detail: bool) -> Column:
    """Rules of an array that no hidden group has and the level shows, in the registry's order.

    `registry` (rule, group, core, place) is a short table; its shown rules become a literal array.
    """
    shown = [r.rule for r in registry.filter(~F.col("group").isin(hidden) & (F.col("core") | F.lit(detail))).orderBy("place").collect()]
    return F.filter(F.array(*[F.lit(s) for s in shown]).cast("array<string>"), lambda s: F.array_contains(rules, s))


def by_priority(items: Column, order: list[str]) -> Column:
    """An array in the order of `order`; items not in it follow, by themselves."""
    place = F.array(*[F.lit(o) for o in order])
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(F.when(F.array_position(place, x) > 0, F.array_position(place, x)).otherwise(len(order) + 1).alias("p"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def verified(rows: DataFrame, truth: DataFrame, on: list[str], label: str) -> DataFrame:
    """Rows whose label equals the truth's for the same key; keys are joined, labels compared."""
    t = truth.select(*on, F.col(label).alias("_label"))
    return rows.join(t, on).filter(F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def through_bridge(rows: DataFrame, bridge: DataFrame, old: list[str], new: list[str], start: str, end: str, text: str, order: str) -> DataFrame:
    """Rows renumbered by a bridge (old key, new key): rows that go to one key are one, with joined text and outer times."""
    moved = rows.join(bridge, old)
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    return moved.groupBy(*new).agg(F.min(start).alias(start), F.max(end).alias(end), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias(text), F.count("*").alias("members"))


def fan_out(rows: DataFrame, key: str, targets: str, table: DataFrame, on: str, most: int = 8) -> DataFrame:
    """Rows joined with `table` over the distinct targets of their array, where they have 1 to `most` of them."""
    some = rows.withColumn("_t", F.array_distinct(targets)).filter(F.size("_t").between(1, most))
    return some.select(key, F.posexplode("_t").alias("place", on)).join(table, on)


def pooled(pools: list[DataFrame], key: str, order: Column, by: list[str], k: int) -> DataFrame:
    """The first `k` rows of each group from pools in turn: a later pool only tops up, and no key comes twice.  Adds pool and rank."""
    rows = pools[0].withColumn("pool", F.lit(0))
    for n, p in enumerate(pools[1:], 1):
        rows = rows.unionByName(p.withColumn("pool", F.lit(n)))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy("pool", order))).filter("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pool", order, key))).filter(F.col("rank") <= k)


def missing_from(part: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """Keys of `part` that `whole` lacks: empty if it is a subset."""
    return part.select(*on).distinct().join(whole.select(*on), on, "left_anti")


def inventory_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) where two inventories differ, on either side: empty if they are equal."""
    x, y = a.select(key, F.col(value).alias("left")), b.select(F.col(key).alias("_k"), F.col(value).alias("right"))
    out = x.join(y, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(key, "_k").alias(key), "left", "right")
    return out.filter(~F.col("left").eqNullSafe(F.col("right")))


def merge_sources(sources: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """All sources as one; (key, rows..., sources): the newest row of each key by `order`, and how many sources have the key."""
    rows = sources[0].withColumn("_source", F.lit(0))
    for n, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_source", F.lit(n)))
    rest = [c for c in sources[0].columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, "_source")).alias("_r"), F.count_distinct("_source").alias("sources")).select(*key, "_r.*", "sources")


def no_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """`df`, failing where a key comes twice."""
    n = F.count("*").over(Window.partitionBy(*key))
    told = F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(told).cast("long")).otherwise(F.col("_n"))).filter("_n = 1").drop("_n")


def enriched(rows: DataFrame, facts: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Rows with `columns` of `facts` where it has them and they are not null, else their own."""
    f = facts.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(f, on, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def clipped(clips: DataFrame, length: str, start: str, end: str) -> DataFrame:
    """Adds clip_start and clip_end within 0 and the recording's length, and reason where nothing is left (null otherwise)."""
    a, b = F.greatest(F.lit(0), F.col(start)), F.least(F.col(length), F.col(end))
    reason = F.when(F.col(length).isNull(), "no recording").when(F.col(start).isNull() | F.col(end).isNull(), "no timing").when(a >= b, "empty clip")
    return clips.withColumns({"clip_start": a, "clip_end": b, "reason": reason})


def dedupe_by(items: Column, field: str) -> Column:
    """An array of structs without those whose `field` an earlier one has."""
    keys = F.transform(items, lambda x: x[field])
    return F.filter(items, lambda x, i: F.array_position(keys, x[field]) == i + 1)


def merge_equal(items: Column, text: str, key: str) -> Column:
    """array<struct<text, key>>: neighbouring structs with equal keys as one, their texts joined."""
    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.concat(last["text"], x[text]).alias("text"), last["key"].alias("key"))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        return F.when(last["key"].eqNullSafe(x[key]) & (F.size(done) > 0), grown).otherwise(F.concat(done, F.array(F.struct(x[text].alias("text"), x[key].alias("key")))))

    return F.aggregate(items, F.array().cast("array<struct<text:string,key:string>>"), step)


def public_fields(json: Column) -> Column:
    """A flat JSON object without the fields whose names begin with an underscore."""
    kept = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: ~k.startswith("_"))
    return F.to_json(kept)


def next_kept(df: DataFrame, by: list[str], order: str, value: str, kept: Column) -> DataFrame:
    """Adds following and before: the nearest later and earlier value among rows that are kept."""
    v, before = F.when(kept, F.col(value)), (Window.unboundedPreceding, -1)
    nearest = lambda order: F.last(v, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(*before))
    # Both frames grow from an end, so each costs one step a row.
    return df.withColumns({"following": nearest(F.desc(order)), "before": nearest(F.asc(order))})


def conflict_free(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, label) once each, failing where rows of a key disagree."""
    told = F.concat(F.lit("conflicting labels for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))
    one = rows.groupBy(*key).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    return one.select(*key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(told).cast(rows.schema[label].dataType)).alias(label))


def match_spans(stacks: dict[tuple[float, float], list[int]], guesses: Iterable[tuple[int, float, float]], least: float) -> list[tuple[int, int, float]]:
    """(event, guess, iou) of guesses (id, start, end) in their order; `stacks` are ascending ids of the events at each (start, end), and are used up."""
    import numpy as np

    def lay():
        spans = sorted(k for k, ids in stacks.items() if ids)
        grid = np.array(spans, float).reshape(-1, 2)
        return spans, grid[:, 0], grid[:, 1], np.array([stacks[k][-1] for k in spans], np.int64), np.ones(len(spans), bool)

    spans, start, end, top, alive = lay()
    dead, out = 0, []
    for guess, a, b in guesses:
        low, high = 0, len(spans)
        if 0 < least <= 1 and b > a:
            # One that begins further off cannot share enough; a little more for rounding.
            size, slack = b - a, 1e-6 * (1 + abs(a) + abs(b))
            low, high = np.searchsorted(start, (a - size * (1 / least - 1) - slack, a + size * (1 - least) + slack))
        shared = np.maximum(0.0, np.minimum(end[low:high], b) - np.maximum(start[low:high], a))
        union = np.maximum(end[low:high], b) - np.minimum(start[low:high], a)
        iou = np.divide(shared, union, out=np.full(len(union), -np.inf), where=alive[low:high] & (union > 0))
        if not len(iou) or not (most := iou.max()) >= least:
            continue
        near = low + np.flatnonzero(iou == most)
        k = int(near[np.argmax(top[near])])
        ids = stacks[spans[k]]
        out.append((ids.pop(), guess, float(most)))
        if ids:
            top[k] = ids[-1]
        else:
            alive[k], dead = False, dead + 1
            if 2 * dead > len(spans):
                (spans, start, end, top, alive), dead = lay(), 0
    return out


def match_intervals(events: DataFrame, guesses: DataFrame, by: str, least: float = 0.5) -> DataFrame:
    """(by, event, guess, iou): greedy one-to-one matches of intervals (by, id, kind, start, end) of one kind.

    Guesses are taken in order of their ids; each takes the unmatched event of its kind
    with the largest intersection over union of at least `least`, of equal ones the last
    id.  Intervals of one recording and kind are matched in one task; equal ones are one
    entry with a stack of ids, and a guess looks only at entries that begin near it.
    Intervals without a start or an end match nothing.
    """
    def run(frame):
        import pandas as pd

        frame = frame[frame["start"].notna() & frame["end"].notna()].sort_values("id", kind="stable")
        left, right = frame[~frame["guess"]], frame[frame["guess"]]
        stacks: dict[tuple[float, float], list[int]] = {}
        for e in left[["id", "start", "end"]].itertuples(index=False):
            stacks.setdefault((e.start, e.end), []).append(e.id)
        out = match_spans(stacks, right[["id", "start", "end"]].itertuples(index=False), least)
        key = frame["key"].iloc[0] if len(frame) else None
        return pd.DataFrame([(key, *m) for m in out], columns=[by, "event", "guess", "iou"])

    x, y = (df.select(F.col(by).alias("key"), "id", "kind", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(side).alias("guess")) for side, df in ((False, events), (True, guesses)))
    kind = events.schema[by].dataType.simpleString()
    return x.unionByName(y).groupBy("key", "kind").applyInPandas(run, f"`{by}` {kind}, event long, guess long, iou double")
