"""Challenges and learners: eligible wrong answers, blended ranks, choices by difficulty, adaptive levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import dice
from textloom.operators.topk import seeded_order

#: Rank windows of the difficulties, and levels in order.
BANDS = {"hard": (0, 6), "medium": (6, 20), "easy": (20, 60)}
LEVELS = ("easy", "medium", "hard")


def eligible(pairs: DataFrame, answer: str, prompt: str, candidate: str, successors: DataFrame | None = None, limit: float = 0.85) -> DataFrame:
    """Pairs whose candidate text is neither the answer's nor the prompt's, is not too like the answer, and follows no equal prompt.

    `successors` (prompt, next) lists what follows each text.
    """
    out = pairs.filter((F.col(candidate) != F.col(answer)) & (F.col(candidate) != F.col(prompt)) & (dice(F.col(answer), F.col(candidate)) < limit))
    if successors is None:
        return out
    s = successors.select(F.col("prompt").alias("_p"), F.col("next").alias("_s")).distinct()
    return out.join(s, (F.col(prompt) == F.col("_p")) & (F.col(candidate) == F.col("_s")), "left_anti")


def blended(close: Column, heard: Column, has_neighbours: Column, same: Column, bonus: float = 0.1) -> Column:
    """Rank score of a candidate: half sound and half closeness; closeness alone counts half where the target has neighbours and it is none of them."""
    c = close + F.when(same, bonus).otherwise(0.0)
    return F.when(heard.isNotNull(), 0.5 * heard + 0.5 * c).when(has_neighbours, 0.5 * c).otherwise(c)


def leading(scored: DataFrame, by: list[str], classes: list[str], members: DataFrame, key: str, most: int) -> DataFrame:
    """(by, key, score): rows of each group, its first `most` by falling score and rising key among them.

    `scored` (by, classes, score) has a row for each class of candidates that score alike in
    a group, `members` (classes, key) the candidates.  A class counts where fewer than `most`
    candidates score above it, and of a class only the first `most`: groups never meet all
    candidates.  Columns of `classes` may be null.
    """
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy(*classes).orderBy(key))).filter(F.col("_n") <= most)
    held = first.groupBy(*classes).agg(F.array_sort(F.collect_list(key)).alias("_members"))
    right = held.select(*[F.col(c).alias(f"_{c}") for c in classes], "_members")
    on = [scored[c].eqNullSafe(right[f"_{c}"]) for c in classes]
    rows = scored.join(right, on).select(*by, "score", "_members").withColumn("_size", F.size("_members"))
    above = Window.partitionBy(*by).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beside = Window.partitionBy(*by, "score")
    rows = rows.withColumn("_above", F.sum("_size").over(above) - F.sum("_size").over(beside)).filter(F.col("_above") < most)
    return rows.select(*by, F.explode("_members").alias(key), "score")


def in_band(df: DataFrame, by: list[str], order: list[Column], difficulty: Column, scale: float = 1.0, size: Column | None = None) -> DataFrame:
    """Rows in the rank window of their group's difficulty; where it holds fewer than two, as many from the group's tail.

    The tail is as long as the window, and two rows at least.  `size` is how many rows the
    whole group has, where `df` has only its first ones (those of all windows, or all).
    """
    round_half = lambda n: int(n * scale + 0.5)
    low, high = (F.element_at(F.create_map(*[x for d, b in BANDS.items() for x in (F.lit(d), F.lit(round_half(b[k])))]), difficulty) for k in (0, 1))
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_place": F.row_number().over(w.orderBy(*order)) - 1, "_all": F.count("*").over(w) if size is None else size, "_low": low, "_high": high})
    inside = F.least("_all", "_high") - F.least("_all", "_low")
    tail = F.col("_place") >= F.greatest(F.lit(0), F.col("_all") - F.greatest(F.lit(2), F.col("_high") - F.col("_low")))
    keep = F.when(inside >= 2, (F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_high"))).otherwise(tail)
    return rows.filter(keep).drop("_place", "_all", "_low", "_high")


def choices(banded: DataFrame, by: list[str], key: str, seed: str, k: int = 2) -> DataFrame:
    """`k` rows of each group by a seeded shuffle, numbered in choice."""
    w = Window.partitionBy(*by).orderBy(seeded_order(seed, F.concat_ws(":", *by, key)))
    return banded.withColumn("choice", F.row_number().over(w)).filter(F.col("choice") <= k)


def adapt(outcomes: Column, level: int = 0) -> Column:
    """struct<level, recent, changes>: the level after an ordered array of outcomes.

    After each outcome: two misses, or fewer than 55 % of the last twelve right, go down;
    80 % with the last three right goes up; before five outcomes only misses move it.  A
    new level begins without outcomes.
    """
    state = F.struct(F.lit(level).alias("level"), F.array().cast("array<boolean>").alias("recent"), F.lit(0).alias("changes"))

    def step(s, hit):
        grown = F.concat(s["recent"], F.array(hit))
        recent = F.slice(grown, F.greatest(F.size(grown) - 11, F.lit(1)), F.lit(12))
        n, right = F.size(recent), F.size(F.filter(recent, lambda x: x))
        last = lambda k: F.slice(recent, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
        missed = (n >= 2) & ~F.exists(last(2), lambda x: x)
        down = missed | ((n >= 5) & (right < 0.55 * n))
        up = (n >= 5) & (right >= 0.8 * n) & F.forall(last(3), lambda x: x)
        level = F.when(down, F.greatest(s["level"] - 1, F.lit(0))).when(up, F.least(s["level"] + 1, F.lit(2))).otherwise(s["level"])
        moved = level != s["level"]
        return F.struct(level.alias("level"), F.when(moved, F.array().cast("array<boolean>")).otherwise(recent).alias("recent"), (s["changes"] + moved.cast("int")).alias("changes"))

    return F.aggregate(outcomes, state, step)


def progress(attempts: DataFrame, learner: str, lesson: str, accuracy: str, xp: str, day: str, days: int = 120) -> DataFrame:
    """(learner, lessons, xp, days): best accuracy and points of each lesson; points are those of best attempts; the last `days` distinct days."""
    best = attempts.groupBy(learner, lesson).agg(F.max(accuracy).alias("accuracy"), F.max(xp).alias("xp"))
    lessons = best.groupBy(learner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(lesson).alias("key"), F.struct("accuracy", "xp").alias("value"))))).alias("lessons"), F.sum("xp").alias("xp"))
    seen = attempts.groupBy(learner).agg(F.array_sort(F.collect_set(day)).alias("_d"))
    return lessons.join(seen, learner).select(learner, "lessons", "xp", F.slice("_d", F.greatest(F.size("_d") - days + 1, F.lit(1)), F.lit(days)).alias("days"))
