"""Measures of recognised speech: full error reports, rule scores, probes, safety flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import phrase_present


def report() -> list[Column]:
    """A full report over rows (ref, hyp: arrays of words; hits, substitutions, deletions, insertions; char_errors, ref_chars)."""
    words = F.sum(F.size("ref"))
    ratio = lambda x: F.sum(x) / F.greatest(F.lit(1), words)
    share = lambda c: F.avg(c.cast("double"))
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    return [
        F.count("*").alias("samples"), words.alias("words"), ratio(F.expr("substitutions + deletions + insertions")).alias("wer"),
        (F.sum("char_errors") / F.greatest(F.lit(1), F.sum("ref_chars"))).alias("cer"),
        *[ratio(F.col(c)).alias(f"{c[:-1]}_rate") for c in ("substitutions", "deletions", "insertions")],
        share(F.col("ref") == F.col("hyp")).alias("exact"), share(F.col("deletions") > 0).alias("omission"), share(F.size("hyp") == 0).alias("empty"),
        share(F.col("insertions") > 0).alias("extra"), share((F.size("hyp") == 0) | ~last("ref").eqNullSafe(last("hyp"))).alias("terminal_mismatch"),
    ]


def rule_scores(pairs: DataFrame, by: list[str], wanted: str, heard: str) -> DataFrame:
    """(by, rule, expected, applied, extra, recall, precision) over words with arrays of wanted and heard rules."""
    marks = lambda c, want, got: F.transform(c, lambda x: F.struct(x.alias("rule"), F.lit(want).alias("want"), F.lit(got).alias("got")))
    each = F.concat(marks(F.array_intersect(wanted, heard), 1, 1), marks(F.array_except(wanted, heard), 1, 0), marks(F.array_except(heard, wanted), 0, 1))
    out = pairs.select(*by, F.explode(each).alias("m")).groupBy(*by, F.col("m.rule").alias("rule")).agg(
        F.sum("m.want").alias("expected"), F.sum(F.col("m.want") * F.col("m.got")).alias("applied"), F.sum((1 - F.col("m.want")) * F.col("m.got")).alias("extra"))
    return out.withColumns({"recall": F.col("applied") / F.nullif(F.col("expected"), F.lit(0)), "precision": F.col("applied") / F.nullif(F.expr("applied + extra"), F.lit(0))})


def mistakes(pairs: DataFrame, keep: list[str], wanted: str, heard: str) -> DataFrame:
    """(keep, rule): a row for each wanted rule that was not heard."""
    return pairs.select(*keep, F.explode(F.array_except(wanted, heard)).alias("rule"))


def contrast_outcomes(aligned: DataFrame, contrasts: DataFrame, scope: str, word: str, observed: str) -> DataFrame:
    """Adds outcome to aligned words (scope, word, observed) that `contrasts` (scope, own, other) lists: own, other, or neither."""
    c = F.broadcast(contrasts.select(F.col(scope).alias("_scope"), "own", "other"))  # a table of contrasts is a few rows by its nature
    found = aligned.join(c, (F.col(scope) == F.col("_scope")) & (F.col(word) == F.col("own"))).drop("_scope")
    return found.withColumn("outcome", F.when(F.col(observed) == F.col("own"), "own").when(F.col(observed) == F.col("other"), "other").otherwise("neither"))


def skip_probes(df: DataFrame, by: list[str], order: str, words: str, least: int = 2) -> DataFrame:
    """(by, order, distinctive): for rows with both successors, words of the next row that neither this nor the one after has, where there are at least `least`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    follows = lambda k: F.lead(order, k).over(w) == F.col(order) + k
    middle, last = F.lead(words, 1).over(w), F.lead(words, 2).over(w)
    found = df.withColumns({"_ok": follows(1) & follows(2), "distinctive": F.array_except(middle, F.array_union(F.col(words), last))})
    return found.filter(F.col("_ok") & (F.size("distinctive") >= least)).select(*by, order, "distinctive")


def invented(distinctive: Column, heard: Column) -> Column:
    """Whether at least half of the distinctive words of a skipped part were heard all the same."""
    return F.size(F.array_intersect(distinctive, heard)) / F.size(distinctive) >= 0.5


def finished(expected: Column, heard: Column) -> Column:
    """Whether what was heard ends with the last expected word."""
    return (F.size(heard) > 0) & F.try_element_at(heard, F.lit(-1)).eqNullSafe(F.try_element_at(expected, F.lit(-1)))


def completed_skip(skipped: Column, reference: Column, heard: Column) -> Column:
    """Whether a skipped phrase was heard whole; null where the reference has it itself, as the probe then says nothing."""
    return F.when(~phrase_present(reference, skipped), phrase_present(heard, skipped))


def safety(flags: str, scorable: Column, ended: Column, kinds: list[str]) -> list[Column]:
    """Counts and rates of rows whose decoding was flagged."""
    return [
        F.count_if(~scorable).alias("flagged"), F.avg((~scorable).cast("double")).alias("flag_rate"), F.avg(scorable.cast("double")).alias("coverage"), F.count_if(~ended).alias("unended"),
        *[F.count_if(F.array_contains(flags, k)).alias(k) for k in kinds],
    ]


def silence_rates(words: Column) -> list[Column]:
    """What was heard where nothing was said: share of rows with words, and how many words."""
    return [F.avg((F.size(words) > 0).cast("double")).alias("non_empty_rate"), F.sum(F.size(words)).alias("generated_words")]


def judge_form(heard: Column, context: Column, word: Column, others: Column, least: float = 0.6) -> Column:
    """own, other, neither, or unusable where fewer than `least` of the context's words were heard."""
    known = F.size(F.filter(context, lambda w: F.array_contains(heard, w)))
    return F.when(known < least * F.size(context), "unusable").when(F.array_contains(heard, word), "own").when(F.size(F.array_intersect(heard, others)) > 0, "other").otherwise("neither")


def span_summary(by: list[str], start: str, end: str, score: str) -> list[Column]:
    """Earliest start, latest end, mean score and all scores in order of their starts."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.col(score).alias("s"))))
    return [F.min(start).alias("start"), F.max(end).alias("end"), F.avg(score).alias("score"), F.transform(ordered, lambda x: x["s"]).alias("scores")]


def precise(regions: DataFrame, group: str, unit: str, owner: str) -> DataFrame:
    """(group, precise): whether every unit has a region, and every region one unit.  Rows are (group, unit, region id), the last null without one."""
    owners = regions.filter(F.col(owner).isNotNull()).groupBy(group, owner).agg(F.count_distinct(unit).alias("_n")).groupBy(group).agg(F.max("_n").alias("_most"))
    units = regions.groupBy(group, unit).agg(F.count(owner).alias("_n")).groupBy(group).agg(F.min("_n").alias("_least"))
    return units.join(owners, group, "left").select(group, ((F.col("_least") > 0) & F.coalesce(F.col("_most") == 1, F.lit(False))).alias("precise"))
