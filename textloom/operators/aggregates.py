"""Aggregates: rarity, error rates, strata, bootstrap intervals, votes, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rarity(tokens: DataFrame, token: str) -> DataFrame:
    """(token, postings, idf): idf = ln(1 + N / occurrences of the token), N all tokens.  A token nowhere in them would have ln(1 + N)."""
    held = tokens.groupBy(token).agg(F.count("*").alias("postings"))
    total = tokens.agg(F.count("*").alias("_n"))
    return held.crossJoin(F.broadcast(total)).select(token, "postings", F.log1p(F.col("_n") / F.col("postings")).alias("idf"))  # one row is broadcast


def bucket_votes(hits: DataFrame, by: list[str], bucket: str, voter: str, weight: str) -> DataFrame:
    """(by, bucket, votes): weights summed, with one vote for each voter in a bucket."""
    once = hits.groupBy(*by, bucket, voter).agg(F.max(weight).alias("_w"))
    return once.groupBy(*by, bucket).agg(F.sum("_w").alias("votes"))


def error_rates() -> list[Column]:
    """Corpus rates over rows of counts: ref_words, substitutions, deletions, insertions, hyp_words."""
    words = F.sum("ref_words")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    ratio = lambda x: F.sum(x) / F.nullif(words, F.lit(0))
    return [
        F.count("*").alias("rows"), words.alias("words"), ratio(errors).alias("wer"),
        ratio(F.col("substitutions")).alias("substitution_rate"), ratio(F.col("deletions")).alias("deletion_rate"), ratio(F.col("insertions")).alias("insertion_rate"),
        F.avg((errors == 0).cast("double")).alias("exact"), F.avg((F.col("deletions") > 0).cast("double")).alias("with_omission"), F.avg((F.col("hyp_words") == 0).cast("double")).alias("empty"),
    ]


def capped_rate() -> Column:
    """Errors over words where no row counts more errors than words."""
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return F.sum(F.least(F.col("ref_words"), errors)) / F.nullif(F.sum("ref_words"), F.lit(0))


def spread(groups: DataFrame, rate: str) -> DataFrame:
    """One row: the groups' mean, worst and best rate, and the gap."""
    return groups.agg(F.avg(rate).alias("macro"), F.max(rate).alias("worst"), F.min(rate).alias("best"), (F.max(rate) - F.min(rate)).alias("gap"), F.count("*").alias("groups"))


def resamples(groups: DataFrame, order: list[str], sums: list[str], repetitions: int = 500, seed: int = 42) -> DataFrame:
    """(repetition, sums...): groups drawn with replacement, as many as there are, and their columns summed.

    Draw s of repetition r is the group whose number is the first eight hexadecimal digits
    of MD5("seed:r:s") modulo their count; groups are numbered from 0 in `order`.  Groups
    are sums already and few: numbering them passes one task.  Draws are rows that Spark
    derives from one, so it takes them for few: they are dealt out by repetition, and the
    join is by hash of the groups' side, never a broadcast of draws.
    """
    numbered = groups.select(*sums, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("_k"))
    size = groups.agg(F.count("*").alias("_n"))
    draws = size.select("_n", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")).filter("_n > 0").repartition(repetitions, "repetition").select("_n", "repetition", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_s"))
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "repetition", "_s")), 1, 8), 16, 10).cast("long") % F.col("_n")
    return draws.select("repetition", picked.alias("_k")).join(numbered.hint("merge"), "_k").groupBy("repetition").agg(*[F.sum(c).alias(c) for c in sums])


def cluster_bootstrap(groups: DataFrame, order: list[str], errors: str, words: str, repetitions: int = 500, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row (groups, rate, low, high): the ratio of sums, and its percentile interval over resampled groups; null bounds for fewer than two."""
    tail = (1 - level) / 2
    drawn = resamples(groups, order, [errors, words], repetitions, seed).agg(F.percentile(F.col(errors) / F.greatest(F.lit(1), F.col(words)), [tail, 1 - tail]).alias("_q"))
    plain = groups.agg(F.count("*").alias("groups"), (F.sum(errors) / F.nullif(F.sum(words), F.lit(0))).alias("rate"))
    bound = lambda i: F.when(F.col("groups") >= 2, F.col("_q")[i])
    return plain.crossJoin(drawn).select("groups", "rate", bound(0).alias("low"), bound(1).alias("high"))  # one row each


def paired_bootstrap(groups: DataFrame, order: list[str], baseline: str, candidate: str, words: str, repetitions: int = 500, seed: int = 42) -> DataFrame:
    """One row (groups, difference, low, high): rate of candidate less that of baseline, and its interval over resampled groups."""
    drawn = resamples(groups, order, [baseline, candidate, words], repetitions, seed)
    drawn = drawn.agg(F.percentile((F.col(candidate) - F.col(baseline)) / F.greatest(F.lit(1), F.col(words)), [0.025, 0.975]).alias("_q"))
    plain = groups.agg(F.count("*").alias("groups"), paired_difference(groups, baseline, candidate, words).alias("difference"))
    bound = lambda i: F.when(F.col("groups") >= 2, F.col("_q")[i])
    return plain.crossJoin(drawn).select("groups", "difference", bound(0).alias("low"), bound(1).alias("high"))  # one row each


def paired_difference(pairs: DataFrame, errors_a: str, errors_b: str, words: str) -> Column:
    """Rate of b less rate of a over the same rows."""
    return (F.sum(errors_b) - F.sum(errors_a)) / F.nullif(F.sum(words), F.lit(0))


def label_scores(rows: DataFrame, expected: str, found: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, label, tp, fp, fn, precision, recall, f1) over rows with arrays of expected and found labels."""
    sides = [
        (F.array_intersect(expected, found), 1, 0, 0),
        (F.array_except(found, expected), 0, 1, 0),
        (F.array_except(expected, found), 0, 0, 1),
    ]

    def counted(tp, fp, fn):
        return lambda x: F.struct(x.alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))

    parts = F.flatten(F.array(*[F.transform(a, counted(*n)) for a, *n in sides]))
    long = rows.select(*by, F.explode(parts).alias("x")).select(*by, "x.*")
    out = long.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return out.withColumns({"precision": p, "recall": r, "f1": f1})


def votes(flags: DataFrame, item: list[str], flag: Column, least: int) -> DataFrame:
    """(item, votes, voters, flagged): how many models flag an item, and whether at least `least` do."""
    out = flags.groupBy(*item).agg(F.count_if(F.coalesce(flag, F.lit(False))).alias("votes"), F.count("*").alias("voters"))
    return out.withColumn("flagged", F.col("votes") >= least)


def first_wins(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by, value, variants): the earliest value of a key, and how many different ones there are."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value), F.count_distinct(value).alias("variants"))


def latency(value: str) -> list[Column]:
    """Exact median and 95th percentile with linear interpolation."""
    q = F.percentile(value, [0.5, 0.95])
    return [q[0].alias("p50"), q[1].alias("p95"), F.max(value).alias("worst")]


def standardised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): each dimension less its mean, by its population deviation, then to unit length; constant dimensions become 0."""
    long = df.select(key, F.posexplode(vector).alias("_d", "_x"))
    stats = long.groupBy("_d").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    maps = stats.agg(F.map_from_entries(F.collect_list(F.struct("_d", F.struct("_m", "_s").alias("v")))).alias("_stats"))  # one row, as many entries as dimensions
    scaled = df.crossJoin(F.broadcast(maps)).withColumn("_z", F.expr(f"transform({vector}, (x, i) -> if(_stats[i]._s > 0, (x - _stats[i]._m) / _stats[i]._s, 0D))"))
    norm = F.expr("sqrt(aggregate(_z, 0D, (a, x) -> a + x * x))")
    return scaled.select(key, F.expr("_z").alias("_z"), norm.alias("_n")).select(key, F.expr("transform(_z, x -> if(_n > 0, x / _n, 0D))").alias(vector))


def over_values(value: Column, by: list[str]) -> Column:
    """How many distinct values of `value` rows of the same key have."""
    return F.size(F.collect_set(value).over(Window.partitionBy(*by)))
