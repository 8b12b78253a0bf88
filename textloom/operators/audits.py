"""Audits: coverage, content classes, overrides, approvals, timings, grouped runs."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textloom.functions.text import phrase_present


def coverage(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(key, state): missing, unexpected or duplicate for keys that are not found exactly once where expected."""
    n = found.groupBy(*on).agg(F.count("*").alias("_n"))
    e = expected.select(*on).distinct().withColumn("_e", F.lit(True))
    both = e.join(n, on, "full_outer")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")
    return both.withColumn("state", state).filter("state is not null").select(*on, "state")


def content_class(checks: DataFrame, canonical: DataFrame, group: str, number: str, text: str, observed: str) -> DataFrame:
    """Adds what an observed text is, beside the canonical text of its (group, number).

    exact; empty; partial (some of the words, in order and together); another (all of
    another number's text, with their numbers); merged (two or three neighbouring texts from two before on);
    same_count; different.
    """
    w = Window.partitionBy(group).orderBy(number)
    nxt = lambda k: F.when(F.lead(number, k).over(w) == F.col(number) + k, F.lead(text, k).over(w))
    c = canonical.select(group, F.col(number).alias("_first"), F.col(text).alias("_one"), F.concat_ws(" ", F.col(text), nxt(1)).alias("_two"), nxt(1).alias("_b"), nxt(2).alias("_c"))
    runs = c.select(group, "_first", F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.col("_one").alias("t")),
        F.struct(F.lit(2).alias("n"), F.when(F.col("_b").isNotNull(), F.col("_two")).alias("t")),
        F.struct(F.lit(3).alias("n"), F.when(F.col("_b").isNotNull() & F.col("_c").isNotNull(), F.concat_ws(" ", "_two", "_c")).alias("t")),
    )).alias("r")).filter("r.t is not null").select(group, F.col("_first"), F.col("r.n").alias("_n"), F.col("r.t").alias("_t"))
    own = canonical.select(group, number, F.col(text).alias("_expected"))
    rows = checks.join(own, [group, number], "left").withColumn("_id", F.struct(group, number, F.col(observed)))
    keys = rows.select("_id", group, number, observed).distinct()
    hits = keys.join(runs.withColumnRenamed(group, "_g"), (F.col(group) == F.col("_g")) & (F.col(observed) == F.col("_t")))
    near = hits.groupBy("_id").agg(
        F.array_sort(F.collect_set(F.when((F.col("_n") == 1) & (F.col("_first") != F.col(number)), F.col("_first")))).alias("_others"),
        F.bool_or((F.col("_n") > 1) & F.col("_first").between(F.greatest(F.lit(1), F.col(number) - 2), F.col(number) + 1)).alias("_merged"),
    )
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    ref, obs = words(F.col("_expected")), words(F.col(observed))
    kind = (
        F.when(F.col(observed) == F.col("_expected"), "exact").when(F.size(obs) == 0, "empty")
        .when((F.size(obs) < F.size(ref)) & phrase_present(ref, obs), "partial")
        .when(F.size(F.coalesce("_others", F.array().cast(near.schema["_others"].dataType))) > 0, F.concat(F.lit("another:"), F.array_join(F.col("_others").cast("array<string>"), ",")))
        .when(F.coalesce("_merged", F.lit(False)), "merged").when(F.size(ref) == F.size(obs), "same_count").otherwise("different")
    )
    return rows.join(near, "_id", "left").withColumn("content", kind).drop("_id", "_expected", "_others", "_merged")


def override_issue(by: list[str], order: str, start: str, end: str, frames: Column, known: Column, bound: Column, reviewed: Column) -> Column:
    """Why a manual cut must be refused, or null: unknown, repeated, of another recording, out of range, overlapping, or not reviewed."""
    w = Window.partitionBy(*by).orderBy(order, start, end)
    n = F.count("*").over(Window.partitionBy(*by, order))
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown").when(n > 1, "repeated").when(~F.coalesce(bound, F.lit(False)), "other recording")
        .when(~F.coalesce((F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= frames), F.lit(False)), "out of range")
        .when(F.col(start) < F.lag(end).over(w), "overlapping").when(~F.coalesce(reviewed, F.lit(False)), "not reviewed")
    )


def approved(rows: DataFrame, decisions: DataFrame, on: list[str], hash_col: str) -> DataFrame:
    """Rows that one reviewer approved on both counts, with reviewer and date; decisions hold flags as text.

    Two decisions on a key, an approval without reviewer or date, or one of another
    hash, are errors.
    """
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in on]))).cast("string")
    yes = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))) == "true"
    d = decisions.withColumn("_n", F.count("*").over(Window.partitionBy(*on)))
    d = d.withColumn("_problem", F.when(F.col("_n") > 1, told("two decisions"))).filter(yes(F.col("listening")) & yes(F.col("boundary")) | F.col("_problem").isNotNull())
    nobody = (F.trim(F.coalesce("reviewer", F.lit(""))) == "") | (F.trim(F.coalesce("reviewed_at", F.lit(""))) == "")
    d = d.withColumn("_problem", F.when(nobody, told("no reviewer")).otherwise(F.col("_problem")))
    d = d.select(*on, "reviewer", "reviewed_at", F.col(hash_col).alias("_hash"), "_problem")
    out = rows.join(d, on)
    return out.withColumn("_problem", F.when(F.col("_hash") != F.col(hash_col), told("another hash")).otherwise(F.col("_problem"))).filter("_problem is null").drop("_hash", "_problem")


def checked_timings(words: Column, tokens: Column, duration: Column) -> Column:
    """An array of timed words (word, start, end), or null where any is not its token, not finite, or out of order or range."""
    number = lambda x: x.isNotNull() & ~F.isnan(x)
    good = F.forall(F.transform(words, lambda w, i: (
        w["word"].eqNullSafe(F.get(tokens, i)) & number(w["start"]) & number(w["end"]) & (w["start"] < w["end"]) & (w["end"] <= duration)
        & (w["start"] >= F.coalesce(F.get(words, i - 1)["end"], F.lit(0.0)))
    )), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when((F.size(words) > 0) & (F.size(words) == F.size(tokens)) & good, words)


def sound_verdict(p: Column, target: Column, spoken: Column, candidates: Column) -> Column:
    """correct, close or other for a forced choice: the target must be most likely, at 0.6 or more, and the transcript not another candidate."""
    best = F.array_position(p, F.array_max(p)) - 1
    bare = lambda c: F.regexp_replace(c, " ", "")
    another = F.exists(F.transform(candidates, lambda c, i: (i != target) & (bare(c) == bare(spoken))), lambda x: x)
    return F.when(best != target, "other").when((F.get(p, target) >= 0.6) & ~another, "correct").otherwise("close")


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, joined; null if none does."""
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def grouped_runs(df: DataFrame, by: list[str], order: str, seconds: str, seed: str, most_seconds: float = 25.0) -> DataFrame:
    """(by, first, members): maximal runs of consecutive rows cut into groups of two to four by a hash, those that last at most `most_seconds`.

    A run starts at its first or second row, as the hash of its first row says; each
    group's size is by the hash of the row that it begins with.  A fold over each run,
    whose rows are those of one chapter.
    """
    w = Window.partitionBy(*by).orderBy(order)
    run = df.withColumn("_g", F.col(order) - F.row_number().over(w))
    item = F.struct(F.col(order).alias("o"), F.col(seconds).cast("double").alias("s"))
    runs = run.groupBy(*by, "_g").agg(F.array_sort(F.collect_list(item)).alias("_r")).filter("size(_r) >= 2")
    draw = lambda o, n: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *by, o)), 1, 8), 16, 10).cast("long") % n).cast("int")
    start = draw(F.col("_r")[0]["o"], 2)
    state = F.struct(F.array().cast("array<array<struct<o:bigint,s:double>>>").alias("done"), F.array().cast("array<struct<o:bigint,s:double>>").alias("open"), F.lit(0).cast("int").alias("left"))

    def step(acc, x):
        x = F.struct(x["o"].cast("long").alias("o"), x["s"].alias("s"))
        fresh = acc["left"] == 0
        left = F.when(fresh, 2 + draw(x["o"], 3)).otherwise(acc["left"]) - 1
        grown = F.when(fresh, F.array(x)).otherwise(F.concat(acc["open"], F.array(x)))
        closed = left == 0
        return F.struct(F.when(closed, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(closed, F.array().cast("array<struct<o:bigint,s:double>>")).otherwise(grown).alias("open"), left.cast("int").alias("left"))

    folded = F.aggregate(F.slice("_r", start + 1, F.size("_r")), state, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    groups = runs.select(*by, F.explode(folded).alias("_x")).filter("size(_x) >= 2")
    # Rounded: a sum of fractions that comes to the limit must not miss it by a last bit, in whatever order it is summed.
    total = F.round(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x["s"]), 9)
    return groups.filter(total <= most_seconds).select(*by, F.col("_x")[0]["o"].alias("first"), F.size("_x").alias("members"))


_WORDS = T.ArrayType(T.StringType())
_like = lru_cache(maxsize=1 << 18)(lambda a, b: SequenceMatcher(None, a, b).ratio())


def _verdict(word: str, forms: list[str], letters: list[Counter]) -> int:
    """0 for a likeness of 0.8 to some form, 1 for 0.45, else 2; forms are tried by the most that their letters allow."""
    own, best = Counter(word), 0.0
    bounds = sorted(((2 * (own & x).total() / max(1, len(word) + len(f)), f) for f, x in zip(forms, letters, strict=True)), reverse=True)
    for most, form in bounds:
        if most <= best or most < 0.45 or best >= 0.8:
            break
        best = max(best, _like(word, form))
    return 0 if best >= 0.8 else 1 if best >= 0.45 else 2


@F.pandas_udf(T.StructType([T.StructField("correct", _WORDS), T.StructField("slips", _WORDS), T.StructField("omitted", _WORDS)]))
def omissions_of(expected: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """Expected words by their best likeness to any heard word (or to it without a final heh): 0.8 correct, 0.45 a slip, else omitted."""
    out = []
    for words, got in zip(expected, heard, strict=True):
        forms = sorted({f for g in ([] if got is None else got) for f in (g, g.removesuffix("ه"))})
        letters = [Counter(f) for f in forms]
        known: dict[str, int] = {}
        by: tuple[list, list, list] = ([], [], [])
        for w in [] if words is None else words:
            if w not in known:
                known[w] = _verdict(w, forms, letters)
            by[known[w]].append(w)
        out.append(by)
    return pd.DataFrame(out, columns=["correct", "slips", "omitted"])


def _letter_counts(texts: list[str], place: dict[str, int]) -> np.ndarray:
    """How often each text has each letter of `place`; other letters are not counted."""
    counts = np.zeros((len(texts), len(place)), np.int32)
    for n, t in enumerate(texts):
        for c in t:
            if c in place:
                counts[n, place[c]] += 1
    return counts


def best_matches(corpus: DataFrame, queries: DataFrame, key: str, text: str, query: str, block: int = 500, run_of: int = 2_000) -> DataFrame:
    """(query, key, ratio): the most alike text of each query; of equal ones the smallest key, and none where nothing is alike.

    A stated set of queries goes to the corpus in blocks of different texts, and each
    different text of the corpus is compared once, by its smallest key.  The counts of
    letters, taken for a run of texts at once, say how alike a text can be at most; texts
    are compared letter by letter from the highest such bound on, until the bound is below
    what has been found.  Each task keeps one row a query.
    """
    asked = [r[0] for r in queries.select(text).filter(F.col(text).isNotNull()).distinct().toLocalIterator()]
    kind = corpus.schema[key].dataType.simpleString()

    def over(some):
        def run(frames):
            best = {}
            place = {c: n for n, c in enumerate(sorted(set("".join(some))))}
            wanted, sizes = _letter_counts(some, place), np.array([len(x) for x in some])
            for frame in frames:
                for at in range(0, len(frame), run_of):
                    keys, texts = frame["k"].tolist()[at : at + run_of], frame["t"].tolist()[at : at + run_of]
                    held, lengths = _letter_counts(texts, place), np.array([len(t) for t in texts])
                    for n, x in enumerate(some):
                        both = lengths + sizes[n]
                        bound = np.where(both > 0, 2.0 * np.minimum(held, wanted[n]).sum(axis=1) / np.maximum(both, 1), 1.0)
                        top, k = best.get(x, (0.0, None))
                        some_at = np.flatnonzero((bound >= top) & (bound > 0))
                        for m in some_at[np.argsort(-bound[some_at], kind="stable")].tolist():
                            if bound[m] < top:
                                break
                            r = SequenceMatcher(None, x, texts[m]).ratio()
                            if r > top or (r == top and k is not None and keys[m] < k):
                                top, k = r, keys[m]
                        if k is not None:
                            best[x] = (top, k)
            yield pd.DataFrame([(x, k, r) for x, (r, k) in best.items()], columns=["x", "k", "r"])

        return run

    rows = corpus.filter(F.col(key).isNotNull()).groupBy(F.coalesce(text, F.lit("")).alias("t")).agg(F.min(key).alias("k"))
    rows = rows.select("k", "t").repartition(2 * corpus.sparkSession.sparkContext.defaultParallelism)
    found = None
    for at in range(0, max(1, len(asked)), block):
        part = rows.mapInPandas(over(asked[at : at + block]), f"x string, k {kind}, r double")
        found = part if found is None else found.unionByName(part)
    top = found.groupBy("x").agg(F.min(F.struct((-F.col("r")).alias("r"), "k")).alias("b"))
    asking = queries.select(F.col(query).alias("q"), F.col(text).alias("x"))
    return asking.join(top, "x").groupBy("q").agg(F.min("b").alias("b")).select(F.col("q").alias(query), F.col("b.k").alias(key), (-F.col("b.r")).alias("ratio"))
