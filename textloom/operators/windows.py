"""Window shapes over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(df: DataFrame, by: list[str], position: str, least: int = 1) -> DataFrame:
    """(by, first, last, n): maximal runs of consecutive whole numbers, those of at least `least`; repeats count once."""
    w = Window.partitionBy(*by).orderBy(position)
    runs = df.select(*by, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(w))
    out = runs.groupBy(*by, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).drop("_island")


def true_runs(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by, run, n): stretches of rows for which `flag` holds, numbered from 1 in each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    on = F.coalesce(flag, F.lit(False)).cast("int")
    marked = df.withColumn("_on", on).withColumn("_begins", F.when((F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0), 1).otherwise(0))
    return marked.withColumn("run", F.sum("_begins").over(w)).filter("_on = 1").groupBy(*by, "run").agg(F.count("*").alias("n"))


def moving_rms(df: DataFrame, by: list[str], order: list[str], value: str, frame: int) -> DataFrame:
    """Adds rms over the last `frame` rows of the group, null until there are as many."""
    w = Window.partitionBy(*by).orderBy(*order)
    f = w.rowsBetween(1 - frame, 0)
    return df.withColumn("rms", F.when(F.row_number().over(w) >= frame, F.sqrt(F.avg(F.col(value) * F.col(value)).over(f))))


def dense_peaks(df: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """Adds near (the sum over the bucket and its two neighbours; a gap counts as 0) and is_peak (no neighbour is higher)."""
    w = Window.partitionBy(*by).orderBy(bucket).rangeBetween(-1, 1)
    return df.withColumn("near", F.sum(value).over(w)).withColumn("is_peak", F.col(value) >= F.max(value).over(w))


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1 in a group, ties sharing the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def band(df: DataFrame, by: list[str], order: list[Column], bands: dict[str, tuple[int, int]], column: str = "band") -> DataFrame:
    """Adds the rank band of each row: the first of `bands` {name: (from, to)} that holds its place from 0, to excluded."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    out = df.withColumn("_place", place)
    expr = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(bands.items())):
        expr = F.when((F.col("_place") >= low) & (F.col("_place") < high), name).otherwise(expr)
    return out.withColumn(column, expr).drop("_place")


def recent_share(by: list[str], order: list[str], hit: Column, last: int) -> Column:
    """Share of hits among a row and the `last` - 1 before it."""
    return F.avg(hit.cast("double")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0))


def streaks(df: DataFrame, by: list[str], day: str, today: Column) -> DataFrame:
    """(by, streak): days in a row up to today, or up to yesterday if today is missing; 0 if older."""
    w = Window.partitionBy(*by).orderBy(day)
    days = df.select(*by, day).distinct().withColumn("_run", F.date_sub(F.col(day), F.row_number().over(w)))
    runs = days.groupBy(*by, "_run").agg(F.max(day).alias("_last"), F.count("*").alias("_n"))
    now = F.datediff(today, F.col("_last"))
    return runs.groupBy(*by).agg(F.max(F.when((now >= 0) & (now <= 1), F.col("_n")).otherwise(0)).alias("streak"))


def thirds(by: list[str], order: list[Column]) -> Column:
    """0, 1 or 2: which third of the ordered group a row is in, cut at floor(n/3) and floor(2n/3)."""
    w = Window.partitionBy(*by)
    place, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return F.when(place < F.floor(n / 3), 0).when(place < F.floor(2 * n / 3), 1).otherwise(2)


def next_present(by: list[str], order: list[str], value: Column) -> Column:
    """The next value in the group that is not null."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing))


def format_runs(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """(by, runs): the group's numbers as text, runs as first–last."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string")))
    runs = islands(df, by, position).withColumn("_text", one)
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "_text"))), lambda x: x["_text"]), ", ").alias("runs"))


def merge_groups(df: DataFrame, by: list[str], position: str, joins_previous: Column, text: str, start: str, end: str) -> DataFrame:
    """Rows that join their predecessor become one; groups are numbered anew from 1, texts joined, spans widened."""
    w = Window.partitionBy(*by).orderBy(position)
    begins = F.when(F.lag(position).over(w).isNull() | ~F.coalesce(joins_previous, F.lit(False)), 1).otherwise(0)
    numbered = df.withColumn("_begins", begins).withColumn("number", F.sum("_begins").over(w))
    out = numbered.groupBy(*by, "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), " ").alias(text),
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"),
    )
    return out
