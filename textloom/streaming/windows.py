"""Event-time windows; the same functions take streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _timely(df: DataFrame, at: str, late: str) -> DataFrame:
    """A stream's watermark takes timestamps with a time zone only; those without are read in the session's."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if df.isStreaming else df


def sliding_counts(df: DataFrame, by: list[str], at: str, length: str, step: str, aggs: list[Column], late: str = "1 minute") -> DataFrame:
    """One row for each key and window of `length` that begins every `step`; rows later than `late` are dropped from streams."""
    grouped = _timely(df, at, late).groupBy(*by, F.window(at, length, step).alias("_w")).agg(*aggs)
    return grouped.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


def silence_sessions(df: DataFrame, by: list[str], at: str, gap: str, aggs: list[Column], late: str = "1 minute") -> DataFrame:
    """One row for each key and stretch without a silence of `gap`; its end is the last event plus `gap`."""
    grouped = _timely(df, at, late).groupBy(*by, F.session_window(at, gap).alias("_w")).agg(*aggs)
    return grouped.withColumns({"session_start": F.col("_w.start"), "session_end": F.col("_w.end")}).drop("_w")


def drop_repeats(df: DataFrame, keys: list[str], at: str, late: str = "1 minute") -> DataFrame:
    """One row for each key: of a stream, the first that arrives within the watermark."""
    return _timely(df, at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
