"""Words of one recogniser with the tags of another, as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions.tags import transferred_of


def paired_streams(words: DataFrame, tagged: DataFrame, late: str = "10 seconds", apart: str = "5 seconds") -> DataFrame:
    """(session, window, at, text, tagged, words): each row of `words` with the tags of the row of `tagged` of the same session and window.

    Both are (session, window, at, text), streams or tables.  Rows that lie more than `apart`
    from one another in time belong to different windows.  A row of words without a tagged
    one comes without tags: from streams once both watermarks have passed the time in which
    one could come, later tags then change nothing.  Tags without words are dropped, as are
    rows of words without a time; rows with null keys come without tags.  Where a window has
    several tagged rows, each gives a row.  Text whose words differ gets tags where the normal
    alignment finds equal words or replacements of equal length.
    """
    streaming = words.isStreaming or tagged.isStreaming
    sides = []
    for df, p in ((words, "w_"), (tagged, "t_")):
        side = df.select(*[F.col(c).alias(p + c) for c in ("session", "window")], F.col("at").cast("timestamp").alias(p + "at"), F.col("text").alias(p + "text")).filter(f"{p}at is not null")
        sides.append(side.withWatermark(p + "at", late) if streaming else side)
    near = F.expr(f"t_at >= w_at - interval {apart} and t_at <= w_at + interval {apart}")
    both = sides[0].join(sides[1], (F.col("w_session") == F.col("t_session")) & (F.col("w_window") == F.col("t_window")) & near, "left_outer")
    named = both.select(F.col("w_session").alias("session"), F.col("w_window").alias("window"), F.col("w_at").alias("at"), F.col("w_text").alias("text"), F.col("t_text").alias("tagged"))
    return named.withColumn("words", transferred_of("text", "tagged"))
