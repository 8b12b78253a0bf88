"""Line dedup across documents, with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed (two 64-bit hashes with
different seeds, so 128 bits); the documents of each hash are counted; lines over the
threshold are dropped and each text is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.runtime import stored

#: White space at the ends of a line that a key does not hold.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(row, text, lines, dropped): each input row as one struct, its new text and the counts; so no name can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    lines = rows.filter("id is not null").select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    keys = keys.select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    # Two documents at least is a question of the smallest and the largest id; more are counted.
    shared = keys.groupBy("h1", "h2").agg(F.min("id").alias("first"), (F.max("id") if min_docs == 2 else F.count_distinct("id")).alias("docs"))
    shared = shared.filter(F.col("docs") > F.col("first") if min_docs == 2 else F.col("docs") >= min_docs).select("h1", "h2", "first")
    # Written first, so that the join's sides are plain shuffles and Spark splits the rows of a line that very many documents hold.
    dropped = keys.join(stored(shared, "shared-lines"), ["h1", "h2"]).filter("id <> first")
    gone = dropped.groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("gone"))

    # Three steps, so that Spark splits each text once: a flag for each line up to the last that goes.
    joined = rows.join(gone, ["id", "version"], "left")
    at = F.coalesce("gone", F.array().cast("array<int>"))
    before = F.concat(F.array(F.lit(-1)), at)
    flags = F.flatten(F.zip_with(at, before, lambda a, b: F.when(a.isNotNull(), F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>"))))
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.array_compact(F.zip_with(split, flags, lambda line, flag: F.when(flag, F.lit(None)).otherwise(line))), "\n")
    return joined.select("row", F.when(F.size(at) == 0, F.col("text")).otherwise(kept).alias("text"), F.size(split).cast("long").alias("lines"), F.size(at).cast("long").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Return `docs` with `text_col` deduplicated, and columns n_lines and n_dropped.

    A line whose key has at least `min_chars` code points and is found in at least
    `min_docs` documents stays only in the smallest id that holds it (there with all
    its repeats).  Columns named n_lines or n_dropped in the input are replaced; all
    others are kept, whatever their names.

    A null text counts as one empty line and comes back empty.  A row with a null id
    stays as it is and counts for no key.  Rows that share an id are one document; the
    smallest id keeps the line in each of them.  An empty table gives an empty result.
    """
    own = docs.drop("n_lines", "n_dropped")
    out = _deduped(own, id_col, text_col, min_chars, min_docs)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in own.columns], F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with `text_col` deduplicated as by `dedup_lines`, and all its columns as they are, whatever their names.

    `chars_col`, if the table has it, then holds the new text's code points.
    """
    out = _deduped(docs, id_col, text_col, min_chars, min_docs)
    new = {text_col: F.col("text"), chars_col: F.char_length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
