"""Token counts with a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens, n_bytes).
Texts are reduced to one row for each distinct digest of their normalised content
before anything is encoded; those that the cache lacks are encoded and appended; all
documents then take their counts from the cache by a join on the two digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.bpe import encoder
from textloom.llm.runtime import exists, scratch, stored

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long, n_bytes long"


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, version: str):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = batch.column("content")
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array([version] * len(texts), pa.string()), pa.array(own.counts(texts)), pc.cast(pc.binary_length(texts), pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens", "n_bytes"],
            )

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    max_tokens: int = 1024,
) -> DataFrame:
    """Return (id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    `normalise` must leave the tokens as they are (a tokenizer's own normaliser, say);
    by default content is the text itself.  `cache` is a path in storage that all
    executors share; without it a new one is made in the shared folder.

    A null text counts as empty (0 bytes, 0 tokens).  Rows with null or repeated ids
    each give a row.  Other columns are not carried, so their names do not matter.  An
    empty table gives an empty result.  Two jobs that append the same digest at once
    leave a repeated cache row, which is read as one.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch(spark, "token-cache")
    content = F.coalesce(F.col(text_col), F.lit(""))
    content = normalise(content) if normalise else content
    keyed = docs.select(F.col(id_col).alias("id"), content.alias("content"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    keyed = keyed.withColumn("content_digest", F.unhex(F.sha2("content", 256)))

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_digest") == version)
        return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    wanted = keyed.groupBy("content_digest").agg(F.first("content").alias("content"))
    if exists(spark, cache):
        wanted = wanted.join(known().select("content_digest"), "content_digest", "left_anti")
    wanted.mapInArrow(_encode(tokenizer, version), CACHE).write.mode("append").parquet(cache)

    # The counts are written first: then the join's sides are plain shuffles, and Spark splits a digest that very many rows share.
    counts = stored(known(), "token-counts")
    return keyed.select("id", "n_bytes", "content_digest").join(counts, "content_digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")
    )
