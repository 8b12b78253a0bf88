"""Vector retrieval: neighbours of stated queries, and measures of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.windows import average_rank


def _packs(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of about `size` (key, vector) pairs each, dealt by a hash."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).dropna()
    n = max(1, -(-rows.count() // size))
    part = F.pmod(F.xxhash64("k"), F.lit(n))
    return rows.groupBy(part.alias("part")).agg(F.collect_list("k").alias(f"{name}_keys"), F.collect_list("v").alias(f"{name}_vectors")).drop("part")


def neighbours(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 2_048) -> DataFrame:
    """(query, neighbour, score, rank): the `k` nearest items to each query by cosine, itself excluded.

    Queries are a stated set, cut into blocks, and items into packs of about `block`;
    each block meets each pack as one matrix product, of which k candidates a query go
    on.  Zero vectors and nulls are left out on both sides.
    """
    import pandas as pd

    def run(frames):
        import numpy as np

        def side(keys, vectors):
            v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
            length = np.linalg.norm(v, axis=1)
            return np.asarray(keys)[length > 0], v[length > 0] / length[length > 0, None]

        for frame in frames:
            for row in frame.itertuples():
                q, a = side(row.query_keys, row.query_vectors)
                ids, b = side(row.item_keys, row.item_vectors)
                if not len(q) or not len(ids):
                    continue
                s = a @ b.T
                s[q[:, None] == ids[None, :]] = -2
                take = min(k, len(ids))
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                yield pd.DataFrame({"query": np.repeat(q, take), "neighbour": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    met = _packs(items, key, vector, block, "item").crossJoin(_packs(queries, key, vector, block, "query"))
    found = met.mapInPandas(run, "query long, neighbour long, score double").filter("score >= -1.5")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_measures(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, recall_at_k and mrr of (query, neighbour, rank) against pairs (query, neighbour)."""
    wanted = relevant.groupBy("query").agg(F.count("*").alias("wanted"))
    hits = ranked.join(relevant, ["query", "neighbour"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    per = wanted.join(hits, "query", "left")
    return per.agg(F.count("*").alias("queries"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def spearman(df: DataFrame, x: str, y: str) -> Column:
    """Rank correlation of two columns of a grouped table; see `with_ranks`."""
    return F.corr(f"{x}_rank", f"{y}_rank")


def with_ranks(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(f"{c}_rank", average_rank(by, c))
    return df


def blended_rank(df: DataFrame, sound: Column, close: Column, has_neighbours: Column, same_group: Column) -> DataFrame:
    """Adds blend: half sound, half closeness; halved where neighbours are known but not of this row; a little more in the same group."""
    base = 0.5 * F.coalesce(sound, F.lit(0.0)) + 0.5 * close
    return df.withColumn("blend", F.when(has_neighbours & sound.isNull(), base / 2).otherwise(base) + F.when(same_group, 0.1).otherwise(0.0))
