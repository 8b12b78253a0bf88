"""Votes on diagonals: in arrays as by joins, without a shuffle of single votes."""

from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.aggregates import rarity
from textloom.plans import catalog


def test_cells_in_arrays_are_those_of_the_join(spark):
    texts = [(d, [f"w{(d * d + i * i) % 17}" for i in range(40 + 7 * d)]) for d in range(12)] + [(90, []), (91, None)]
    corpus = spark.createDataFrame(texts, "doc long, words array<string>").repartition(3)
    asked = spark.createDataFrame([(f"q{q}", [f"w{(q * 3 + i * i) % 19}" for i in range(30 * q)]) for q in range(5)], "item string, words array<string>")
    tokens = search.token_table(corpus, "doc", "words")
    heard = search.token_table(asked.withColumn("words", F.slice("words", 1, 90)), "item", "words")
    want = search.diagonal_votes(tokens, heard, "doc", "item", rarity(tokens, "word")).filter("votes > 4")
    got = search.strong_cells(corpus, asked, "doc", "item", "words", 4)
    plain = lambda df: sorted((r["item"], r["doc"], r["cell"], round(r["votes"], 6)) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) > 20


def test_single_votes_are_not_shuffled(spark, sf):
    plan = catalog.queries()["f2_diagonal_votes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_queries_are_read_whole(spark, tmp_path):
    words = [f"{a}{b}" for a in "abcdefghijklm" for b in "abcdefghij"]
    spark.createDataFrame([(1, " ".join(words[95:])), (2, "zz " * 400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", " ".join(words))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = catalog.queries()["f2_diagonal_votes"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.doc_id, r.cell) for r in rows] == [("i", 1, -24)]
    assert "1:90" not in catalog.oracle_sql()["f2_diagonal_votes"]


def test_bounds_lose_no_votes(spark, monkeypatch):
    """Sums as one array or without, queries with the same words, and blocks of few words give the votes of the join."""
    texts = [(d, [f"w{(d * d + i * i) % 17}" for i in range(30 + 5 * d)] * (1 + d % 3)) for d in range(9)]
    asked = [(f"q{q}", [f"w{(q // 2 * 3 + i * i) % 19}" for i in range(40 * (q // 2))]) for q in range(8)]
    corpus, heard = spark.createDataFrame(texts, "doc long, words array<string>"), spark.createDataFrame(asked, "item string, words array<string>")
    tokens = search.token_table(corpus, "doc", "words")
    want = search.diagonal_votes(tokens, search.token_table(heard, "item", "words"), "doc", "item", rarity(tokens, "word")).filter("votes > 6")
    plain = lambda df: sorted((r["item"], r["doc"], r["cell"], round(r["votes"], 6)) for r in df.collect())
    rows = plain(want)
    assert len(rows) > 20 and {"q6", "q7"} <= {r[0] for r in rows}
    for cells, block in ((1 << 22, 90_000), (0, 90_000), (1 << 22, 100)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "BLOCK_WORDS", block)
        blocks = list(search._blocks(corpus.withColumnRenamed("doc", "key"), heard, "item", "words", None))
        assert [n for names, _ in blocks for n in map(len, names)] == [2, 2, 2] and len(blocks) == (1 if block > 100 else 3)
        got = search.strong_cells(corpus, heard, "doc", "item", "words", 6, longest=None)
        assert plain(got) == rows
