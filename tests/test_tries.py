"""Trees of words against the list of all sequences, and candidate scores against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import tries

END = 99


def sequences(first, following, most):
    """All sayings of up to `most` words."""
    out = [()]
    last = [()]
    for n in range(most):
        last = [s + w for s in last for w in (first if n == 0 else following)]
        out += last
    return out


def test_trees_are_the_table_of_sequences(spark):
    rnd = random.Random(2)
    words, said, want = [], [], []
    for scope in range(6):
        own = {(tuple(rnd.randrange(3) for _ in range(rnd.randrange(1, 4))), rnd.random() < 0.5) for _ in range(rnd.randrange(1, 6))}
        words += [(scope, list(t), f) for t, f in own]
        every = sequences([t for t, _ in own], [t for t, f in own if f], 5)
        tries_ = {s[:n] for s in every for n in range(min(len(s), 4) + 1)} | {(rnd.randrange(4), rnd.randrange(4)) for _ in range(5)}
        for s in tries_:
            # Words have three tokens at most: what four words do not show, more do not either.
            nxt = {q[len(s)] for q in every if len(q) > len(s) and q[: len(s)] == s} | ({END} if s in every else set())
            said.append((scope, list(s)))
            want.append((scope, s, tuple(sorted(nxt)) or None))
    trees = tries.word_trees(spark.createDataFrame([*words, *words[:3], (0, None, True), (0, [], True)], "scope int, tokens array<int>, follows boolean").repartition(3))
    for most in (1_000, 0):
        got = tries.allowed_next(spark.createDataFrame(said, "scope int, sequence array<int>"), trees, END, most_nodes=most).collect()
        assert sorted(((r.scope, tuple(r.sequence), r.next and tuple(r.next)) for r in got), key=lambda x: (x[0], x[1])) == sorted(want, key=lambda x: (x[0], x[1]))


def test_ends_scopes_and_nulls(spark):
    trees = tries.word_trees(spark.createDataFrame([("s", [1, 2], False), ("s", [3, 1], True), (None, [7], None)], "scope string, tokens array<int>, follows boolean"))
    rows = [("s", None), ("s", [END]), ("s", [1, 2, END, END]), ("s", [1, END]), ("s", [1, 2, END, 1]), ("s", [1, 2]), ("s", [1, 2, 1]), (None, [7]), ("t", [])]
    got = [r.next for r in sorted(tries.allowed_next(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, scope string, sequence array<int>"), trees, END).collect(), key=lambda r: r.i)]
    assert got == [[1, 3, END], [END], [END], None, None, [3, END], None, [END], None]
    assert tries.word_trees(spark.createDataFrame([], "scope string, tokens array<int>, follows boolean")).count() == 0


def test_candidate_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=(4, 5)).tolist(), rng.integers(0, 5, 4).tolist(), i % 3) for i in range(20)] + [(98, [], [], 0), (99, None, [1], 0)]
    df = spark.createDataFrame(rows, "i int, l array<array<double>>, ids array<int>, skip int")
    got = {r.i: r.s for r in df.select("i", tries.candidate_score(F.col("l"), F.col("ids"), F.col("skip")).alias("s")).collect()}
    for i, logits, ids, skip in rows[:20]:
        p = np.array(logits) - np.log(np.exp(logits).sum(1, keepdims=True))
        assert abs(got[i] - sum(p[k, ids[k]] for k in range(skip, 4))) < 1e-9
    assert got[98] == 0 and got[99] is None


def test_a_large_tree_never_lies_beside_rows(spark):
    words = spark.createDataFrame([("a", [1, 2], False), ("a", [1, 3], False), ("a", [9, 1], True), (None, [4], False)], "scope string, tokens array<int>, follows boolean")
    said = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate([("a", [1]), ("a", [1]), ("a", None), ("a", []), ("a", [7]), ("b", [1]), (None, [4]), (None, [])] * 3)], "i int, scope string, sequence array<int>")
    few = tries.allowed_next(said, tries.word_trees(words), 0)
    many = tries.allowed_next(said, tries.word_trees(words), 0, most_nodes=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.columns == few.columns
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan


def test_without_a_tree_as_with_one(spark):
    rnd = random.Random(8)
    words = [(rnd.choice(("a", "b", None)), [rnd.randrange(1, 4) for _ in range(rnd.randrange(4))], rnd.choice((True, False, None))) for _ in range(24)] + [("a", None, True)]
    said = [(rnd.choice(("a", "b", None, "c")), rnd.choice((None, *[[rnd.choice((1, 2, 3, 1, 2, END)) for _ in range(rnd.randrange(7))] for _ in range(9)]))) for _ in range(400)]
    said += [(s, [1, 2, 3, 1, 2][:k] + [END] * e) for s in ("a", "b", None, "c") for k in range(6) for e in range(3)]
    df, table = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "i int, scope string, sequence array<int>").repartition(3), spark.createDataFrame(words, "scope string, tokens array<int>, follows boolean")
    got, want = (sorted(map(str, x.collect())) for x in (tries.allowed_after(df, table, END), tries.allowed_next(df, tries.word_trees(table), END)))
    assert got == want and len({x.split("next=")[1] for x in got}) >= 8
    assert {r.next is None for r in tries.allowed_after(df, table.limit(0), END).collect()} == {True} and tries.allowed_after(df.limit(0), table, END).count() == 0


def test_words_of_a_scope_are_not_in_one_task(spark, sf):
    """The plan had a tree of all words of a language in one group."""
    from textloom.plans import catalog

    plan = catalog.queries()["mi21_next_letters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CoGroup" not in plan
