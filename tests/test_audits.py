"""Audits and lessons: what has no SQL against plain statements, and errors."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.operators import audits as A
from textloom.plans import audits, catalog


def test_omissions_are_plain(spark, sf):
    rows = [(1, ["one", "two", "three", "three"], ["on", "tow", "thrée"]), (2, [], ["a"]), (3, ["a", "b"], []), (4, ["رحمة"], ["رحمته"]), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    for r in df.select("i", "a", "b", A.omissions_of("a", "b").alias("o")).collect():
        want = ([], [], [])
        for w in r.a or []:
            like = max((SequenceMatcher(None, w, f).ratio() for g in r.b or [] for f in (g, g.removesuffix("ه"))), default=0)
            want[0 if like >= 0.8 else 1 if like >= 0.45 else 2].append(w)
        assert tuple(r.o) == want


def test_whole_turns_are_judged(spark, sf):
    for r in catalog.queries()["al12_omissions"](spark, sf).limit(20).collect():
        assert len(r.correct) + len(r.slips) + len(r.omitted) > 0
    n = catalog.queries()["al12_omissions"](spark, sf).select(F.sum(F.expr("size(correct) + size(slips) + size(omitted)"))).first()[0]
    t = audits.read(spark, sf, "conversations").selectExpr("conv_id", "turn", "size(filter(split(text, '\\\\s+'), x -> x <> '')) n", "lead(turn) over (partition by conv_id order by turn) b")
    assert n == t.filter("b is not null").agg(F.sum("n")).first()[0]


def test_best_matches_are_plain(spark, sf):
    names = {r.p_partkey: r.p_name for r in audits.read(spark, sf, "part").collect()}
    got = {r.asked: (r.p_partkey, round(r.ratio, 9)) for r in catalog.queries()["al11_best_matches"](spark, sf).collect()}
    for asked in [k for k in names if k % 20 == 0]:
        like = {k: SequenceMatcher(None, names[asked][::-1], n).ratio() for k, n in names.items()}
        top = max(like.values())
        assert got[asked] == (min(k for k, v in like.items() if v == top), round(top, 9))


def test_approvals_that_must_fail(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h")], "k int, h string")
    good = (1, "h", "true", "TRUE ", "me", "today")
    make = lambda *d: spark.createDataFrame(list(d), "k int, h string, listening string, boundary string, reviewer string, reviewed_at string")
    assert [r.k for r in A.approved(rows, make(good, (2, "h", "true", "", "me", "today")), ["k"], "h").collect()] == [1]
    for bad, why in (((good, good), "two decisions"), (((1, "x", "true", "true", "me", "today"),), "another hash"), (((1, "h", "true", "true", " ", "today"),), "no reviewer")):
        with pytest.raises(Exception, match=why):
            A.approved(rows, make(*bad), ["k"], "h").collect()


def test_grouped_runs_reach_the_limit_exactly(spark):
    hundredths = (473, 1387, 449, 191)  # 25 seconds; summed in this order as doubles they come to more
    total = 0.0
    for x in hundredths:
        total += x / 100
    assert total > 25 == sum(hundredths) / 100
    rows = [(k, o, x / 100) for k in range(40) for o, x in enumerate(hundredths)]
    got = A.grouped_runs(spark.createDataFrame(rows, "k long, o long, s double"), ["k"], "o", "s", "s").collect()
    assert any(r.first == 0 and r.members == 4 for r in got)
