"""Rules in arrays against rules as windows, on verses of odd words, and their plans."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from test_recitation import KNOWN, NOT

from textloom.operators import glyphs, letters as L, recitation as R, rulebook as B
from textloom.plans import catalog

POOL = [w for t, *_ in KNOWN + NOT for w in t.split()] + [p + w for first, own, *_ in R.WORDS for w in own.split() for p in ("", *first)] + [p[0] for p in R.PHRASES]
POOL += [*R.OPENING_WORDS, "كَٓهَيَعَٓصَٓۖ", "طَسِٓمِّٓۖ", "لله", "والله", "اللهم", "لِلَّهِ", "ـٔا", "ـٕ", "يَـُٔو", "abc", "12", ",", "ءَأَنتَ"]
LETTERS, MARKS = "ءاأإآبتثجحخدذرزسشصضطظعغفقكلمنهوييىةٱےۓئؤ", "َُِّْ" * 3 + "ًࣰٌࣱٍࣲٰٖٓۢٗٞۥۦ۪ٕۧ۬۟ٔـۖ"
BY = ["k"]


def odd_verses(n=260):
    rnd = random.Random(11)

    def word():
        if rnd.random() < 0.6:
            return rnd.choice(POOL)
        return "".join(rnd.choice(LETTERS) + "".join(rnd.choice(MARKS) for _ in range(rnd.choice((0, 0, 1, 1, 1, 2, 3)))) for _ in range(rnd.randrange(1, 7)))

    def verse(i):
        text = "".join(word() + rnd.choice((" ", " ", "  ", "\t", "-", " ۖ ")) for _ in range(rnd.randrange(9)))
        return " ".join(rnd.choice(R.OPENING_WORDS) for _ in range(rnd.randrange(3))) + " " + text if i % 3 == 0 else text

    return [(i, rnd.choice((None, 2, 3, 7, 18, 19, 26, 42, 42, 70, 75)), rnd.choice((1, 1, 2, 5, None)), None if i % 50 == 0 else verse(i)) for i in range(n)]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_arrays_are_the_windows(spark, monkeypatch):
    monkeypatch.setattr(glyphs, "RUN_BYTES", 3_000)
    verses = spark.createDataFrame(odd_verses(), "k int, c int, v int, t string").repartition(3).persist()
    want = rows(L.annotated(verses, BY, "t"))
    assert rows(glyphs.annotated(verses, BY, "t")) == want and len(want) > 500
    want = R.recited(verses, BY, "c", "v", "t").persist()
    assert rows(glyphs.recited(verses, BY, "c", "v", "t")) == rows(want) and len({r.rule for r in want.collect()}) > 25
    rules = B.all_rules(verses, BY, "c", "v", "t").persist()
    assert rows(glyphs.segments(verses, BY, "c", "v", "t")) == rows(B.segments(verses, rules, BY, "t"))
    assert rows(glyphs.tagged_words(verses, BY, "c", "v", "t")) == rows(B.tagged_words(verses, rules, BY, "t"))


def test_words_of_the_name_are_those_of_the_pattern():
    import itertools
    import re

    assert all(re.search(R.ALLAH, w) for w in glyphs.ALLAH_WORDS)
    some = {"".join(p) for n in range(4) for p in itertools.product("وفاءبتكلهم", repeat=n)}
    found = {a + "لله" + b for a in some for b in ("", "م", "ه") if re.search(R.ALLAH, a + "لله" + b)}
    assert found <= set(glyphs.ALLAH_WORDS)


def test_texts_do_not_run_together():
    s = glyphs.Letters(pa.array(["", "مِنْ", "َبَ لا", "", " x", "ل"]))
    assert s.text.tolist() == [1, 1, 2, 2, 2, 5] and s.number.tolist() == [0, 0, 0, 1, 1, 0] and s.index.tolist() == [0, 1, 0, 0, 1, 0]
    assert s.vowel.tolist() == [glyphs.I, 0, glyphs.A, 0, 0, 0] and s.size.tolist() == [2, 2, 2, 1, 1, 1]
    assert glyphs.Letters(pa.array([], pa.string())).n == 0 and glyphs.Letters(pa.array(["", ""])).n == 0
    part = pa.array(["ب", "تُت", "ج"]).slice(1, 1)
    assert glyphs.Letters(part).vowel.tolist() == [glyphs.U, 0]


def test_rule_queries_have_no_rows_of_letters(spark, sf):
    """Their plans had windows over letters, sorted and joined: some forty of them."""
    for name in ("ru1_ru2_ru3_ru4_ru7_letter_rules", "ru5_ru6_ru8_ru9_ru10_verse_rules", "ru12_segments", "ru13_ru15_tagged_words"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "MapInArrow" in plan, name


def test_tallies_are_counts_of_rows(spark):
    verses = spark.createDataFrame(odd_verses(60), "k int, c int, v int, t string")
    for tally, plain in ((glyphs.annotated_tally(verses, BY, "t"), L.annotated(verses, BY, "t")), (glyphs.recited_tally(verses, BY, "c", "v", "t"), R.recited(verses, BY, "c", "v", "t"))):
        want = plain.groupBy("k", "rule").agg(F.count("*").alias("n"), F.sum("word").alias("words"), F.sum("index").alias("indexes"))
        assert rows(tally) == rows(want)
