"""Latin sounds of words that are known, rule by rule, and as a column."""

import pytest

from textloom.functions import sounds as S

#: (spelling, said at a pause, notes among those given)
SAID = [
    ("كَتَبَ", "katab", ()), ("كِتَابٌ", "kitāb", ("nun or tanwin",)), ("قَالُواْ", "qālū", ()), ("مَدْرَسَةٌ", "madrasah", ()), ("بَيْتاً", "baytā", ()), ("بَيْتًا", "baytā", ()), ("هُدىً", "hudā", ()), ("سَمِيعٌ", "samīʿ", ()),
    ("الْقَمَرُ", "al-qamar", ()), ("الشَّمْسُ", "ash-shams", ()), ("وَالْقَمَرِ", "wal-qamar", ()), ("رَبُّ", "rabb", ()), ("آمَنَ", "ʾāman", ()), ("رَحْمَٰن", "raḥmān", ()), ("عِيسَى", "ʿīsā", ()),
    ("الم", "alif lām mīm", ("names of letters",)), ("اللَّهُ", "allāh", ()), ("لِلَّهِ", "lillāh", ()), ("الَّذِينَ", "alladhīn", ()), ("اِهْدِنَا", "ihdinā", ()), ("عَلَيْهِمْ", "ʿalayhim", ("mim of the plural",)),
    ("بْتْ", "bt", ()), ("قدر", "qdr", ("unvowelled consonant",)), ("ابن", "⟨?⟩bn", ("vowel of the first alif",)), ("قْاَم", "qʾam", ("alif within a word",)), ("قُام", "qum", ("silent or long alif",)), ("لَهُۥ", "lahū", ("small waw or yeh",)), ("ضَا\u0653لِّ", "ḍāll", ("length of a madd",)),
    ("a", "", ("unknown character",)), ("", "", ()), ("12", "", ()),
]


@pytest.mark.parametrize("spelling, said, notes", SAID)
def test_words_at_a_pause(spelling, said, notes):
    got = S.sounds(spelling)
    assert got["text"] == said and set(notes) <= set(got["notes"])


def test_words_in_speech():
    assert S.sounds("بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ")["words"] == ["bismi", "llāhi", "r-raḥmāni", "r-raḥīm"]
    assert S.sounds("كِتَابٌ كَبِيرٌ")["words"] == ["kitābun", "kabīr"] and S.sounds("كِتَابٌ كَبِيرٌ", pause=False)["words"] == ["kitābun", "kabīrun"]
    assert S.sounds("هُوَ الَّذِي كَتَبَ")["words"] == ["huwa", "lladhī", "katab"] and S.sounds("مَدْرَسَةً بَيْتاً هُدىً")["words"] == ["madrasatan", "baytan", "hudā"]
    assert S.sounds("قُلِ ادْعُوا")["words"][1].startswith("dʿū") and S.sounds(None)["words"] == []


def test_every_rule_is_used_and_the_first_that_fits():
    used = set()
    rules = S.RULES
    try:
        S.RULES = tuple((n, f, lambda p, n=n, s=s: (used.add(n), s(p))[1]) for n, f, s in rules)
        for spelling, *_ in SAID:
            S.sounds(spelling)
        S.sounds("قُلِ ادْعُوا بَيْتاً")
        S.sounds("قَدْحاٗ")
    finally:
        S.RULES = rules
    assert used == {n for n, *_ in rules}


def test_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(SAID)] + [(99, None)], "i int, t string")
    rows = {r.i: r.s for r in df.select("i", S.sounds_of(F.col("t")).alias("s")).collect()}
    assert [rows[i].text for i in range(len(SAID))] == [x[1] for x in SAID] and rows[99].words == []
