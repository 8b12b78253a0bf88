"""Normal forms on spellings whose forms are known."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import arabic as A

#: (rule, spellings, their current forms)
FORMS = [
    ("a dagger on a final alif maqsura is not heard apart", "هُدَىٰ رَمَىٰ سَعَىٰ", "هدى رمى سعى"),
    ("a dagger on a yeh before an ending is an alif", "رَمَيٰهُمْ قَضَيٰهَا", "رماهم قضاها"),
    ("a dagger on a waw before ta marbuta is an alif", "حَيَوٰةٍ", "حياة"),
    ("a dagger behind a heard yeh leaves the yeh", "بَيَٰنٍ", "بيان"),
    ("other daggers are alifs", "كِتَٰبٌ", "كتاب"),
    ("some words are written without the alif", "هَٰذَا لَٰكِنِ", "هذا لكن"),
    ("a vocative is a word", "يَٰنُوحُ فَيَٰلَيْتَ يَٰٓأَهْلَ", "يا نوح فيا ليت يا اهل"),
    ("joining alifs are alifs", "ٱلسَّلَامُ اِ۬لْقَمَرُ", "السلام القمر"),
    ("the barred yeh is a yeh", "اِ۬لتِے", "التي"),
    ("a hamza before an alif goes, others stay", "ءَامِنٌ شَيْءٌ رُءُوسٌ سُؤَالٌ", "امن شيء رءوس سؤال"),
    ("alifs lose their hamza", "أَمَلٌ إِبِلٌ آمَالٌ", "امل ابل امال"),
    ("digits, strokes, vowels and still letters go", "عَمَلاً 12 ٣ مـــد قَالُواْ", "عملا مد قالوا"),
]


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_current_form_and_its_form(spark):
    got = values(spark, A.asr_form(F.col("t")), [t for _, t, _ in FORMS] + ["", None])
    assert dict(zip([r for r, *_ in FORMS], got)) == {r: f for r, _, f in FORMS} and got[-2:] == ["", None]
    assert values(spark, A.asr_form(F.col("t")), got) == got


def test_first_form_and_versions(spark):
    assert values(spark, A.asr_form_v1(F.col("t")), ["بَيَٰنٍ يَٰنُوحُ", "هَٰذَا لَٰكِنِ"]) == ["بان انوح", "هذا لكن"]
    with pytest.raises(Exception, match="unknown version"):
        values(spark, A.form_for(F.lit("other"), F.col("t")), ["a"])


def test_display_and_hamza(spark):
    assert values(spark, A.display_form(F.col("t")), ["هُدَىٰ رَمَيٰهُمْ", "آمَالٌ"]) == ["هدى رماهم", "آمال"]
    assert values(spark, A.compose_hamza(F.col("t")), ["دِفْـَٔهُمْ"]) == ["دِفْأهُمْ"]


def test_small_forms(spark):
    assert values(spark, A.skeleton(F.col("t"), "ا"), ["ءا", "اللهه", "رحمة"]) == ["ا", "له", "رحمه"]
    assert sorted(values(spark, A.alif_forms(F.col("t")), ["اب"])[0]) == sorted(["اب", "أب", "إب", "آب"])
    assert values(spark, A.alif_forms(F.col("t")), ["ااااا"]) == [["ااااا"]]
    assert values(spark, A.word_key(F.col("t")), ["رَحْمَـٰن", "été"]) == ["رحمن", "ete"]
