"""Rules of verses on words whose rules are known, and phrases found at once against one by one."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import phrases, recitation

#: (verse, chapter, number, word, letters from the word's skeleton at which the rule begins, rule)
KNOWN = [
    ("جَاءَ أَمْرُ", 11, 3, 0, 1, "madd_muttasil"), ("إِنَّا أَعْطَيْنَا", 108, 1, 0, 2, "madd_munfasil"), ("وَلَا الضَّآلِّينَ", 1, 7, 1, 3, "madd_lazim"), ("الْعَٰلَمِينَ", 1, 2, 0, 5, "madd_arid"),
    ("قَالَ رَبِّ", 3, 5, 0, 1, "madd_tabii"), ("لَهُۥ مَا", 2, 9, 0, 1, "madd_silah"), ("مَالَهُۥ أَخْلَدَهُ", 104, 3, 0, 3, "madd_munfasil"), ("هَٰذَا الْبَيْتِ", 106, 3, 1, 3, "madd_lin"),
    ("عَلِيماً", 4, 17, 0, 4, "madd_iwad"), ("ءَامَنُواْ بِهِ", 2, 9, 0, 1, "madd_badal"), ("مِنَ السَّمَآءِ", 2, 22, 1, 4, "madd_muttasil_waqf"), ("فِي الْأَرْضِ", 2, 11, 0, 1, "wasl_drop"), ("يَٰأَيُّهَا النَّاسُ", 2, 21, 0, 0, "madd_munfasil"),
    ("رَبُّ", 2, 4, 0, 0, "ra_tafkhim"), ("رِجَالٌ صَدَقُوا", 33, 23, 0, 0, "ra_tarqiq"), ("فِرْعَوْنَ مَا", 2, 49, 0, 1, "ra_tarqiq"), ("مِرْصَادًا لَا", 78, 21, 0, 1, "ra_tafkhim"), ("فِرْقٍ كَانَ", 26, 63, 0, 1, "ra_both"),
    ("خَيْرٌ", 2, 54, 0, 2, "ra_tarqiq"), ("النَّارُ", 2, 24, 0, 4, "ra_tafkhim"), ("مِنْ مِصْرَ", 12, 21, 1, 2, "ra_both"), ("السِّحْرُ", 10, 81, 0, 4, "ra_tarqiq"), ("قَدِيرٌ", 2, 20, 0, 3, "ra_tarqiq"),
    ("قَالَ اللَّهُ", 5, 12, 1, 2, "lam_tafkhim"), ("بِسْمِ اللَّهِ", 1, 1, 1, 2, "lam_tarqiq"), ("لِلَّهِ مَا", 2, 284, 0, 1, "lam_tarqiq"),
    ("أَلَٓمِّٓۖ ذَٰلِكَ", 2, 1, 0, 1, "madd_lazim_harfi"), ("أَلَٓمِّٓۖ ذَٰلِكَ", 2, 1, 0, 2, "ghunna"), ("كَٓهَيَعَٓصَٓۖ ذِكْرُ", 19, 1, 0, 3, "madd_ayn"), ("كَٓهَيَعَٓصَٓۖ ذِكْرُ", 19, 1, 0, 1, "madd_harfi_tabii"), ("طَسِٓمِّٓۖ", 26, 1, 0, 1, "idgham_riwaya"),
    ("شُهَدَآءَ ا۪ذْ حَضَرَ", 2, 132, 1, 0, "tasheel"), ("مَنْ يَّشَآءُ اِ۪لَىٰ", 2, 141, 2, 0, "ibdal"), ("قُلْ أَرَٰ۬يْتَكُمْ", 6, 41, 1, 1, "tasheel"), ("شَفَا جُرُفٍ ه۪ارٖ فَانْهَارَ", 9, 110, 2, 0, "imala"), ("لُوطاٗ س۬ےٓءَ بِهِمْ", 11, 76, 1, 0, "ishmam"), ("لَا تَع۬دُّواْ فِے", 4, 153, 1, 1, "ikhtilas"),
    ("إِنَّ يَاجُوجَ وَمَاجُوجَ", 18, 90, 1, 1, "ibdal"), ("إِنَّ يَاجُوجَ وَمَاجُوجَ", 18, 90, 2, 2, "ibdal"), ("يُؤَدِّهِ إِلَيْكَ", 3, 74, 0, 3, "ha_kinaya_qasr"), ("وَهْوَ بِكُلِّ", 2, 28, 0, 1, "ha_sukun"), ("يَلْهَثْ ذَّٰلِكَ", 7, 176, 0, 3, "idgham_riwaya"),
    ("مَنْ رَاقٍ", 75, 26, 0, 1, "no_sakt"), ("ثُمَّ اتَّخَذتُّمُ", 2, 50, 1, 3, "idgham_riwaya"), ("اَ۬لتَّوْرَيٰةَ", 3, 2, 0, 5, "taqlil"), ("كَمْ لَبِثْتَ", 2, 258, 1, 2, "idgham_riwaya"),
]
NOT = [
    ("أَلَمْ تَرَ", 2, 5, "madd_lazim_harfi"), ("وَلَا يَـُٔودُهُۥ حِفْظُهُمَا", 2, 254, "ha_kinaya_qasr"), ("مَنْ رَاقٍ", 74, 26, "no_sakt"), ("وَهُوَ الَّذِي", 6, 2, "ha_sukun"), ("قَالَ الَّذِي", 2, 5, "lam_tafkhim"), ("جَآءَ اَ۬لْحَقُّ", 17, 81, "tasheel"),
]


def test_known_rules_of_verses(spark):
    rows = [(i, c, v, t) for i, (t, c, v, *_) in enumerate(KNOWN + NOT)]
    df = spark.createDataFrame([*rows, (900, None, None, "الٓمٓ رَبُّ"), (901, 2, 1, None), (902, 2, 1, "12 abc")], "k int, c int, v int, t string")
    found = {}
    for r in recitation.recited(df, ["k"], "c", "v", "t").collect():
        found.setdefault(r.k, set()).add((r.word, r["index"], r.rule))
    wrong = [(t, (w, i, rule), found.get(k)) for k, (t, _, _, w, i, rule) in enumerate(KNOWN) if (w, i, rule) not in found.get(k, ())]
    assert not wrong, wrong
    assert not [(t, rule) for k, (t, _, _, rule) in enumerate(NOT, len(KNOWN)) if rule in {x[2] for x in found.get(k, ())}]
    assert 901 not in found and 902 not in found and not any(x[2].endswith("harfi") for x in found[900])


def test_phrases_at_once_are_those_found_one_by_one(spark):
    rnd = random.Random(5)
    words = ["a", "b", "ab", "ba", "c", ""]
    texts = [(i, None if i % 9 == 0 else [rnd.choice(words[:5]) for _ in range(rnd.randrange(14))]) for i in range(200)]
    table = [(i, [rnd.choice(words[:5]) for _ in range(rnd.randrange(4))]) for i in range(60)] + [(99, None), (98, ["a", "b"]), (97, ["a", "b"])]
    want = sorted((k, i, len(p), n) for k, t in texts for n, p in table if p for i in range(len(t or []) - len(p) + 1) if t[i : i + len(p)] == p)
    df = spark.createDataFrame(texts, "k int, w array<string>").repartition(3)
    pdf = spark.createDataFrame(table, "phrase int, words array<string>")
    assert sorted(map(tuple, phrases.find_phrases(df, ["k"], F.col("w"), pdf).collect())) == want and want
    assert phrases.find_phrases(df, ["k"], F.col("w"), pdf.limit(0)).count() == 0 and phrases.find_phrases(df.limit(0), ["k"], F.col("w"), pdf).count() == 0
    with pytest.raises(ValueError, match="phrases"):
        phrases.find_phrases(df, ["k"], F.col("w"), pdf, most=3)
