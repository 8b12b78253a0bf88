"""The book of rules, what letters show of it, and tagged targets."""

from textloom.operators import recitation, rulebook as R

VERSES = [(1, 2, "الْحَمْدُ لِلَّهِ رَبِّ الْعَٰلَمِينَ"), (114, 4, "مِنْ شَرِّ الْوَسْوَاسِ الْخَنَّاسِ"), (2, 6, "إِنَّ مَن يَقُولُ مِن مَّالٍ"), (2, 21, "يَٰأَيُّهَا جَآءَ"), (5, 1, None)]
SCHEMA = "chapter int, verse int, text string"
BY = ["chapter", "verse"]


def test_the_book_has_every_rule_once(spark):
    names = [r[0] for r in R.RULES]
    assert len(names) == len(set(names)) == 56 and R.rulebook(spark).count() == 56
    made = {w[3] for w in recitation.WORDS} | {p[2] for p in recitation.PHRASES} | {i[1] for i in recitation.INSIDE} | set(R.BOOK_NAMES.values())
    assert made <= set(names)


def test_letters_segments_and_targets(spark):
    verses = spark.createDataFrame(VERSES, SCHEMA)
    rules = R.all_rules(verses, BY, "chapter", "verse", "text").persist()
    assert {r.rule for r in rules.collect()} <= {r[0] for r in R.RULES}
    shown = {(r.chapter, r.word, r["index"]): r.rules for r in R.rules_at(rules, BY).collect()}
    order = {r[0]: k for k, r in enumerate(R.RULES)}
    assert all(x == sorted(set(x), key=order.__getitem__) for x in shown.values()) and shown[114, 3, 2] == ["tafkhim_letter"]

    rows = R.segments(verses, rules, BY, "text").collect()
    own = {(r.chapter, r.verse, r.word): r.segments for r in rows}
    texts = {(r.chapter, r.verse): r.text for r in verses.collect()}
    for (chapter, verse), text in texts.items():
        words = (text or "").split()
        assert ["".join(s.text for s in own[chapter, verse, k]) for k in range(len(words))] == words
    assert all(a.rules != b.rules for r in rows for a, b in zip(r.segments, r.segments[1:]))
    # The letters of Allah from the lam on are one piece, with all their rules.
    assert [s.text for s in own[1, 2, 1]][-1].endswith("لَّهِ") and "lam_tarqiq" in own[1, 2, 1][-1].rules
    words = R.tagged_words(verses, rules, BY, "text")
    got = {(r.chapter, r.verse, r.word): (r.spoken, r.tags) for r in words.collect()}
    assert got[114, 4, 0] == ("من", ["n_ikhfa"]) and got[114, 4, 3] == ("الخناس", ["n_ghunna"]) and got[2, 6, 0] == ("ان", ["n_ghunna"])
    targets = {(r.chapter, r.verse): r.target for r in R.tagged_targets(words, BY).collect()}
    assert targets[114, 4] == "من<n_ikhfa> شر الوسواس الخناس<n_ghunna>" and targets[2, 21] == "يا ايها جاء<mad>" and (5, 1) not in targets
    # A nun that merges into mim is heard as the doubled mim.
    assert targets[2, 6].split()[-2:] == ["من", "مال<m_ghunna>"] and targets[2, 6].split()[1] == "من<idgham_ghunna>"


def test_labels(spark):
    verses = spark.createDataFrame(VERSES, SCHEMA)
    clips = [("r", "same", 114, 4, "مِنْ شَرِّ الْوَسْوَاسِ الْخَنَّاسِ", None, 1), ("r", "plain", 114, 4, VERSES[1][2], True, 1), ("r", "part", 114, 4, "مِنْ شَرِّ", False, 1), ("r", "two", 114, 4, VERSES[1][2], False, 2), ("r", "none", 114, 4, None, None, 1), ("r", "far", 9, 9, "مِنْ شَرِّ", None, None)]
    rows = R.labels(verses, spark.createDataFrame(clips, "reader string, path string, chapter int, verse int, text string, plain boolean, n_verses int")).collect()
    own = {r.path: r.text for r in rows if r.path}
    assert own == {"plain": "من شر الوسواس الخناس", "part": "من<n_ikhfa> شر", "two": "من<n_ikhfa> شر الوسواس الخناس<n_ghunna>", "far": "من<n_ikhfa> شر"}
    assert {(r.chapter, r.verse) for r in rows if not r.path} == {(1, 2), (114, 4), (2, 6), (2, 21)}
