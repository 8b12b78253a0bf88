"""Normal forms of Arabic text, over documents spelled in Arabic letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import arabic as A, sounds
from textloom.plans.base import Plans, read, spread

plans = Plans()

#: A letter or mark for each of a-z, so that texts of the tables exercise all rules.
LATIN, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ابءدَفٰهيىكلمنوةأرستُـٱٔیۥ"
SPELLED = f"a AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{SCRIPT}') AS t FROM documents)"
WORDS = f"{SPELLED}, w AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[ء-ٱ]+')) AS word FROM a)"


def _spelled(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.translate(F.lower("text"), LATIN, SCRIPT).alias("t"))


def _words(spark, sf):
    return _spelled(spark, sf).select(F.explode(F.regexp_extract_all("t", F.lit("[ء-ٱ]+"), F.lit(0))).alias("word")).distinct()


def sql_chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


# The same rules for an engine whose expressions do not look around: neighbours are captured and put back.
L, V, D, FA = "ء-ي", "ً-ٟ", "ٰ", "َ"
CONTROLS = "[​-‏‪-‮⁦-⁩﻿ ]"
HAMZA = (("[يىے]ٔ", "ئ"), ("ؤ", "ؤ"), ("أ", "أ"), ("إ", "إ"), ("ـ[ً-ْ]*ٔ", "أ"), ("ـ[ً-ْ]*ٕ", "إ"))
DIGITS, STOPS = "[٠-٩۰-۹0-9]", "[ۖ-ۯࣰ-ࣳ]"
END = (r"\s+", " "), ("^ | $", "")


def sql_v1(x: str) -> str:
    x = sql_chain(x, (CONTROLS, " "), (DIGITS, ""), *HAMZA)
    x = sql_chain(f"translate({x}, 'ےیک', 'ييك')", (STOPS, ""), ("[ؐ-ًؚ-ٟٴ]", ""), ("ـ", ""))
    seat = (f"[يى]{D}([{L}])", r"ا\1")
    x = sql_chain(x, seat, seat, ("ى" + D, "ى"), (f"و{D}ة", "اة"), (D, "ا"))
    run = f"{L}ٱ"
    for long, short in A.SHORT_SPELLINGS:
        x = sql_chain(x, *[(f"(^|[^{run}]){long}([^{run}]|$)", rf"\1{short}\2")] * 2)
    return sql_chain(x, ("[إأآٱ]", "ا"), (r"[^ء-غف-ي\s]", " "), *END)


def sql_current(x: str) -> str:
    x = sql_chain(x, (f"(^|[^ء-ٱۖ-ۯ])((?:[وف][{V}]*)?)ي{FA}{D}[{V}]*", r"\1\2يا "), (f"ي([{V}]*{FA}[{V}]*){D}", r"ي\1ا"), (f"(^|[^{L}{V}])ء[{V}]*ا", r"\1ا"))
    return sql_chain(sql_v1(x), (f"(^|[^{L}])ءا", r"\1ا"))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256(regexp_replace(t, '[ؐ-ًؚ-ٟ]', '', 'g')) AS form FROM a")
def t1_strip_harakat(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.strip_harakat(F.col("t")), 256).alias("form"))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({sql_chain('t', *HAMZA)}) AS form FROM a")
def t2_compose_hamza(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.compose_hamza(F.col("t")), 256).alias("form"))


DISPLAY = sql_chain(f"translate({sql_chain('t', (CONTROLS, ' '), ('[٠-٩0-9]+', ''), *HAMZA)}, 'ٱےیکۥۦۨ۬', 'اييك')", ("[ۖ-ۯ]", ""), ("ـ", ""), ("[ؐ-ًؚ-ٟ]", ""), ("ى" + D, "ى"), (f"ي{D}({A.ENDINGS})(\\s|$)", r"ا\1\2"), ("ي" + D, "يا"), (D, "ا"), *END)


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({DISPLAY}) AS form FROM a")
def t3_display_form(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.display_form(F.col("t")), 256).alias("form"))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({sql_v1('t')}) AS form FROM a")
def t4_asr_form_v1(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.asr_form_v1(F.col("t")), 256).alias("form"))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({sql_current('t')}) AS form FROM a")
def t5_asr_form(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.asr_form(F.col("t")), 256).alias("form"))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256(CASE WHEN doc_id % 3 < 2 THEN {sql_v1('t')} ELSE {sql_current('t')} END) AS form FROM a")
def t6_form_by_version(spark, sf):
    version = F.when(F.col("doc_id") % 3 == 1, A.FIRST).when(F.col("doc_id") % 3 == 2, A.CURRENT)
    return _spelled(spark, sf).select("doc_id", F.sha2(A.form_for(version, F.col("t")), 256).alias("form"))


VOWELLED = sql_chain(f"translate({sql_chain('t', (CONTROLS, ' '), (DIGITS, ''), *HAMZA)}, 'ےیکـ', 'ييك')", (STOPS, ""), ("[^ء-غف-ٰٟٱ\\s]", " "))


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({sql_chain(f'nfc_normalize({VOWELLED})', *END)}) AS form FROM a")
def t7_vowelled_form(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.vowelled_form(F.col("t")), 256).alias("form"))


@plans.add(f"WITH {WORDS} SELECT word, translate(word, 'أإآؤئ', 'اااوي') AS folded, translate(word, 'ئؤء', 'يو') AS bare FROM w")
def t8_folded_carriers(spark, sf):
    w = F.col("word")
    return _words(spark, sf).select("word", A.fold_carriers(w).alias("folded"), A.without_hamza(w).alias("bare"))


SQUEEZED = "list_reduce(list_prepend('', string_split(b, '')), lambda s, c: CASE WHEN right(s, 1) = c THEN s ELSE s || c END)"


@plans.add(f"WITH {WORDS}, b AS (SELECT word, translate(regexp_replace(word, '[ءاأإآ]', '', 'g'), 'ىة', 'يه') AS b FROM w), s AS (SELECT word, CASE WHEN b = '' THEN '' ELSE {SQUEEZED} END AS skeleton FROM b) SELECT word, skeleton, CASE WHEN skeleton = '' THEN 'ا' ELSE skeleton END AS filled FROM s")
def t9_skeleton(spark, sf):
    return _words(spark, sf).select("word", A.skeleton(F.col("word")).alias("skeleton"), A.skeleton(F.col("word"), "ا").alias("filled"))


KEPT = "[^ء-غف-يٱےۓ]"


@plans.add(f"WITH {WORDS} SELECT word, translate(regexp_replace(translate(replace(word, 'ـ{D}', 'ا'), '{D}ۧ', 'اي'), '{KEPT}', '', 'g'), 'ٱأإآىےۓةؤئء', 'اااايييهوي') AS coarse, translate(regexp_replace(word, '{KEPT}', '', 'g'), 'ٱآأإےۓئؤ', 'اااايييو') AS bare FROM w")
def t10_letter_skeletons(spark, sf):
    return _words(spark, sf).select("word", A.coarse(F.col("word")).alias("coarse"), A.bare_letters(F.col("word")).alias("bare"))


@plans.add("SELECT doc_id, sha256(replace(strip_accents(text), 'ـ', '')) AS form FROM documents")
def t11_word_key(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(A.word_key(F.col("text")), 256).alias("form"))


RECITAL = sql_chain("t", ("[ً-ْٰ]", ""), ("[ۖ-ۭ]", ""), ("[إأآٱ]", "ا"), ("ئ", "ي"), ("ؤ", "و"), (r"[^\p{L}\p{M}\p{N}_\s]", ""), *END)


@plans.add(f"WITH {SPELLED} SELECT doc_id, sha256({RECITAL}) AS form FROM a")
def t27_recital_form(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.sha2(A.recital_form(F.col("t")), 256).alias("form"))


@plans.add(f"""WITH RECURSIVE {WORDS}, s AS (SELECT word FROM w WHERE length(regexp_replace(word, '[^ا]', '', 'g')) <= 4),
r AS (SELECT word, 0 AS i, '' AS form FROM s UNION ALL SELECT word, i + 1, form || c FROM (SELECT word, i, form, unnest(CASE WHEN substr(word, i + 1, 1) = 'ا' THEN ['ا', 'أ', 'إ', 'آ'] ELSE [substr(word, i + 1, 1)] END) AS c FROM r WHERE i < length(word)))
SELECT word, form FROM r WHERE i = length(word)""")
def t28_alif_forms(spark, sf):
    w = _words(spark, sf).filter("char_length(regexp_replace(word, '[^ا]', '')) <= 4")
    return w.select("word", F.explode(A.alif_forms(F.col("word"))).alias("form"))


@plans.add("""WITH n AS (SELECT n_nationkey, lower(n_name) AS l, n_nationkey % 3 > 0 AS joins FROM nation)
SELECT n_nationkey, l AS isolated, CASE WHEN joins THEN l || chr(8205) ELSE l END AS initial, chr(8205) || l || CASE WHEN joins THEN chr(8205) ELSE '' END AS medial, chr(8205) || l AS final,
CASE WHEN replace(string_split(l, ' ')[1], 'a', '') = '' THEN 'ʾ' ELSE string_split(l, ' ')[1] END || 'i' AS syllable FROM n""")
def t29_shapes_and_syllables(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("l"), (F.col("n_nationkey") % 3 > 0).alias("joins"))
    return n.select("n_nationkey", A.letter_shapes(F.col("l"), F.col("joins")).alias("s"), A.syllable(F.col("l"), F.lit("i")).alias("syllable")).select("n_nationkey", "s.*", "syllable")


@plans.add(f"""WITH {WORDS} SELECT word, trim(regexp_replace(regexp_replace(word, '[ؐ-ًؚ-ْٰۖ-ۭ]', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM w""")
def t26_plain_words(spark, sf):
    return _words(spark, sf).select("word", F.trim(F.regexp_replace(F.regexp_replace("word", "[ؐ-ًؚ-ْٰۖ-ۭ]", ""), r"\s+", " ")).alias("plain"))


@plans.add()
def t25_letters_to_sounds(spark, sf):
    """Documents, spelled in Arabic letters and marks, as Latin sounds, and what spelling does not settle."""
    said = _spelled(spark, sf).select("doc_id", sounds.sounds_of("t").alias("s"))
    return said.select("doc_id", F.size("s.words").alias("n_words"), F.sha2("s.text", 256).alias("said"), F.array_join("s.notes", ",").alias("notes"))
