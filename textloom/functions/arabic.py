"""Normal forms of vowelled Arabic text as column expressions.

Spark's regular expressions look ahead and behind, so each form is a chain of
replacements inside whole-stage code.  Only Unicode composition needs Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Character classes of the script, and the spellings below.
CONTROLS = r"[​-‏‪-‮⁦-⁩﻿ ]"
DIGITS = r"[٠-٩۰-۹\d]"
STOPS = r"[ۖ-ۯࣰ-ࣳ]"
LETTERS = r"ء-ي"
VOWELS = r"ً-ٟ"
DAGGER, FATHA, TATWEEL = "ٰ", "َ", "ـ"
#: Words that are written without the alif that their dagger stands for: expanded and usual spelling.
SHORT_SPELLINGS = (
    ("الرحمان", "الرحمن"), ("هاذا", "هذا"), ("هاذه", "هذه"), ("هاؤلاء", "هؤلاء"), ("هاذان", "هذان"), ("ذالك", "ذلك"),
    ("ذالكم", "ذلكم"), ("لاكن", "لكن"), ("إلاه", "إله"), ("اللاه", "الله"), ("طاها", "طه"), ("ياس", "يس"),
)
#: All of these at once: each is its usual spelling with one or two alifs more, and all are whole words.
SHORT_WORDS = "|".join((
    "(الرحم)ا(ن)", "(ه)ا(ذان|ذا|ذه|ؤلاء)", "(ذ)ا(لكم|لك)", "(ل)ا(كن)", "(إل)ا(ه)", "(الل)ا(ه)", "(ط)ا(ه)ا", "(ي)ا(س)",
))
#: Endings before which a dagger on yeh is an alif.
ENDINGS = "ها|هما|هم|هن|ه|كما|كم|كن|ك|نا"
#: Version names of the normal forms.
FIRST, CURRENT = "asr-v1", "asr-v2"


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    """Fixed strings one after the other: a search of bytes, where a pattern costs a string and a matcher a text."""
    for found, to in steps:
        text = F.replace(text, F.lit(found), F.lit(to))
    return text


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Characters whose forms are Python's strings at once; what has been made is kept in Arrow's form.
AT_ONCE = 100_000


def _each(texts: pa.Array, form) -> pa.Array:
    """`form` of each text; null stays null."""
    parts, held, size = [], [], 0
    for t in texts:
        held.append(form(t.as_py()) if t.is_valid else None)
        size += len(held[-1] or "")
        if size >= AT_ONCE:
            parts.append(pa.array(held, pa.string()))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, pa.string())])


@lru_cache(maxsize=100_000)
def _composed(word: str) -> str:
    return unicodedata.normalize("NFC", word)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed word by word: nothing joins a space, and words come again."""
    return _each(text, lambda t: " ".join(map(_composed, t.split(" "))))


def _key(text: str) -> str:
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    for c in set(text):
        if c == TATWEEL or unicodedata.category(c) == "Mn":
            text = text.replace(c, "")
    return text


@F.arrow_udf(StringType())
def word_key(text: pa.Array) -> pa.Array:
    """Decomposed, without combining marks and lengthening strokes."""
    return _each(text, _key)


def strip_harakat(text: Column) -> Column:
    return F.regexp_replace(text, r"[ؐ-ًؚ-ٟ]", "")


def compose_hamza(text: Column) -> Column:
    """Hamza as a combining mark joined to its carrier: yeh, waw, alif, or a stroke."""
    text = _replaced(text, ("ئ", "ئ"), ("ىٔ", "ئ"), ("ۓ", "ئ"), ("ؤ", "ؤ"), ("أ", "أ"), ("إ", "إ"))
    return _chain(text, (TATWEEL + r"[ً-ْ]*" + "ٔ", "أ"), (TATWEEL + r"[ً-ْ]*" + "ٕ", "إ"))


def fold_carriers(text: Column) -> Column:
    """Carriers of hamza as bare letters."""
    return F.translate(text, "أإآؤئ", "اااوي")


def without_hamza(text: Column) -> Column:
    """Hamza on yeh and waw as bare letters, a hamza by itself dropped."""
    return F.translate(text, "ئؤء", "يو")


def skeleton(word: Column, empty: str = "") -> Column:
    """A word without alifs and hamza, final forms folded, repeats squeezed; `empty` stands for nothing left."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(word, "[ءاأإآ]", ""), "ىة", "يه"), r"(.)\1+", "$1")
    return F.when(bare == "", empty).otherwise(bare) if empty else bare


def coarse(word: Column) -> Column:
    """Letters only, seats folded; a dagger is an alif, a small high yeh a yeh."""
    shown = F.translate(F.regexp_replace(word, TATWEEL + DAGGER, "ا"), DAGGER + "ۧ", "اي")
    return F.translate(F.regexp_replace(shown, r"[^ء-غف-يٱےۓ]", ""), "ٱأإآىےۓةؤئء", "اااايييهوي")


def bare_letters(word: Column) -> Column:
    """Letters only, carriers of alif, yeh and waw folded."""
    return F.translate(F.regexp_replace(word, r"[^ء-غف-يٱےۓ]", ""), "ٱآأإےۓئؤ", "اااايييو")


def display_form(text: Column) -> Column:
    """Unvowelled text for display: marks and digits dropped, daggers as alifs where they are heard so."""
    plain = compose_hamza(_chain(text, (CONTROLS, " "), (r"[٠-٩\d]+", "")))
    plain = F.translate(plain, "ٱےیکۥۦۨ۬", "اييك")
    plain = strip_harakat(_chain(plain, (r"[ۖ-ۯ]", ""), (TATWEEL, "")))
    plain = _chain(plain, ("ى" + DAGGER, "ى"), (f"ي{DAGGER}(?=(?:{ENDINGS})(?!\\S))", "ا"), ("ي" + DAGGER, "يا"), (DAGGER, "ا"))
    return _collapse(plain)


def asr_form_v1(text: Column) -> Column:
    """Unvowelled text for recognisers, the first version."""
    plain = compose_hamza(F.regexp_replace(text, f"{DIGITS}+", ""))  # controls go at the end, with all that is no letter
    plain = _chain(F.translate(plain, "ےیک", "ييك"), (f"[{STOPS[1:-1]}ؐ-ًؚ-ٟٴ{TATWEEL}]+", ""))
    # What is left of daggers on a final seat has no letter behind it.
    plain = _replaced(_chain(plain, (f"[يى]{DAGGER}(?=[{LETTERS}])", "ا")), ("ى" + DAGGER, "ى"), (f"و{DAGGER}ة", "اة"), (DAGGER, "ا"))
    run = LETTERS + r"ٱ"
    plain = _chain(plain, (f"(?=[اهذلإطي])(?<![{run}])(?:{SHORT_WORDS})(?![{run}])", "".join(f"${k}" for k in range(1, 17))))
    return F.trim(_chain(plain, ("[إأآٱ]", "ا"), (r"[^ء-غف-ي]+", " ")))


def asr_form(text: Column) -> Column:
    """Unvowelled text for recognisers, the current version: a heard yeh keeps its place, a vocative is a word."""
    marks = f"[{VOWELS}]*"
    spoken = _chain(
        text,
        (r"(?=[وفي])(?<![ء-ٱۖ-ۯ])((?:[وف]" + marks + f")?)ي{FATHA}{DAGGER}{marks}", "$1يا "),
        (f"ي([{VOWELS}]*{FATHA}[{VOWELS}]*){DAGGER}", "ي$1ا"),
        (f"(?=ء)(?<![{LETTERS}{VOWELS}])ء{marks}ا", "ا"),
    )
    return F.regexp_replace(asr_form_v1(spoken), f"(?=ء)(?<![{LETTERS}])ء(?=ا)", "")


def form_for(version: Column, text: Column) -> Column:
    """The form that a row's version names (null: the first); an unknown version is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown version of the normal form: "), version)).cast("string")
    return F.when(version.isNull() | (version == FIRST), asr_form_v1(text)).when(version == CURRENT, asr_form(text)).otherwise(unknown)


def vowelled_form(text: Column) -> Column:
    """Text with the vowels that are written, without other signs."""
    plain = compose_hamza(F.regexp_replace(text, f"{DIGITS}+", ""))
    plain = _chain(F.translate(plain, "ےیک" + TATWEEL, "ييك"), (f"{STOPS}+", ""), (r"[^ء-غف-ٰٟٱ]+", " "))
    return nfc(F.trim(plain))


def recital_form(text: Column) -> Column:
    """Another bare form: carriers folded, all but word characters dropped."""
    plain = _chain(text, (r"[ً-ْٰ]", ""), (r"[ۖ-ۭ]", ""), ("[إأآٱ]", "ا"), ("ئ", "ي"), ("ؤ", "و"), (r"(?U)[^\w\s]", ""))
    return _collapse(plain)


def alif_forms(word: Column, most: int = 4) -> Column:
    """All spellings of a word by the carriers of its alifs; the word alone if it has more than `most` of them."""
    carriers = F.array(*map(F.lit, "اأإآ"))
    spread = F.aggregate(
        F.split(word, ""),
        F.array(F.lit("")),
        lambda got, c: F.flatten(F.transform(got, lambda g: F.transform(F.when(c == "ا", carriers).otherwise(F.array(c)), lambda x: F.concat(g, x)))),
    )
    return F.when(F.char_length(F.regexp_replace(word, "[^ا]", "")) > most, F.array(word)).otherwise(spread)


def letter_shapes(letter: Column, joins_after: Column) -> Column:
    """struct<isolated, initial, medial, final>: a letter with zero-width joiners on the sides that join."""
    zwj = F.lit("‍")
    return F.struct(
        letter.alias("isolated"), F.when(joins_after, F.concat(letter, zwj)).otherwise(letter).alias("initial"),
        F.when(joins_after, F.concat(zwj, letter, zwj)).otherwise(F.concat(zwj, letter)).alias("medial"), F.concat(zwj, letter).alias("final"),
    )


def syllable(translit: Column, vowel: Column) -> Column:
    """A consonant's Latin name with a vowel; a letter without sound is a glottal stop."""
    base = F.regexp_replace(F.split(translit, " ")[0], "ā", "")
    return F.concat(F.when(base == "", "ʾ").otherwise(base), vowel)
