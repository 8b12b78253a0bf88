"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Combining marks of Arabic script that a bare form does not hold, and carriers of hamza.
HARAKAT = "[ؐ-ًؚ-ٟ]"
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
HAMZA_FROM, HAMZA_TO = "أإآٱؤئ", "اااا" + "وي"


def tokens(text: Column, tag: str | None = None) -> Column:
    """Words between white space; with `tag`, a pattern, what it matches is cut first."""
    text = F.regexp_replace(text, tag, " ") if tag else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def strip_harakat(text: Column) -> Column:
    return F.regexp_replace(text, HARAKAT, "")


def strip_marks(text: Column) -> Column:
    """Without vowel marks, small high signs and lengthening strokes; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKS, ""), r"\s+", " "))


def fold_hamza(text: Column) -> Column:
    """Carriers of hamza as their bare letters, final yeh and teh marbuta folded."""
    return F.translate(F.translate(text, HAMZA_FROM, HAMZA_TO), "ىة", "يه")


def skeleton(text: Column, drop: str = "[aeiouAEIOUاء]") -> Column:
    """Letters without those that `drop` matches, and repeats squeezed: a key that spelling hardly changes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), drop, ""), r"(.)\1+", "$1")


def fold_latin(text: Column) -> Column:
    """Lower case, common Latin accents dropped."""
    return F.translate(F.lower(text), "àâäáãçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaceeeeiiiinooooouuuuyy")


def bigrams(text: Column) -> Column:
    """The set of neighbouring character pairs."""
    return F.array_distinct(F.when(F.char_length(text) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams by all bigrams of two texts' sets; 1 for equal texts, 0 if neither has a pair."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def rhyme(a: Column, b: Column) -> Column:
    """1 for two equal last characters, 0.5 for one, else 0."""
    return F.when(F.right(a, F.lit(2)) == F.right(b, F.lit(2)), 1.0).when(F.right(a, F.lit(1)) == F.right(b, F.lit(1)), 0.5).otherwise(0.0)


def length_likeness(a: Column, b: Column) -> Column:
    return F.least(F.char_length(a), F.char_length(b)) / F.nullif(F.greatest(F.char_length(a), F.char_length(b)), F.lit(0))


def closeness(a: Column, b: Column, cosine: Column | None = None) -> Column:
    """Blend of vectors, bigrams, rhyme and length; without vectors the other three."""
    if cosine is None:
        return 0.70 * dice(a, b) + 0.20 * rhyme(a, b) + 0.10 * length_likeness(a, b)
    return 0.55 * cosine + 0.20 * dice(a, b) + 0.15 * rhyme(a, b) + 0.10 * length_likeness(a, b)


def phrase_present(words: Column, phrase: Column) -> Column:
    """Whether an array of words has another as neighbours, in order."""
    pad = lambda x: F.concat(F.lit("\x00"), F.array_join(x, "\x00"), F.lit("\x00"))
    return (F.size(phrase) == 0) | F.contains(pad(words), pad(phrase))


def first_place(words: Column, phrase: Column) -> Column:
    """Where an array first has another, from 0; null if nowhere."""
    n = F.size(phrase)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(words, i + 1, n) == phrase), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading items two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    miss = F.array_position(same, False)
    return F.when(miss > 0, miss - 1).otherwise(F.size(same)).cast("int")


def outside(text: Column, alphabet: str) -> Column:
    """The characters of a text that are not of `alphabet` (a regular expression's class)."""
    return F.regexp_replace(text, f"[{alphabet}]", "")


def key_of(*parts: tuple[Column, int]) -> Column:
    """Numbers as one zero-padded key."""
    return F.concat(*[F.lpad(c.cast("string"), n, "0") for c, n in parts])


def strip_tags(text: Column) -> Column:
    """Text without <tags>, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[a-z_]+>", " "), r"\s+", " "))


def tagged_words(text: Column) -> Column:
    """array<struct<word, tags>>: each tag belongs to the word that it is in or behind; tags before the first word are dropped."""
    inner = F.regexp_replace(F.regexp_replace(text, r"(\S)(<[a-z_]+>)(?=\S)", "$1$2"), r"\s+(?=<[a-z_]+>)", "")
    words = F.filter(F.split(F.trim(F.regexp_replace(inner, r"^(\s*<[a-z_]+>)+", "")), r"\s+"), lambda x: x != "")
    return F.transform(words, lambda w: F.struct(F.regexp_replace(w, "<[a-z_]+>", "").alias("word"), F.array_distinct(F.regexp_extract_all(w, F.lit("<([a-z_]+)>"), F.lit(1))).alias("tags")))


def has_cycle(ids: Column, cycles: int = 8, max_period: int = 4) -> Column:
    """Whether an array has some period of at most `max_period` repeated `cycles` times on end."""
    def period(p: int) -> Column:
        same = F.zip_with(F.slice(ids, F.lit(1 + p), F.greatest(F.size(ids) - p, F.lit(0))), ids, lambda x, y: F.when(x == y, "1").otherwise("0"))
        return F.contains(F.array_join(F.slice(same, F.lit(1), F.greatest(F.size(ids) - p, F.lit(0))), ""), F.lit("1" * (p * (cycles - 1))))

    out = F.lit(False)
    for p in range(1, max_period + 1):
        out = out | ((F.size(ids) >= p * cycles) & period(p))
    return out


def issues(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in checks]))
