"""Vowelled Arabic letters as Latin sounds: a transducer whose rules see both sides, and what it is not sure of.

A word is a row of letters with marks.  Rules are tried in order at each letter; the first
that fits says what the sounds so far become.  What spelling alone cannot tell is noted.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F, types as T

# Sounds of letters, of vowels in the order in which they are looked for, letters that take the article's place, and names of opening letters.
CONSONANTS = {
    "ء": "ʾ", "أ": "ʾ", "إ": "ʾ", "ؤ": "ʾ", "ئ": "ʾ", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "ḥ", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh",
    "ص": "ṣ", "ض": "ḍ", "ط": "ṭ", "ظ": "ẓ", "ع": "ʿ", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ة": "t",
}
VOWELS = {"َ": "a", "ِ": "i", "ُ": "u", "ً": "an", "ٍ": "in", "ٌ": "un"}
SUN = "تثدذرزسشصضطظلن"
NAMES = {"ا": "alif", "ل": "lām", "م": "mīm", "ر": "rā", "ك": "kāf", "ه": "hā", "ي": "yā", "ع": "ʿayn", "ص": "ṣād", "ط": "ṭā", "س": "sīn", "ح": "ḥā", "ق": "qāf", "ن": "nūn"}
OPENINGS = {"الم", "الر", "المر", "كهيعص", "طه", "طسم", "طس", "يس", "ص", "حم", "عسق", "ق", "ن"}
SHADDA, SUKUN, MADDAH, DAGGER, JOINING_DOT, TATWEEL = "ّ", "ْ", "ٓ", "ٰ", "۬", "ـ"
OPEN_TANWIN = str.maketrans("ٖٗٞ", "ًٌٍ")
KNOWN_MARKS = re.compile("[ً-ٰٕ۪ۖ۟ۢ۬]")
SMALL = {"ۥ": "و", "ۦ": "ي"}
UNKNOWN = "⟨?⟩"
#: Signs in a word that spelling does not settle, and what is noted of them.
SIGNS = (("[ًٌٍۭۢ]", "nun or tanwin"), ("[ۤٓ]", "length of a madd"), ("[۪۫]", "sign of this script"))


class Letter(NamedTuple):
    base: str
    marks: str

    @property
    def vowel(self) -> str:
        return next((v for m, v in VOWELS.items() if m in self.marks), "")


class Place(NamedTuple):
    """A letter in its word: what stands beside it, what has been said, and how the word is said."""

    letter: Letter
    before: Letter | None
    after: Letter | None
    behind_article: bool
    second_last: bool
    said: str
    joined: bool
    pause: bool

    @property
    def base(self) -> str:
        return self.letter.base

    @property
    def vowel(self) -> str:
        return "ā" if MADDAH in self.letter.marks and self.base in "أإؤئء" and not self.letter.vowel else self.letter.vowel

    def has(self, mark: str) -> bool:
        return mark in self.letter.marks


def letters_of(word: str, notes: set[str]) -> list[Letter]:
    out: list[Letter] = []
    for c in unicodedata.normalize("NFC", word.replace("ا" + MADDAH, "ا").translate(OPEN_TANWIN)):
        if unicodedata.category(c)[0] == "M":
            if not KNOWN_MARKS.match(c):
                notes.add("unknown mark")
            if out:
                out[-1] = Letter(out[-1].base, out[-1].marks + c)
        elif c in SMALL:
            notes.add("small waw or yeh")
            out.append(Letter(SMALL[c], ""))
        elif c in CONSONANTS or c in "اٱآىے":
            out.append(Letter("ي" if c == "ے" else c, ""))
        elif c != TATWEEL and not re.match(r"[\s\d٠-٩۝۞]", c):
            notes.add("unknown character")
    return out


def _alif(p: Place) -> bool:
    return p.base in ("ا", "ٱ")


def _long(p: Place, letter: str, short: str) -> bool:
    return p.base == letter and not p.letter.vowel and not p.has(SHADDA) and p.said.endswith(short)


def _consonant(p: Place) -> tuple[str, str | None]:
    """The letter's own sound and vowel, as they are at a pause or within speech."""
    sound, vowel, last = CONSONANTS.get(p.base, UNKNOWN), p.vowel, p.after is None
    if p.has(SHADDA) and not (p.behind_article and p.base in SUN):
        sound += sound
    if p.has(DAGGER):
        vowel = "ā"
    if p.pause and last:
        sound, vowel = ("h", "") if p.base == "ة" else (sound, {"an": "ā", "ā": "ā"}.get(vowel, ""))
    if p.pause and p.second_last and vowel == "an" and p.after.base == "ا":
        vowel = "ā"
    bare = not vowel and not p.has(SUKUN) and not p.has(SHADDA) and not (p.pause and last) and p.base not in "وي"
    return p.said + sound + vowel, "unvowelled consonant" if bare else None


#: (name, where it fits, what is said from there on and what is noted), tried in order.
RULES = (
    ("hamza with a long a", lambda p: p.base == "آ", lambda p: (p.said + "ʾā", None)),
    ("spelling alif", lambda p: _alif(p) and p.before is not None and ("ً" in p.before.marks or (p.after is None and p.before.base == "و" and SUKUN in p.before.marks)), lambda p: (p.said, None)),
    ("joined alif", lambda p: _alif(p) and p.before is None and p.joined and (p.base == "ٱ" or p.has(JOINING_DOT) or not p.letter.vowel), lambda p: (p.said, None)),
    ("first alif", lambda p: _alif(p) and p.before is None, lambda p: (p.said + (p.vowel or UNKNOWN), None if p.vowel else "vowel of the first alif")),
    ("alif of a long a", lambda p: _alif(p) and p.said.endswith("a"), lambda p: (p.said[:-1] + "ā", None)),
    ("alif that bears tanwin", lambda p: _alif(p) and p.vowel == "an" and p.after is None, lambda p: (p.said + ("ā" if p.pause else "an"), None)),
    ("alif with a vowel", lambda p: _alif(p) and p.vowel != "", lambda p: (p.said + "ʾ" + p.vowel, "alif within a word")),
    ("alif that may be silent", _alif, lambda p: (p.said, "silent or long alif")),
    ("alif maqsura", lambda p: p.base == "ى", lambda p: (p.said.removesuffix("a") + ("an" if p.has("ً") and not p.pause else "ā"), None)),
    ("long u", lambda p: _long(p, "و", "u"), lambda p: (p.said[:-1] + "ū", None)),
    ("long i", lambda p: _long(p, "ي", "i"), lambda p: (p.said[:-1] + "ī", None)),
    ("consonant", lambda p: True, _consonant),
)


def _fixed(letters: list[Letter], joined: bool, pause: bool, notes: set[str]) -> str | None:
    """Words that are not said as they are spelled: opening letters, an imperative, the relative pronoun, Allah."""
    bare = "".join(x.base for x in letters)
    names = bare.translate(str.maketrans("أإٱ", "ااا"))
    if names in OPENINGS:
        notes.add("names of letters")
        return " ".join(NAMES[c] for c in names)
    if bare == "اهدنا":
        return "hdinā" if joined else "ihdinā"
    if m := re.fullmatch("([وفبك]?)الذي(ن?)", bare):
        lead = CONSONANTS[m[1]] + ("i" if m[1] == "ب" else "a") if m[1] else "" if joined else "a"
        return lead + "lladhī" + ("" if not m[2] else "n" if pause else "na")
    if m := re.fullmatch("(ل|ا|[وفبك]ا)ل(?:ل)?ه", bare):
        if bare not in ("لله", "الله") and not re.fullmatch("[وفبك]الله", bare):
            return None
        end = "" if pause else letters[-1].vowel
        lead = "li" if bare == "لله" else ("" if joined else "a") if bare == "الله" else CONSONANTS[letters[0].base] + letters[0].vowel
        return lead + "llāh" + end
    return None


def said_word(word: str, joined: bool, pause: bool, notes: set[str]) -> str:
    letters = letters_of(word, notes)
    if not letters:
        return ""
    notes.update(note for sign, note in SIGNS if re.search(sign, word))
    fixed = _fixed(letters, joined, pause, notes)
    if fixed is not None:
        return fixed
    if re.search("ه[ُِ]?م", re.sub(f"[{SHADDA}{SUKUN}]", "", word)):
        notes.add("mim of the plural")
    bases, said, start = [x.base for x in letters], "", 0
    lead = 1 if bases[0] in "وفبك" else 0
    if len(bases) > lead + 1 and bases[lead] in "اٱ" and bases[lead + 1] == "ل":
        start = lead + 2
        said = CONSONANTS[bases[0]] + letters[0].vowel if lead else "" if joined else "a"
        said += (CONSONANTS[bases[start]] if start < len(bases) and bases[start] in SUN else "l") + "-"
    for i in range(start, len(letters)):
        beside = [letters[k] if 0 <= k < len(letters) else None for k in (i - 1, i + 1)]
        place = Place(letters[i], *beside, start > 0 and i == start, i == len(letters) - 2, said, joined, pause)
        said, note = next(say for _, fits, say in RULES if fits(place))(place)
        if note:
            notes.add(note)
    return said


def sounds(text: str | None, pause: bool = True) -> dict:
    """{text, words, notes}: words joined in speech; with `pause` the last one is said as at a stop.

    Digits and signs of verses go.  A null text has no words.
    """
    words, notes = re.sub("[٠-٩\\d۝۞]+", "", text or "").split(), set()
    said = [said_word(w, i > 0, pause and i == len(words) - 1, notes) for i, w in enumerate(words)]
    return {"text": " ".join(said), "words": said, "notes": sorted(notes)}


_SAID = T.StructType([T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("notes", T.ArrayType(T.StringType()))])
#: Characters whose words are Python's strings at once; what has been said is kept in Arrow's form, a few bytes a sound.
AT_ONCE = 100_000


@F.arrow_udf(_SAID)
def sounds_of(text: pa.Array) -> pa.Array:
    kind = pa.struct([("text", pa.string()), ("words", pa.list_(pa.string())), ("notes", pa.list_(pa.string()))])
    parts, held, size = [], [], 0
    for t in text:
        held.append(sounds(t.as_py()))
        size += len(held[-1]["text"])
        if size >= AT_ONCE:
            parts.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])
