"""Letters of many texts in arrays: the rules of `letters`, `recitation` and `rulebook`, without a row for each letter.

The same rules stand there as column expressions over windows, which is how they are to be
read.  Here a run of texts is one array of characters, neighbours are places in it, and
what is told of a run goes back to Spark: rules, pieces of words, or tags.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from textloom.functions.arabic import asr_form, compose_hamza
from textloom.operators import letters as L, recitation as R
from textloom.operators.rulebook import BOOK_NAMES, RULES

#: Bytes of texts that are letters at a time; a longer text is by itself.
RUN_BYTES = 400_000
OTHER, LETTER, MARK, SPACE = range(4)
NONE, A, U, I = range(4)  # vowels
WASL, WRITTEN, SHAMSI = 1, 2, 3  # silent letters, 0 for those that are heard
SILENT = {WASL: "silent_wasl", WRITTEN: "silent_letter", SHAMSI: "silent_shamsi"}
VOWELS = {"a": A, "u": U, "i": I}
#: Marks that rules ask for, a bit each.
BIT = {c: 1 << k for k, c in enumerate(dict.fromkeys("".join((L.FATHA, L.DAMMA, L.KASRA, L.SUKUN, L.SHADDA, *L.TANWIN.values(), L.IQLAB_MEEM, L.MADDAH, L.DAGGER, R.SMALL_WAW, R.SMALL_YEH, R.SMALL_HIGH_YEH, R.DOTS))))}
#: Where a rule stands in the book.
RANK = {r[0]: k for k, r in enumerate(RULES)}


def bits(chars: str) -> int:
    return sum(BIT[c] for c in chars)


def _is(a, chars: str):
    """Which letters (0 for none) are one of `chars`."""
    return _set(chars)[a] if len(chars) > 1 else a == ord(chars)


@lru_cache
def _set(chars: str) -> np.ndarray:
    """Letters lie below 0x800."""
    return _table(0x800, bool, ((c, True) for c in chars))


def _table(size: int, kind, pairs) -> np.ndarray:
    out = np.zeros(size, kind)
    for c, x in pairs:
        out[ord(c)] = x
    return out


@lru_cache
def _tables():
    """By character: its kind, its bit as a mark, the letter that it is, and the letter of a skeleton."""
    size = sys.maxunicode + 1
    kinds = np.zeros(size, np.uint8)
    extra = re.compile(L.MARK.replace(r"\p{Mn}", ""))
    kinds[[k for k in range(size) if unicodedata.category(chr(k)) == "Mn" or (k < 0x800 and extra.match(chr(k)))]] = MARK
    kinds[[k for k in range(0x800) if re.match(L.LETTER, chr(k))]] = LETTER
    kinds[[ord(c) for c in " \t\n\x0b\f\r"]] = SPACE
    own, bare = np.arange(size, dtype=np.uint32), np.arange(size, dtype=np.uint32)
    for table, chars, to in ((own, "أإؤئۓٱآے", "ءءءءءااي"), (bare, "ٱآأإےۓئؤ", "اااايييو")):
        for c, x in zip(chars, to, strict=True):
            table[ord(c)] = ord(x)
    return kinds, _table(size, np.int32, BIT.items()), own, bare


class Letters:
    """The letters of texts (an Arrow array of strings), one after the other, with the columns of `letters.letters`."""

    def __init__(self, texts):
        import pyarrow as pa

        kinds, bit, own, bare = _tables()
        n = len(texts)
        offsets, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32), texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets - offsets[0]]  # where texts begin, in characters
        self.raw = raw.tobytes()
        self.code = code = np.frombuffer(self.raw.decode().encode("utf-32-le"), np.uint32)
        self.texts, self.chars = n, chars
        kind = kinds[code]
        begins = np.zeros(len(code) + 1, bool)
        begins[chars] = True
        space = kind == SPACE
        token = np.cumsum(~space & (np.append(True, space[:-1]) | begins[:-1])) if len(code) else np.zeros(0, np.int64)
        self.at = at = np.flatnonzero(kind == LETTER)
        self.n = len(at)
        self.k = np.arange(self.n)
        self.token, self.token_of = token, token[at]
        new = np.diff(self.token_of, prepend=-1) != 0
        self.word = np.cumsum(new) - 1  # over all texts
        self.begin = np.flatnonzero(new)  # each word's first letter
        self.end = np.append(self.begin[1:], self.n)
        self.first, self.stop = self.begin[self.word], self.end[self.word]
        self.index = self.k - self.first
        self.text = np.searchsorted(chars, at, side="right") - 1
        self.text_of = self.text[self.begin]
        self.words_before = np.searchsorted(self.text_of, np.arange(n + 1))
        self.number = self.word - self.words_before[self.text]
        bounds = np.searchsorted(self.text, np.arange(n + 1))
        self.verse, self.verse_stop = bounds[self.text], bounds[self.text + 1]
        # A mark belongs to a letter if only marks lie between.
        marked = np.flatnonzero(kind == MARK)
        ahead = np.maximum.accumulate(np.where(kind != MARK, np.arange(len(code)), -1))[marked]
        text_of_mark = np.searchsorted(chars, marked, side="right") - 1
        held = (ahead >= 0) & (kind[ahead] == LETTER)
        held &= ahead >= chars[text_of_mark]
        marked, ahead = marked[held], ahead[held]
        of = np.searchsorted(at, ahead)
        self.marked, self.size = marked, 1 + np.bincount(of, minlength=self.n)
        self.marks = np.zeros(self.n, np.int32)
        if len(of):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            self.marks[of[starts]] = np.bitwise_or.reduceat(bit[code[marked]], starts)
        self.base = code[at]
        self.letter, self.bare_letter = own[self.base], bare[self.base]
        tanwin = np.select([self.has(L.TANWIN[v]) for v in "aui"], [A, U, I], NONE).astype(np.int8)
        self.tanwin = tanwin
        self.vowel = np.select([self.has(L.FATHA) | (tanwin == A), self.has(L.DAMMA) | (tanwin == U), self.has(L.KASRA) | (tanwin == I)], [A, U, I], NONE).astype(np.int8)
        self.sukun, self.shadda = self.has(L.SUKUN), self.has(L.SHADDA)
        self.bare = (self.vowel == NONE) & ~self.sukun & ~self.shadda
        # Places of neighbours: one behind the last letter stands for none.
        self.before = np.where(self.index > 0, self.k - 1, self.n)
        self.next = np.where(self.k + 1 < self.stop, self.k + 1, self.n)
        self.word_before = np.where((self.index == 0) & (self.k > self.verse), self.k - 1, self.n)

    def has(self, chars: str):
        return (self.marks & bits(chars)) != 0

    def of(self, column, place, none=0):
        """A column at places, and `none` where there is no letter."""
        return np.append(column, column.dtype.type(none))[place]

    def heard_around(self, silent):
        """(the spoken letter before in the word, the one behind in the text): places."""
        k = np.where(silent == 0, self.k, -1)
        before = np.append(-1, np.maximum.accumulate(k)[:-1]) if self.n else k
        k = np.where(silent == 0, self.k, self.n)
        after = np.append(np.minimum.accumulate(k[::-1])[::-1][1:], self.n) if self.n else k
        return np.where(before >= self.first, before, self.n), np.where(after < self.verse_stop, after, self.n)

    def joins(self, silent):
        """How many joining alifs there are up to a letter, over all texts."""
        return np.cumsum(silent == WASL)

    def skeletons(self):
        """For each word the number of its skeleton among those that rules ask for, or -1."""
        out = np.full(len(self.begin), -1)
        if self.n:
            wanted = _words()[0]
            sums = np.add.reduceat(_mixed(self.bare_letter, self.index), self.begin)
            for w in np.flatnonzero(np.isin(sums, _sums())):
                text = "".join(map(chr, self.bare_letter[self.begin[w] : self.end[w]]))
                out[w] = wanted.get(text, -1)
        return out


@lru_cache
def _sums() -> np.ndarray:
    """The sums that the skeletons of words have for which rules ask; others may share them."""
    return np.array([_mixed(np.array([ord(c) for c in w], np.uint32), np.arange(len(w))).sum(dtype=np.uint64) for w in _words()[0]], np.uint64)


def _mixed(letters, index):
    x = (letters.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (np.uint64(2) * index.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def letter_rules(s: Letters) -> list[tuple[str, np.ndarray]]:
    """(rule, the letters that bear it): `letters.annotated`."""
    letter, vowel = s.letter, s.vowel
    silent = np.select([(s.index == 0) & _is(s.base, "اٱ"), _is(s.base, "ا") & s.sukun, _is(letter, "و") & s.sukun & (s.of(vowel, s.before) == U)], [WASL, WRITTEN, WRITTEN], 0)
    long_marks = s.has(L.MADDAH + L.DAGGER)
    seat = _is(s.base, "اى") & ((s.tanwin != NONE) | (s.bare & ~long_marks & (s.of(s.tanwin, s.before) != NONE)))
    led = _is(letter, "ل") & (s.of(silent, s.before) == WASL) & (vowel == NONE) & (s.next < s.n)
    doubled_next = s.of(s.shadda, s.next)
    silent = np.where((silent == 0) & led & ~s.sukun & doubled_next, SHAMSI, silent)
    moon = led & s.sukun
    article = led & (s.sukun | ~doubled_next)
    joins = s.joins(silent)
    _, after = s.heard_around(silent)
    heard = silent == 0
    last = heard & (after == s.n)
    after = np.where(s.of(joins, after, -1) == joins, after, s.n)
    then, there = s.of(letter, after), after < s.n
    same_word = there & (s.of(s.word, after, -1) == s.word)
    iqlab = s.has(L.IQLAB_MEEM)
    nun = heard & there & ((_is(letter, "ن") & (vowel == NONE) & ~s.shadda) | (s.tanwin != NONE) | iqlab)
    to_b = iqlab | _is(then, "ب")
    into = ~to_b & _is(then, "ينمو")
    mim = heard & there & _is(letter, "م") & ~s.shadda & (s.tanwin == NONE) & (vowel == NONE)
    p, pv = s.of(letter, s.before), s.of(vowel, s.before)
    echo = heard & _is(letter, L.ECHOING)
    echo_last = last & (s.tanwin != A)
    merging = heard & ~_is(letter, "نماىءوي") & s.bare & ~seat & ~article & ~long_marks & there & s.of(s.shadda, after) & (same_word | (s.of(s.index, after, -1) == 0))
    places = np.zeros(0x10000, np.int8)
    for k, own in enumerate(L.PLACES):
        for c in own:
            places[ord(c)] = k + 1
    kin = (places[letter] > 0) & (places[letter] == places[then])
    rules = [(name, silent == k) for k, name in SILENT.items()] + [
        ("iqlab", nun & to_b), ("izhar_halqi", nun & ~to_b & _is(then, L.THROAT)), ("izhar_mutlaq", nun & into & same_word), ("idgham_ghunna", nun & into & ~same_word),
        ("idgham_no_ghunna", nun & ~to_b & _is(then, "لر")), ("ikhfa", nun & ~to_b & _is(then, L.HIDDEN)),
        ("ikhfa_shafawi", mim & _is(then, "ب")), ("idgham_shafawi", mim & _is(then, "م")), ("izhar_shafawi", mim & _is(then, "وف")),
        ("mim_jam", mim & (s.next == s.n) & _is(p, "هكتء") & ((pv == U) | ((pv == I) & _is(p, "ه")))),
        ("ghunna", heard & _is(letter, "نم") & s.shadda), ("qalqala_waqf", echo & echo_last), ("qalqala", echo & ~echo_last & s.sukun),
        ("idgham_same", merging & (then == letter)), ("idgham_kin", merging & (then != letter) & kin), ("idgham_near", merging & (then != letter) & ~kin),
        ("tafkhim", heard & _is(letter, L.HEAVY)), ("izhar_qamari", heard & moon),
    ]
    return [(name, np.flatnonzero(held)) for name, held in rules]


class Spoken:
    """Letters with how they are spoken, as `recitation.spoken` has them."""

    def __init__(self, s: Letters):
        self.s = s
        letter, vowel, index = s.letter, s.vowel, s.index
        s.marks = np.where(_is(s.base, "آ"), s.marks | bits(L.MADDAH), s.marks)
        self.dots = s.has(R.DOTS)
        proclitic = _is(letter, R.PROCLITICS) & ((vowel == A) | (vowel == I)) & ~(s.shadda & (index > 0)) & (s.tanwin == NONE)
        others = np.append(0, np.cumsum(~proclitic))
        led = (others[s.k] == others[s.first]) & (index >= 1) & (index <= 3)
        plain = s.bare & ~s.has(L.MADDAH + L.DAGGER) & ~self.dots
        followed = s.next < s.n
        nl, nv, ns = s.of(letter, s.next), s.of(vowel, s.next), s.of(s.shadda, s.next)
        self.changed = (
            (index == 0) & _is(s.base, "ا") & s.has(R.DOT_HIGH + R.DOT_LOW) & _is(s.of(letter, s.word_before), "ء") & (s.of(vowel, s.word_before) != NONE)
            & followed & ~(_is(nl, "ل") & (nv == NONE))
        )
        alif = _is(s.base, "اٱ")
        joining = alif & ((index == 0) | (plain & led & followed & ((nv == NONE) | ns)))
        bl, bv, bt = s.of(letter, s.before), s.of(vowel, s.before), s.of(s.tanwin, s.before)
        written = (_is(s.base, "ا") & s.sukun & (index > 0)) | (_is(letter, "و") & s.sukun & (bv == U))
        seat = _is(s.base, "اى") & ((s.tanwin != NONE) | (plain & (bt != NONE)))
        silent0 = np.where(self.changed, 0, np.select([written, joining], [WRITTEN, WASL], 0))
        self.seat = seat & (silent0 == 0)
        self.before_joins = s.of(silent0, s.before) == WASL
        to_lam = self.before_joins | (_is(bl, "ل") & (bv == I) & ((s.of(index, s.before, -1) == 0) | s.of(led, s.before)))
        article = _is(letter, "ل") & to_lam & (vowel == NONE) & followed
        self.silent = np.where((silent0 == 0) & article & ~s.sukun & ns, SHAMSI, silent0)
        self.aloud = self.silent == 0
        heard = self.aloud & ~self.seat
        maddah, dagger, zero = s.has(L.MADDAH), s.has(L.DAGGER), s.has(R.ROUND_ZERO)
        voiced = (vowel != NONE) | s.sukun | s.shadda
        long = np.select(
            [dagger & ~self.dots, self.dots & ~(maddah & zero), _is(letter, "ء") & maddah, voiced, _is(letter, "ا") & (maddah | ((bv == A) & (bt == NONE))),
             _is(letter, "ى") & (bv == A), _is(letter, "و") & (bv == U), _is(letter, "ي") & (bv == I)],
            [A, NONE, A, NONE, A, A, U, I], NONE,
        )
        self.long = np.where(heard, long, NONE)
        self.lin = heard & ~dagger & ~self.dots & _is(letter, "وي") & s.sukun & (bv == A) & (vowel == NONE)
        self.silah = heard & s.has(R.SMALL_WAW + R.SMALL_YEH + R.SMALL_HIGH_YEH)
        joins = s.joins(self.silent)
        self.last, self.after = s.heard_around(self.silent)
        self.followed = self.after < s.n
        self.crossed = self.followed & (s.of(joins, self.after) != joins)
        self.ends = self.aloud & ~self.followed
        self.after_ends = s.of(self.ends, self.after)
        self.last2 = np.append(self.last, s.n)[self.last]


def _ra(v: Spoken) -> list[tuple[str, np.ndarray]]:
    s = v.s
    ll, lv, lo = s.of(s.letter, v.last), s.of(s.vowel, v.last), s.of(v.long, v.last)
    sukun = s.of(s.sukun, v.last)
    stop = v.ends & (s.tanwin != A)
    heavy_next, next_i = _is(s.of(s.letter, s.next), L.HEAVY), s.of(s.vowel, s.next) == I
    light = (lo == I) | (_is(ll, "ي") & sukun) | (lv == I) | ((lo == A) & ((s.of(s.marks, v.last2) & bits(R.DOT_LOW)) != 0))
    rested = sukun & (s.of(s.vowel, v.last2) == I)
    heavy, thin, both = 1, 2, 3
    stopped = np.select([light, rested & _is(ll, L.HEAVY), rested], [thin, both, thin], heavy)
    quiet = np.select([v.before_joins, (lv == I) & heavy_next & next_i, (lv == I) & heavy_next, lv == I], [heavy, both, heavy, thin], heavy)
    how = np.select([stop, s.vowel == I, s.vowel != NONE], [stopped, thin, heavy], quiet)
    how = np.where(_is(s.letter, "ر") & v.aloud, how, 0)
    return [("ra_tafkhim", how == heavy), ("ra_tarqiq", how == thin), ("ra_both", how == both)]


def _lengthening(v: Spoken) -> list[tuple[str, np.ndarray]]:
    s = v.s
    none, names = 0, ("", "madd_badal", "madd_tabii", "madd_munfasil", "madd_silah", "madd_changed_hamza", "madd_muttasil_waqf", "madd_muttasil", "madd_lazim", "wasl_drop", "madd_arid", "madd_lin")
    n = {x: k for k, x in enumerate(names)}
    maddah, dagger, zero = s.has(L.MADDAH), s.has(L.DAGGER), s.has(R.ROUND_ZERO)
    same = v.followed & (s.of(s.word, v.after, -1) == s.word)
    hamza, dotted = _is(s.of(s.letter, v.after), "ء"), s.of(v.dots, v.after)
    is_hamza = _is(s.letter, "ء")
    own = np.where((is_hamza & maddah) | _is(s.of(s.letter, s.before), "ء"), n["madd_badal"], n["madd_tabii"])
    begins = hamza & (s.of(s.index, v.after, -1) == 0)
    joined = np.select([~v.followed | v.crossed, begins, _is(s.letter, "ه")], [none, n["madd_munfasil"], n["madd_silah"]], n["madd_tabii"])
    calling = (s.index == 0) & _is(s.letter, "يه") & dagger & same & (hamza | dotted)
    met = same & hamza
    reached = np.select(
        [zero & maddah, is_hamza & dagger & same & dotted, calling, ~v.followed, met & dotted, met & v.after_ends, met, same & (s.of(s.shadda, v.after) | s.of(s.sukun, v.after)),
         ~same & v.crossed, ~same & begins, ~same, v.after_ends],
        [n["madd_changed_hamza"], none, n["madd_munfasil"], own, n["madd_changed_hamza"], n["madd_muttasil_waqf"], n["madd_muttasil"], n["madd_lazim"],
         n["wasl_drop"], n["madd_munfasil"], own, n["madd_arid"]],
        own,
    )
    linked = v.silah & ~(s.has(R.SMALL_HIGH_YEH) & is_hamza)
    how = np.select([linked, v.lin & same & v.after_ends, v.lin, v.long != NONE], [joined, n["madd_lin"], none, reached], none)
    how = np.where(v.aloud, how, none)
    return [(x, how == k) for k, x in enumerate(names) if k]


def _by_marks(v: Spoken) -> list[tuple[str, np.ndarray]]:
    s = v.s
    tasheel, ibdal, ishmam, ikhtilas, imala = range(1, 6)
    first = s.of(s.vowel, s.word_before)
    own = np.where(s.vowel != NONE, s.vowel, np.where(s.has(R.DOT_LOW), I, A))
    second = np.where(((first == I) & (own == A)) | ((first == U) & ((own == A) | (own == I))), ibdal, tasheel)
    high = s.has(R.DOT_HIGH)
    dotted = np.select(
        [s.has(R.ROUND_ZERO), high & (_is(s.base, "ا") | s.has(L.DAGGER)), high & _is(s.letter, "س"), high, _is(s.letter, "ه"), _is(s.letter, "ي")],
        [tasheel, tasheel, ishmam, ikhtilas, imala, tasheel], ikhtilas,
    )
    how = np.select([v.changed, v.dots & v.aloud], [second, dotted], 0)
    return [(x, how == k) for k, x in enumerate(("tasheel", "ibdal", "ishmam", "ikhtilas", "imala"), 1)]


#: All words that are the name of God, as `recitation.ALLAH` has them.
ALLAH_WORDS = tuple("".join(p) for p in itertools.product(("", "و", "ف"), ("", "ا", "ء"), ("", "ب", "ت", "ك"), ("", "ا"), ("لله",), ("", "م")))


@lru_cache
def _words() -> tuple[dict[str, int], dict[str, list[tuple]]]:
    """(number of each word that some rule asks for, phrases by their first word: (words, chapters, rule, bearer, state))."""
    phrases: dict[str, list[tuple]] = {}
    for first, own, chapters, rule, letter in R.WORDS:
        for w in own.split():
            for p in ("", *first):
                phrases.setdefault(p + w, []).append(([p + w], chapters, rule, letter or "word", ""))
    for own, chapters, rule, how in R.PHRASES:
        bearer, _, state = how.partition(" ")
        phrases.setdefault(own.split()[0], []).append((own.split(), chapters, rule, bearer, state))
    asked = dict.fromkeys([*R.OPENING_WORDS, *ALLAH_WORDS, *(w for own in phrases.values() for p in own for w in p[0])])
    return {w: k for k, w in enumerate(asked)}, phrases


def verse_rules(s: Letters, raw: Letters, chapters: list, verses: list) -> tuple[Spoken, list[tuple[str, np.ndarray, np.ndarray]]]:
    """(spoken letters, (rule, first letters, last letters)): `recitation.recited` of texts in its script; `raw` are the texts as they are, whose words are looked up."""
    v = Spoken(s)
    number, phrases = _words()
    names = list(number)
    skeleton = raw.skeletons()
    # Words of both have the same numbers in a text.
    place = raw.words_before[s.text_of] + np.arange(len(s.begin)) - s.words_before[s.text_of]
    there = place < raw.words_before[s.text_of + 1]
    of_word = np.where(there, np.append(skeleton, -1)[np.where(there, place, len(skeleton))], -1)
    opens = [t for t in range(s.texts) if chapters[t] is not None and ((verses[t] == 1 and chapters[t] in R.OPENING_CHAPTERS) or (chapters[t] == 42 and verses[t] == 2))]
    n_opening = np.zeros(s.texts, np.int64)
    openers = {number[w] for w in R.OPENING_WORDS}
    for t in opens:
        for w in skeleton[raw.words_before[t] : raw.words_before[t + 1]]:
            if w not in openers:
                break
            n_opening[t] += 1
    opening = s.number < n_opening[s.text]
    chapter = np.array([-1 if c is None else c for c in chapters], np.int64)[s.text] if s.n else np.zeros(0, np.int64)

    # Letters in a row inside a word's skeleton, which need not be letters of this script's word.
    inside = np.zeros(s.n, np.int64)
    for k, (part, _, letter, how) in enumerate(R.INSIDE, 1):
        hit = np.ones(max(raw.n - len(part) + 1, 0), bool)
        for j, c in enumerate(part):
            hit &= raw.bare_letter[j : j + len(hit)] == ord(c)
        hit &= raw.word[: len(hit)] == raw.word[len(part) - 1 :][: len(hit)]
        has = np.zeros(len(raw.begin) + 1, bool)
        has[raw.word[np.flatnonzero(hit)]] = True
        in_word = has[np.where(there, place, len(raw.begin))]
        inside = np.where(in_word[s.word] & _is(s.letter, letter) & getattr(s, how), k, inside)
    inner = np.flatnonzero(inside)
    inner = inner[np.diff(s.word[inner], prepend=-1) != 0] if len(inner) else inner

    allah = np.isin(of_word, [number[w] for w in ALLAH_WORDS])
    lams = np.flatnonzero(_is(s.letter, "ل") & allah[s.word]) if s.n else np.zeros(0, np.int64)
    lams = lams[np.diff(s.word[lams], append=-1) != 0] if len(lams) else lams
    last = v.last[lams]
    spoken_before = np.where(s.of(s.vowel, last) != NONE, s.of(s.vowel, last), s.of(v.long, last))
    begun, led_by = s.vowel[s.first[lams]], s.of(s.vowel, s.word_before[s.first[lams]])
    alone = np.select([s.number[lams] == 0, begun != NONE, led_by != NONE], [A, begun, led_by], A)
    thin = np.where(last < s.n, spoken_before, alone) == I

    iwad = v.aloud & v.ends & (v.seat | ((s.tanwin == A) & ~_is(s.letter, "ة")))
    usual = [*_ra(v), *_lengthening(v), *_by_marks(v), ("madd_iwad", iwad)]
    found = [(rule, np.flatnonzero(held & ~opening)) for rule, held in usual]
    found += [(rule, k[~opening[k]]) for rule, k in (("lam_tarqiq", lams[thin]), ("lam_tafkhim", lams[~thin]), *((r[1], inner[inside[inner] == k]) for k, r in enumerate(R.INSIDE, 1)))]
    if len(opens):
        maddah = s.has(L.MADDAH)
        ayn = maddah & _is(s.letter, "ع") & ((chapter == 19) | (chapter == 42))
        tsm = (of_word == number["طسم"])[s.word]
        called = (("madd_ayn", ayn), ("madd_lazim_harfi", maddah & ~ayn), ("madd_harfi_tabii", ~maddah & _is(s.letter, "حيطهر")), ("ghunna", _is(s.letter, "نم") & s.shadda), ("idgham_riwaya", tsm & _is(s.letter, "س")))
        found += [(rule, np.flatnonzero(held & opening)) for rule, held in called]
    rules = [(rule, k, k) for rule, k in found]

    # Phrases: few words are the first of one.
    borne: dict[tuple, tuple] = {}
    for w in np.flatnonzero(np.isin(skeleton, [number[x] for x in phrases])):
        text = int(raw.text_of[w])
        at, stop = int(w) - int(raw.words_before[text]), int(raw.words_before[text + 1])
        own = int(s.words_before[text]) + at
        if own >= s.words_before[text + 1]:
            continue
        a, b = int(s.begin[own]), int(s.end[own])
        for words, of, rule, bearer, state in phrases[names[skeleton[w]]]:
            if of is not None and chapters[text] not in of or w + len(words) > stop or any(skeleton[w + j] != number[x] for j, x in enumerate(words)):
                continue
            if at != 0 if state == "opening" else bearer != "last" and at < n_opening[text]:
                continue
            bears = [b - 1] if bearer in ("word", "last") else [k for k in range(a, b) if s.letter[k] == ord(bearer)]
            fits = bool(s.bare[bears[0]] if state == "bare" else s.sukun[bears[0]] if state == "sukun" else True) if bears else state != "sukun"
            if fits:
                borne[own, rule, bearer, state] = (rule, a, b - 1) if bearer == "word" or not bears else (rule, bears[0], bears[0])
    for rule in dict.fromkeys(x[0] for x in borne.values()):
        own = [x for x in borne.values() if x[0] == rule]
        rules.append((rule, np.array([x[1] for x in own]), np.array([x[2] for x in own])))
    return v, rules


def book_rules(s: Letters, raw: Letters, chapters: list, verses: list) -> tuple[Spoken, np.ndarray, np.ndarray]:
    """(spoken letters, rules that begin at a letter, rules that a letter bears): `rulebook.all_rules`, a bit for each rule of the book."""
    plain = letter_rules(s)  # before marks are changed
    v, own = verse_rules(s, raw, chapters, verses)
    begun, borne = np.zeros(s.n, np.uint64), np.zeros(s.n, np.uint64)
    called = np.zeros(len(s.begin), bool)
    for rule, first, last in own:
        bit = np.uint64(1 << RANK[rule])
        begun[first] |= bit
        borne[first] |= bit
        for a, b in zip(first[first < last], last[first < last], strict=True):
            borne[a : b + 1] |= bit
        if rule in ("madd_lazim_harfi", "madd_harfi_tabii", "madd_ayn"):
            called[s.word[first]] = True
    for rule, k in plain:
        k = k[~called[s.word[k]]]
        bit = np.uint64(1 << RANK[BOOK_NAMES.get(rule, rule)])
        begun[k] |= bit
        borne[k] |= bit
    return v, begun, borne


def _runs(batches, texts: int):
    """Slices of batches whose texts, in their last `texts` columns, have some RUN_BYTES."""
    for batch in batches:
        sizes = sum(np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in batch.columns[-texts:]) if batch.num_rows else []
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + RUN_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _named(rules, s: Letters):
    """(letters, last letters, Arrow's names) of all rules, one after the other."""
    import pyarrow as pa

    rules = [(r, a, b) for r, a, b in rules if len(a)]
    names = pa.array([r[0] for r in rules], pa.string())
    first, last = (np.concatenate([r[x] for r in rules]) if rules else np.zeros(0, np.int64) for x in (1, 2))
    return first, last, names.take(pa.array(np.repeat(np.arange(len(rules)), [len(r[1]) for r in rules])))


def _tally(batch, by: list[str], rules, s: Letters):
    """A batch of (by, rule, n, words, indexes) of all rules of a run."""
    import pyarrow as pa

    names = list(dict.fromkeys(r[0] for r in rules))
    number = {r: k for k, r in enumerate(names)}
    at = np.concatenate([r[1] for r in rules]).astype(np.int64)
    code = s.text[at] * len(names) + np.repeat([number[r[0]] for r in rules], [len(r[1]) for r in rules])
    space = s.texts * len(names)
    n = np.bincount(code, minlength=space)
    held = np.flatnonzero(n)
    sums = (np.bincount(code, x[at], space)[held].astype(np.int64) for x in (s.number, s.index))
    rule = pa.array(names).take(pa.array(held % len(names)))
    return pa.RecordBatch.from_arrays([*_keys(batch, by, held // len(names)), rule, pa.array(n[held]), *map(pa.array, sums)], names=[*by, "rule", "n", "words", "indexes"])


#: What `_tally` gives of each text and rule: how many letters bear it, and the sums of their words' numbers and of their own.
TALLY = "rule string, n long, words long, indexes long"


def _fields(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def _keys(batch, by: list[str], at):
    import pyarrow as pa

    at = pa.array(at)
    return [batch.column(k).take(at) for k in range(len(by))]


def annotated(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, word, index, rule): the rows of `letters.annotated`; each row of `texts` is a text by itself."""

    def run(batches):
        import pyarrow as pa

        for batch in _runs(batches, 1):
            s = Letters(batch.column(len(by)))
            first, _, rule = _named([(r, k, k) for r, k in letter_rules(s)], s)
            yield pa.RecordBatch.from_arrays([*_keys(batch, by, s.text[first]), *(pa.array(c[first].astype(np.int32)) for c in (s.number, s.index)), rule], names=[*by, "word", "index", "rule"])

    return _composed(texts, by, text).mapInArrow(run, f"{_fields(texts, by)}, word int, index int, rule string")


def annotated_tally(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, rule, n, words, indexes): the rows of `annotated` counted and summed, a row a text and rule."""

    def run(batches):
        for batch in _runs(batches, 1):
            s = Letters(batch.column(len(by)))
            yield _tally(batch, by, letter_rules(s), s)

    return _composed(texts, by, text).mapInArrow(run, f"{_fields(texts, by)}, {TALLY}")


def _composed(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    return texts.select(*by, F.coalesce(compose_hamza(F.col(text)), F.lit("")).alias("_text"))


def _prepared(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, chapter, verse, the text, the text in its script)."""
    held = verses.select(*by, F.col(chapter).cast("int").alias("_chapter"), F.col(verse).cast("long").alias("_verse"), F.coalesce(text, F.lit("")).alias("_text"))
    return held.withColumn("_script", compose_hamza(R.script(F.col("_text"))))


def _read(batch, n: int):
    """(letters in their script, those of the text as it is, chapters, verses) of a run whose keys are `n` columns."""
    chapters, verses = (batch.column(n + k).to_pylist() for k in (0, 1))
    raw = Letters(batch.column(n + 2))
    return raw if batch.column(n + 2).equals(batch.column(n + 3)) else Letters(batch.column(n + 3)), raw, chapters, verses


def recited(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, word, index, end, rule): the rows of `recitation.recited`; each row of `verses` is a verse by itself."""

    def run(batches):
        import pyarrow as pa

        for batch in _runs(batches, 2):
            s, *more = _read(batch, len(by))
            first, last, rule = _named(verse_rules(s, *more)[1], s)
            columns = (s.number[first], s.index[first], s.index[last])
            yield pa.RecordBatch.from_arrays([*_keys(batch, by, s.text[first]), *(pa.array(c.astype(np.int32)) for c in columns), rule], names=[*by, "word", "index", "end", "rule"])

    return _prepared(verses, by, chapter, verse, text).mapInArrow(run, f"{_fields(verses, by)}, word int, index int, end int, rule string")


def recited_tally(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, rule, n, words, indexes): the rows of `recited` counted and summed, a row a verse and rule."""

    def run(batches):
        for batch in _runs(batches, 2):
            s, *more = _read(batch, len(by))
            yield _tally(batch, by, verse_rules(s, *more)[1], s)

    return _prepared(verses, by, chapter, verse, text).mapInArrow(run, f"{_fields(verses, by)}, {TALLY}")


def _strings(codes, ends):
    """Arrow's strings of characters one after the other, by where each ends."""
    import pyarrow as pa

    data = codes.tobytes().decode("utf-32-le").encode()
    size = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(size[np.append(0, ends)].astype(np.int32).tobytes()), pa.py_buffer(data))


def _lists(values, sizes):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def segments(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, word, segments): the rows of `rulebook.segments` by all rules of the verses; each row of `verses` is a verse by itself."""

    def run(batches):
        import pyarrow as pa

        number, _ = _words()
        name_of = pa.array([r[0] for r in RULES])
        for batch in _runs(batches, 2):
            s, raw, *more = _read(batch, len(by))
            _, _, rules = book_rules(s, raw, *more)
            allah = np.isin(s.skeletons(), [number[w] for w in ALLAH_WORDS])[s.word] if s.n else np.zeros(0, bool)
            bound = _is(s.of(s.letter, s.before), "ل") & (_is(s.letter, "ا") | (allah & _is(s.letter, "له")))
            # A bound letter takes on the rules of those before it.
            while True:
                grown = np.where(bound, rules | s.of(rules, s.before), rules)
                if np.array_equal(grown, rules):
                    break
                rules = grown
            new = ~(bound | ((s.index > 0) & (s.of(rules, s.before) == rules)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], s.n) - 1 if len(first) else first
            kept = np.sort(np.concatenate([s.at, s.marked]))
            texts = _strings(s.code[kept], np.cumsum(s.size)[last])
            masks, which = np.unique(rules[last], return_inverse=True)
            sets = pa.array([[k for k in range(len(RULES)) if int(m) >> k & 1] for m in masks], pa.list_(pa.int32()))
            held = sets.take(pa.array(which))
            held = pa.ListArray.from_arrays(held.offsets, name_of.take(held.values))
            pieces = _lists(pa.StructArray.from_arrays([texts, held], ["text", "rules"]), np.bincount(s.word[first], minlength=len(s.begin)))
            yield pa.RecordBatch.from_arrays([*_keys(batch, by, s.text_of), pa.array(s.number[s.begin].astype(np.int32)), pieces], names=[*by, "word", "segments"])

    return _prepared(verses, by, chapter, verse, text).mapInArrow(run, f"{_fields(verses, by)}, word int, segments array<struct<text: string, rules: array<string>>>")


def tagged_words(verses: DataFrame, by: list[str], chapter: str, verse: str, text: str) -> DataFrame:
    """(by, word, spoken, tags): the rows of `rulebook.tagged_words` by all rules of the verses; each row of `verses` is a verse by itself."""
    tags = list(dict.fromkeys([r[4] for r in RULES if r[4]] + ["m_ghunna"]))

    def run(batches):
        import pyarrow as pa

        tag_of = pa.array(tags)
        for batch in _runs(batches, 2):
            s, raw, *more = _read(batch, len(by))
            v, rules, _ = book_rules(s, raw, *more)
            merged = _is(s.of(s.letter, v.after), "نم")
            at, tag = [], []
            for rule, *_, own in RULES:
                if own:
                    k = np.flatnonzero(rules & np.uint64(1 << RANK[rule]))
                    if rule == "idgham_ghunna":
                        k = k[~merged[k]]
                    at.append(k)
                    tag.append(np.where(_is(s.letter[k], "م") & (rule == "ghunna"), tags.index("m_ghunna"), tags.index(own)))
            at, tag = np.concatenate(at), np.concatenate(tag)
            order = np.argsort(at, kind="stable")
            at, tag = at[order], tag[order]
            once = np.sort(np.unique(s.word[at] * len(tags) + tag, return_index=True)[1])
            at, tag = at[once], tag[once]
            # Words as they are written; a word has the tags of that with its number in the script.
            sizes = np.bincount(s.word[at], minlength=len(s.begin))
            place = raw.words_before[s.text_of] + np.arange(len(s.begin)) - s.words_before[s.text_of]
            there = place < raw.words_before[s.text_of + 1]
            n = np.zeros(len(raw.begin), np.int64)
            n[place[there]] = sizes[there]
            found = _lists(tag_of.take(pa.array(tag[there[s.word[at]]] if len(at) else tag)), n)
            chosen = np.zeros(int(raw.token[-1]) + 1 if len(raw.token) else 1, bool)
            chosen[raw.token_of] = True
            kinds = _tables()[0]
            kept = np.flatnonzero(chosen[raw.token] & (kinds[raw.code] != SPACE)) if len(raw.token) else np.zeros(0, np.int64)
            ends = np.searchsorted(raw.token[kept], raw.token_of[raw.begin], side="right")
            words = _strings(raw.code[kept], ends)
            yield pa.RecordBatch.from_arrays([*_keys(batch, by, raw.text_of), pa.array((raw.word - raw.words_before[raw.text])[raw.begin].astype(np.int32)), words, found], names=[*by, "word", "w", "tags"])

    rows = _prepared(verses, by, chapter, verse, text).mapInArrow(run, f"{_fields(verses, by)}, word int, w string, tags array<string>")
    return rows.select(*by, "word", asr_form(F.col("w")).alias("spoken"), "tags").filter("spoken <> ''")
