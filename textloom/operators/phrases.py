"""Many phrases found at once: one automaton built from a table of phrases and run over each text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases that an automaton is built of at most; it lies in every task.
MOST_PHRASES = 1_000_000


class Automaton:
    """Aho-Corasick over whole words: where which phrases begin, and how many words they have."""

    def __init__(self, phrases: Iterable[tuple[object, list[str]]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        own: dict[str, list[tuple]] = {}
        for key, words in phrases:
            if words:
                # Each word has its own two ends, so that phrases meet texts at whole words only.
                own.setdefault("".join(f" {w} " for w in words), []).append((key, len(words)))
        for text, keys in own.items():
            self.trie.add_word(text, (len(text), keys))
        self.empty = not own
        if own:
            self.trie.make_automaton()

    def find(self, words: list[str]) -> list[tuple[int, int, object]]:
        """(first word, number of words, key) of every place of every phrase, in order; places may overlap."""
        if self.empty:
            return []
        begins, at = {}, 0
        for i, w in enumerate(words):
            begins[at] = i
            at += len(w) + 2
        found = self.trie.iter("".join(f" {w} " for w in words))
        return sorted(((begins[end + 1 - size], n, key) for end, (size, keys) in found for key, n in keys), key=lambda x: (x[0], x[1], str(x[2])))


def find_phrases(texts: DataFrame, by: list[str], words: Column, phrases: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """(by, at, n, phrase): every place at which the words of a text hold a phrase of `phrases` (phrase, words), without a shuffle.

    Phrases are collected once; more than `most` are an error, as each task holds them.  Null
    or empty words, of texts or phrases, match nothing; phrases with the same words each give
    rows.  Words hold no spaces.
    """
    rows = phrases.select("phrase", "words").filter("size(words) > 0").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} phrases")
    table = [(r.phrase, list(r.words)) for r in rows]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in by)
    kind = phrases.schema["phrase"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        automaton = Automaton(table)
        for batch in batches:
            at, found = [], []
            for i, w in enumerate(batch.column(len(by)).to_pylist()):
                here = automaton.find(w or [])
                at += [i] * len(here)
                found += here
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], out_kind)], names=[*by, "at", "n", "phrase"])

    from pyspark.sql.pandas.types import to_arrow_type

    out_kind = to_arrow_type(phrases.schema["phrase"].dataType)
    return texts.select(*[F.col(f"`{c}`") for c in by], words.alias("_words")).mapInArrow(run, f"{fields}, at int, n int, phrase {kind}")
