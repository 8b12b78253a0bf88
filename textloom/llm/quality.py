"""Quality rules as a short-circuit cascade.

A bounded sample is measured first: the time that each rule takes, and the share of
documents that it rejects.  Rules then run in falling order of rejections per cost, and
a document that one rejects is not shown to the rest.  Order never changes a verdict: a
document is kept if no rule rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class TextView:
    """A text and what rules ask of it, each computed once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word, as they are."""
        return [x for x in self.text.encode().split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text has at least twice."""
        import numpy as np

        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if len(number) == n:
            return 0
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        code = pair[:-1] * len(number) + ids[2:]
        order = np.sort(code)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(code, twice)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        return int(covered.sum())

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter (any byte of a letter outside ASCII counts)."""
        return len(re.findall(rb"[A-Za-z\x80-\xff][^\x20\x09-\x0d]*", self.text.encode()))

    @cached_property
    def n_capitals(self) -> int:
        """Words of two bytes or more with an ASCII capital and no small ASCII letter."""
        return sum(len(w) > 1 for w in self.words if w.isupper())


@dataclass(frozen=True)
class Rule:
    """Rejects a text if `rejects` of its view is true."""

    name: str
    rejects: Callable[[TextView], bool]


#: The base of the contract, and common limits for web text.
BASE_RULES = (
    Rule("few_words", lambda v: v.n_words < 50),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
)
WEB_RULES = (
    Rule("many_words", lambda v: v.n_words > 100_000),
    Rule("word_length", lambda v: v.n_words > 0 and not 3 * v.n_words <= v.word_chars <= 10 * v.n_words),
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("repeated_lines", lambda v: len(v.lines) >= 6 and 10 * v.n_dup_lines > 4 * len(v.lines)),
    Rule("few_letters", lambda v: 100 * v.n_lettered < 80 * v.n_words),
    Rule("capitals", lambda v: 100 * v.n_capitals > 30 * v.n_words),
)


def _unspaced(text: str) -> bool:
    """Whether most characters are of scripts that do not part words by spaces (from U+0E00 to U+0EFF, and from U+2E80 on, letters of East Asia)."""
    return 2 * sum("\u0e00" <= c <= "\u0eff" or "\u2e80" <= c <= "\u9fff" or c >= "\U00020000" for c in text) > len(text)


#: Limits for a corpus of all scripts and lengths: books are no junk, and word lengths say something only where spaces part words.
CORPUS_RULES = tuple(
    Rule("word_length", lambda v: v.n_words > 0 and not 3 * v.n_words <= v.word_chars <= 10 * v.n_words and not _unspaced(v.text)) if r.name == "word_length" else r
    for r in BASE_RULES + WEB_RULES
    if r.name != "many_words"
)


def rule_figures(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 2_000, seed: int = 7) -> dict[str, tuple[float, float]]:
    """{rule: (seconds a document, share rejected)} on a sample of at most `sample_rows` rows.

    The sample is for the order of rules only.  Without rows it is empty.
    """
    from time import perf_counter

    def run(batches):
        import pyarrow as pa

        took, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in batch.column(0):
                n += 1
                for k, rule in enumerate(rules):
                    view = TextView(t.as_py())  # anew: a rule bears the cost of all that it asks for
                    start = perf_counter()
                    hits[k] += bool(rule.rejects(view))
                    took[k] += perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "s": took, "hits": hits, "n": [n] * len(rules)}, schema=pa.schema([("rule", pa.string()), ("s", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())]))

    total = docs.count()
    if not total:
        return {}
    some = docs.select(text_col).sample(min(1.0, 0.9 * sample_rows / total), seed).limit(sample_rows)
    rows = some.mapInArrow(run, "rule string, s double, hits long, n long").groupBy("rule").agg(F.sum("s"), F.sum("hits"), F.sum("n")).collect()
    return {r[0]: (r[1] / r[3], r[2] / r[3]) for r in rows if r[3]}


def cascade_order(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; those without figures, and ties, as given."""
    def worth(rule: Rule) -> float:
        cost, share = figures.get(rule.name, (1.0, 0.0))
        return -share / max(cost, 1e-9)

    return tuple(sorted(rules, key=worth))


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + WEB_RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2_000, stats: bool = False) -> DataFrame:
    """Return (id, kept, rejected_by) for each row, with `stats` also the base statistics and base_failed.

    rejected_by is the first rule of the cascade's order that rejects the text, null if
    kept; where several reject it, which is first follows from measured times and may
    differ from run to run.  A null text has no words.  Rows with null or repeated ids each give a row.
    Other columns are not carried.  An empty table gives an empty result.
    """
    order = cascade_order(rules, rule_figures(docs, rules, text_col, sample_rows))
    base = {r.name for r in BASE_RULES}
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in BASE.split(", ")] if stats else []

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            by, failed, found = [], [], [[] for _ in names]
            for t in batch.column(1):
                view = TextView(t.as_py())
                by.append(next((r.name for r in order if r.rejects(view)), None))
                if stats:
                    failed.append(by[-1] in base or any(r.rejects(view) for r in BASE_RULES))
                for column, name in zip(found, names, strict=True):
                    column.append(getattr(view, name))
            out = [batch.column(0), *[pa.array(x, pa.int64()) for x in found]]
            out += [pa.array(failed, pa.bool_())] * stats + [pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["id", *names, *["base_failed"] * stats, "kept", "rejected_by"])

    schema = f"id {kind}, " + (BASE + ", base_failed boolean, " if stats else "") + "kept boolean, rejected_by string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + WEB_RULES, text_col: str = "text", sample_rows: int = 2_000) -> DataFrame:
    """The rows of `docs` that no rule rejects, with all columns, without a shuffle."""
    order = cascade_order(rules, rule_figures(docs, rules, text_col, sample_rows))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([not any(r.rejects(view) for r in order) for view in (TextView(t.as_py()) for t in batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
