"""Runs of words that repeat with a period: every maximal one, and texts without the repeats.

For each period p the words at jp and (j+1)p are compared: a stretch of 2p words with
period p has such a pair inside, so the grid misses none, and over all periods it has
only about n ln n pairs.  Pairs that lie within a run already found, whose period divides
p, tell nothing new and are skipped.  What survives is extended to both sides by comparing
growing chunks of the words with the words p further on.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, functions as F

#: Pairs of the grid that are compared at once.
BLOCK = 1 << 18
#: Words of texts whose grid is kept, and neighbours of a pair that are compared before it is extended.
SHORT, CHUNK = 4096, 8


def _grid(n: int, p0: int, block: int):
    """Pairs (jp, p) with (j+1)p < n for periods p0, p0 + 1, ... up to n // 2, as many periods as have about `block` pairs; and the next period."""
    import numpy as np

    p1, total, last = p0, 0, n // 2
    while p1 <= last and (total == 0 or total + (n - 1) // p1 <= block):
        step = min(last - p1 + 1, max(1, (block - total) // max(1, (n - 1) // p1)))
        total += step * ((n - 1) // p1)
        p1 += step
    p = np.arange(p0, p1)
    count = (n - 1) // p
    period = np.repeat(p, count)
    j = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    return j * period, period, p1


@cache
def _short_grid():
    """The grid of texts of up to SHORT words, by the second place of a pair: what a shorter text has of it is a prefix."""
    import numpy as np

    p = np.arange(1, SHORT)
    count = (SHORT - 1) // p
    period = np.repeat(p, count)
    a = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
    order = np.argsort(a + period, kind="stable")
    return a[order], period[order], (a + period)[order]


def _hits(ids, p0: int, block: int):
    """Equal pairs of the grid by period, then place, for periods from p0 on; and the next period."""
    import numpy as np

    n = len(ids)
    if p0 == 1 and n <= SHORT:
        a, p, b = _short_grid()
        m = int(np.searchsorted(b, n))
        hit = np.flatnonzero(ids[a[:m]] == ids[b[:m]])
        hit = hit[p[hit] <= n // 2]
        hit = hit[np.lexsort((a[hit], p[hit]))]
        return a[hit], p[hit], n
    a, p, p1 = _grid(n, p0, block)
    hit = np.flatnonzero(ids[a] == ids[a + p])
    return a[hit], p[hit], p1


def _near(ids, at, period, forward: bool):
    """For each pair: how many of the next (or last) CHUNK words are equal to those a period further on, without a gap."""
    import numpy as np

    n, k = len(ids), np.arange(1, CHUNK + 1)
    x = at[:, None] + (k if forward else -k)
    y = x + period[:, None]
    inside = y < n if forward else x >= 0
    equal = inside & (ids[np.where(inside, x, 0)] == ids[np.where(inside, y, 0)])
    return np.where(equal.all(1), CHUNK, np.argmin(equal, 1))


def _extend(ids, a: int, p: int) -> tuple[int, int]:
    """The longest stretch [start, end) around the pair at `a` in which words p apart are equal."""
    import numpy as np

    n, size, i = len(ids), 64, a + 1
    while i < n - p:
        j = min(i + size, n - p)
        differ = np.flatnonzero(ids[i:j] != ids[i + p : j + p])
        if len(differ):
            i += int(differ[0])
            break
        i, size = j, size * 2
    end, size, i = i + p, 64, a
    while i > 0:
        j = max(0, i - size)
        differ = np.flatnonzero(ids[j:i] != ids[j + p : i + p])
        if len(differ):
            i = j + int(differ[-1]) + 1
            break
        i, size = j, size * 2
    return i, end


class _Found:
    """Runs found so far, by period, for the question whether a pair lies within one whose period divides its own."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.arrays: dict[int, object] = {}

    def add(self, start: int, end: int, p: int) -> None:
        self.runs.append((start, end - start, p))
        self.by.setdefault(p, []).append((start, end))
        self.arrays.pop(p, None)

    def outside(self, a, p):
        """Which pairs lie within no run of a divisor of their period."""
        import numpy as np

        out = np.ones(len(a), bool)
        one = int(p[0]) if len(a) and p[0] == p[-1] else 0
        for q in self.by:
            if one and one % q:
                continue
            mine = np.flatnonzero(out & (p % q == 0))
            if len(mine):
                if q not in self.arrays:
                    self.arrays[q] = np.array(sorted(self.by[q]))
                own = self.arrays[q]
                k = np.searchsorted(own[:, 0], a[mine], "right") - 1
                out[mine[(k >= 0) & (a[mine] + p[mine] < own[np.maximum(k, 0), 1])]] = False
        return out


def find_runs(ids, least: int = 12, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among words given as numbers, by start, then period.

    A run is a stretch with smallest period q, of at least max(least, 2q) words, that no
    neighbouring word extends.
    """
    import numpy as np

    ids = np.asarray(ids)
    n, p0, found = len(ids), 1, _Found()
    while n >= max(least, 2) and p0 <= n // 2:
        a, p, p0 = _hits(ids, p0, block)
        if len(a):
            new = found.outside(a, p)
            a, p = a[new], p[new]
        if not len(a):
            continue
        need = np.minimum(np.maximum(least, 2 * p) - p, CHUNK)  # equal neighbours that a run has, this pair among them
        fits = 1 + _near(ids, a, p, True) + _near(ids, a, p, False) >= need
        a, p = a[fits], p[fits]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for own, periods in zip(np.split(a, cuts), np.split(p, cuts), strict=True):
            if not len(own):
                continue
            own = own[found.outside(own, periods)]
            q, i = int(periods[0]), 0
            while i < len(own):
                start, end = _extend(ids, int(own[i]), q)
                if end - start >= max(least, 2 * q):
                    found.add(start, end, q)
                i = int(np.searchsorted(own, end - q))  # grid points within the stretch
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def numbers(words: list[bytes]):
    import numpy as np

    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]):
    """Which words stay if each run keeps its first period only."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each whole text, and its words without the repeats, joined by one space.

    Words are parted by ASCII white space and compared as they are.  A null or empty text
    has no words, no runs and an empty collapsed text.  Rows with null or repeated ids each
    give a row.  Other columns are not carried.  No shuffle; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            sizes, found, texts = [], [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().split()
                runs = find_runs(numbers(words), least)
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(parts)), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)
