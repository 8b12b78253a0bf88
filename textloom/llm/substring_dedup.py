"""Substring dedup by seed and extend.

A window of `size` words picks as its anchor the five-word sequence in it with the
smallest hash (winnowing), so equal windows pick equal anchors at equal places.  Seeds
are anchors that occur at least twice; they join the documents that hold them.  A seed is
extended to both sides over the words of all windows that picked it: its reach.

Occurrences of one anchor whose reaches are equal match over all of it: they form a
class, and each is matched with the class's first occurrence.  Where an anchor has several
classes, their first occurrences are extended step by step instead: window for window to
the left and right of the anchor, each matched with the first occurrence of the same
window.  So every match is with an earlier place, and no pairs are listed within a group
of copies.  Matches of one document with one other on one diagonal that meet or overlap
are one maximal repeat.  Equality is that of 64-bit hashes of word sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.runtime import stored

ANCHOR_WORDS = 5
#: A seed's row holds its windows, and the words before it, in 12 bits each.
MOST_WORDS = 2_000
#: Low bits of an anchor's rank that hold its place, so that of equal hashes the leftmost wins.
PLACE = (1 << 28) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: Powers of the hash's base and of its inverse modulo 2**64, as far as documents have needed them.
_powers: dict[int, object] = {}


def _power(base: int, n: int):
    """base**0 ... base**(n-1) modulo 2**64, at least."""
    import numpy as np

    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have


class WordHashes:
    """Hashes of any range of a document's words from sums over its prefixes."""

    def __init__(self, words: list[bytes]):
        import numpy as np
        from xxhash import xxh64_intdigest

        n = len(words)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(BASE, n)[:n], out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)
        self.n = n

    def of(self, start, end):
        """Hashes of words[start:end], for arrays of bounds."""
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def grams(self, k: int):
        """Hashes of all sequences of `k` words."""
        return (self.sums[k:] - self.sums[:-k]) * self.back[: self.n - k + 1]


def find_anchors(hashes: WordHashes, size: int):
    """(anchor hashes, place, first window, windows): each anchor occurrence and the run of windows that picked it."""
    import numpy as np

    n, k = hashes.n, min(ANCHOR_WORDS, size)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = hashes.grams(k)
    mixed = grams ^ (grams >> np.uint64(31))
    mixed = mixed * np.uint64(0x94D049BB133111EB)
    rank = ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(~PLACE & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64)
    width, span = size - k + 1, 1
    while 2 * span <= width:
        rank = np.minimum(rank[:-span], rank[span:])
        span *= 2
    if span < width:
        rank = np.minimum(rank[: -(width - span)], rank[width - span :])
    place = (rank & np.uint64(PLACE)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    windows = np.diff(np.append(first, len(place)))
    return grams[place[first]].view(np.int64), place[first], first, windows


def _seeds(size: int, kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, cols = [], [[], [], []]
            for i, t in enumerate(batch.column(1)):
                words = (t.as_py() or "").encode().split()
                if len(words) < size:
                    continue
                hashes = WordHashes(words)
                anchor, place, first, windows = find_anchors(hashes, size)
                reach = hashes.of(first, first + windows - 1 + size).view(np.int64)
                spot = (place << 24) | ((place - first) << 12) | windows
                rows.append(np.full(len(anchor), i))
                for c, v in zip(cols, (anchor, reach, spot), strict=True):
                    c.append(v)
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c)) for c in cols]], names=["id", "anchor", "reach", "spot"])

    return run, f"id {kind}, anchor long, reach long, spot long"


def _windows(size: int, kind: str):
    """Extend representatives: a row for each window that picked one of the anchors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, (blob, spots) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                hashes = WordHashes(_unpack(blob).split())
                anchor, place, first, windows = find_anchors(hashes, size)
                wanted = np.unique(np.stack([spots.values.field("place").to_numpy(), spots.values.field("anchor").to_numpy()]), axis=1)
                # Of versions that share an id, only that with this anchor at this place is meant.
                picked = np.minimum(np.searchsorted(place, wanted[0]), max(len(place) - 1, 0))
                picked = picked[(place[picked] == wanted[0]) & (anchor[picked] == wanted[1])] if len(place) else picked[:0]
                if not len(picked):
                    continue
                j = np.repeat(picked, windows[picked])
                start = first[j] + np.arange(len(j)) - np.repeat(np.cumsum(windows[picked]) - windows[picked], windows[picked])
                ids = batch.column(0).take(pa.array(np.full(len(j), i)))
                out = [anchor[j], hashes.of(start, start + size).view(np.int64), place[j] - start, start]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], names=["id", "anchor", "window", "back", "start"])

    return run, f"id {kind}, anchor long, window long, back long, start long"


def _pack(batches):
    """Texts as zstd frames: what a join moves of them is less."""
    import pyarrow as pa
    import zstandard

    own = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [own.compress((t.as_py() or "").encode()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "blob"])


def _unpack(blob) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob.as_py())


def _removal(kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            counts, removed, kept = [], [], []
            for blob, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words = _unpack(blob).split()
                edge = np.zeros(len(words) + 1, np.int64)
                if ranges.is_valid:
                    bounds = ranges.values
                    np.add.at(edge, np.minimum(bounds.field("start").to_numpy(), len(words)), 1)
                    np.add.at(edge, np.minimum(bounds.field("end").to_numpy(), len(words)), -1)
                stays = np.cumsum(edge[:-1]) == 0
                left = [w for w, s in zip(words, stays.tolist(), strict=True) if s] if not stays.all() else words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return run, f"id {kind}, n_words long, n_removed long, kept_text string"


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Return (id, start, end, source_id, source_start): word ranges that are found earlier in the corpus, at the source.

    Every window of `size` words that starts earlier as well lies in one of them.
    """
    if not 0 < size <= MOST_WORDS:
        raise ValueError(f"windows have 1 to {MOST_WORDS} words, not {size}")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")
    found = base.mapInArrow(*_seeds(size, kind))
    # What is joined with is written first: a join of plain shuffles is one that Spark splits where very many rows share an anchor.
    again = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    seeds = stored(found.join(again, "anchor"), "seeds")

    place = F.shiftright("spot", 24)
    key = ["anchor", "reach", "lead"]  # lead: places of the anchor in its reach, and how many windows
    seeds = seeds.select("id", "anchor", "reach", F.col("spot").bitwiseAND((1 << 24) - 1).alias("lead"), place.alias("place"))
    classes = stored(seeds.groupBy(*key).agg(F.min(F.struct("id", "place")).alias("first")), "classes")
    before = F.shiftright("lead", 12)
    windows = F.col("lead").bitwiseAND(4095)
    copies = seeds.join(classes, key).filter("not (id = first.id and place = first.place)")
    whole = copies.select("id", (F.col("place") - before).alias("start"), (F.col("place") - before + windows - 1 + size).alias("end"), F.col("first.id").alias("source_id"), (F.col("first.place") - before).alias("source_start"))

    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "several")
    heads = classes.join(several, "anchor").select(F.col("first.id").alias("id"), F.struct(F.col("first.place").alias("place"), "anchor").alias("spot"))
    heads = heads.groupBy("id").agg(F.collect_list("spot").alias("spots"))
    texts = base.mapInArrow(_pack, f"id {kind}, blob binary")
    extended = stored(texts.join(heads, "id").select("id", "blob", "spots").mapInArrow(*_windows(size, kind)), "windows")
    window = ["anchor", "window", "back"]
    first = extended.groupBy(*window).agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = extended.join(stored(first, "first-windows"), window).filter("not (id = first.id and start = first.start)")
    return whole.unionByName(later.select("id", "start", (F.col("start") + size).alias("end"), F.col("first.id").alias("source_id"), F.col("first.start").alias("source_start")))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Return (id, start, end, source_id, source_start): matches that meet or overlap on one diagonal, as one repeat of at least `size` words."""
    found = matches(docs, id_col, text_col, size).repartition("id")
    diagonal = ["id", "source_id", "shift"]
    w = Window.partitionBy(*diagonal).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("shift", F.col("source_start") - F.col("start")).withColumn("begins", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*diagonal, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end", "source_id", (F.col("start") + F.col("shift")).alias("source_start"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Return (id, n_words, n_removed, kept_text): texts without words that repeat in windows of `size` words.

    A word goes if a window over it has a word sequence that also starts earlier: in a
    smaller id, or earlier in the same document.  Kept words are joined by one space.

    A null text has no words.  A row with a null id takes no part and keeps all words.
    Rows that share an id are versions of one document: at equal starts they do not
    count as earlier, and a place that goes in one of them goes in all.  Other columns
    are not carried.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = maximal_repeats(docs, id_col, text_col, size).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_pack, f"id {kind}, blob binary")
    out = texts.join(ranges, "id", "left").select("id", "blob", "ranges").mapInArrow(*_removal(kind))
    return out.withColumnRenamed("id", id_col)
