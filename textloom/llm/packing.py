"""Best-fit packing of token pieces, improved by swap-based local search.

Documents become pieces of at most one sequence.  Pieces are dealt to groups by a hash;
each group is packed best-fit, largest first, and then a local search empties bins: it
moves a piece, exchanges one for one, two for one or one for two between underfull bins
wherever that raises the sum of squared fills.  A group holds tens of thousands of small
pieces, so groups cost at most about one open bin each.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from textloom.llm.bpe import ID_BYTES, encoder
from textloom.llm.runtime import stored

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than `size`."""
    first = total % size or size
    return [(0, min(first, total))] + [(at, size) for at in range(first, total, size)] if total else []


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, piece, start, length, ids_crc32): each document's ids and the end id, cut to `size`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for first, ids, counts in own.chunks(batch.column(1)):
                at, out, ends = [], [[], [], [], []], np.cumsum(counts).tolist()
                for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    own_ids = memoryview(np.concatenate((ids[a:b], end))).cast("B")
                    for n, (start, length) in enumerate(cut(b - a + 1, size)):
                        at.append(first + k)
                        for column, v in zip(out, (n, start, length, zlib.crc32(own_ids[start * ID_BYTES : (start + length) * ID_BYTES])), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECE}")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into `sizes`: largest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = 0  # bit r: a bin with room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= s
        else:
            b, room = len(bins), capacity - s
            bins.append([i])
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills.

    A source gives one or two pieces to a target, which gives none, one or two back
    (three pieces at most change places).  Of all targets the change with the largest
    gain is made.  The emptiest bins are sources first; passes over all underfull bins go
    on until one changes nothing, or the bins are as few as the tokens allow.  As the sum
    grows with each change, this ends.

    Pieces of one size are alike, so a bin of `capacity` tokens has few distinct
    options, whatever the number of its pieces; options of all bins are in arrays, so a
    source is held against all of them at once.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        import numpy as np

        self._np, self.capacity = np, capacity
        self.total = sum(sizes)
        self._sizes = sizes
        self.bins: list[dict[int, list[int]]] = []  # by size, the pieces of each bin
        for b in bins:
            held: dict[int, list[int]] = {}
            for i in b:
                held.setdefault(sizes[i], []).append(i)
            self.bins.append(held)
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self._of = np.zeros(0, np.int64)
        self._weight, self._count, self._pair = (np.zeros(0, np.int64) for _ in range(3))
        self._add([b for b in range(len(bins)) if 0 < self.fill[b] < capacity])

    def least(self) -> int:
        return -(-self.total // self.capacity)

    def _options(self, b: int) -> list[tuple[int, int, int]]:
        """(weight, pieces, sizes as one number) of what a bin may give: nothing, one piece, or two; one way for each weight and count."""
        held = sorted(self.bins[b])
        out = {(0, 0): 0}
        for k, x in enumerate(held):
            out[(x, 1)] = x
            for y in held[k if len(self.bins[b][x]) > 1 else k + 1 :]:
                out.setdefault((x + y, 2), x << 32 | y)
        return [(w, n, pair) for (w, n), pair in out.items()]

    def _add(self, bins: list[int]) -> None:
        np = self._np
        rows = [(b, *o) for b in bins if self.bins[b] and self.fill[b] < self.capacity for o in self._options(b)]
        of, weight, count, pair = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))
        self._of, self._weight = np.append(self._of, of), np.append(self._weight, weight)
        self._count, self._pair = np.append(self._count, count), np.append(self._pair, pair)

    def _take(self, b: int, pair: int) -> list[int]:
        """Pieces of the sizes that `pair` names leave bin b."""
        out = []
        for x in (pair >> 32, pair & 0xFFFFFFFF):
            if x:
                out.append(self.bins[b][x].pop())
                if not self.bins[b][x]:
                    del self.bins[b][x]
        return out

    def _change(self, a: int) -> bool:
        """Make the change from source `a` that gains most, if any gains."""
        np = self._np
        fill = self.fill[self._of]
        room, lead = self.capacity - fill, fill - self.fill[a]
        other = self._of != a
        best, how = 0, None
        for weight, count, pair in self._options(a):
            if not count:
                continue
            shift = weight - self._weight
            ok = other & (shift > 0) & (shift <= room) & (self._count <= 3 - count)
            gain = np.where(ok, shift * (lead + shift), 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best:
                best, how = gain[k], (pair, k, weight - int(self._weight[k]))
        if how is None:
            return False
        pair, k, shift = how
        b = int(self._of[k])
        given, back = self._take(a, pair), self._take(b, int(self._pair[k]))
        for to, pieces in ((a, back), (b, given)):
            for i in pieces:
                self.bins[to].setdefault(self._sizes[i], []).append(i)
        self.fill[a] -= shift
        self.fill[b] += shift
        live = (self._of != a) & (self._of != b)
        self._of, self._weight, self._count, self._pair = (c[live] for c in (self._of, self._weight, self._count, self._pair))
        self._add([a, b])
        return True

    def run(self) -> list[list[int]]:
        np, few = self._np, self.least()
        changed = True
        while changed and int((self.fill > 0).sum()) > few:
            changed = False
            for a in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[a] < self.capacity and self._change(a):
                    changed = True
                if int((self.fill > 0).sum()) <= few:
                    break
        return [[i for pieces in b.values() for i in pieces] for b in self.bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    bins = best_fit(sizes, capacity)
    if len(bins) <= -(-sum(sizes) // capacity):
        return bins
    return LocalSearch(sizes, bins, capacity).run()


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 16_384) -> DataFrame:
    """Return (id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A null text is empty: one piece, the end id alone.  Rows with null or repeated ids
    are documents of their own.  Other columns are not carried.  An empty table gives an
    empty result.  The local search of a group of about `group_pieces` pieces ends where no
    change gains, or where its bins are as few as its tokens allow.
    """
    rows = stored(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    kind = rows.schema["id"].dataType.simpleString()

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("length", "ascending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, own in enumerate(pack(sizes, size)):
            at = 0
            for i in own:
                sequence[i], offset[i] = (group << 32) + n, at
                at += sizes[i]
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)).cast("long"))
    packed = dealt.groupBy("group").applyInArrow(run, f"id {kind}, {PIECE}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
