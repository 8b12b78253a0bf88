"""Interaction audit: what every filter removes, alone and behind the others in every order.

Texts are scanned in Arrow's own buffer.  Table lookups class its bytes, prefix sums of
the classes give the counts of each document, and prefix sums of weighted bytes give the
hashes of its words.  Sorted hashes give distinct words; neighbours with equal hashes are
compared byte by byte, and a document with a collision is counted anew from its words.
What filters say of a document is one mask; documents are reduced to counts by part,
mask and labels before orders are applied, so that orders cost nothing by documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, functions as F

from textloom.llm.runtime import stored

#: Bytes that are scanned at once; longer texts are cut between words.
BLOCK = 1 << 20
#: An odd factor of the word hashes, modulo 2^64, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
FIGURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"
#: Filters as SQL over the figures; a document that meets the condition fails.
FILTERS = {"A": "n_words < 50", "B": "100 * n_distinct < 65 * n_words", "C": "100 * n_capitals > 5 * n_points", "D": "n_symbols > 0"}
MOST_FILTERS = 6


class Scanner:
    """Figures of texts that lie one behind the other in a buffer."""

    def __init__(self, symbols: str = "#$%&*|", block: int = BLOCK, hash_mask: int = (1 << 64) - 1):
        import numpy as np

        self.block, self.hash_mask = block, np.uint64(hash_mask)
        self.space, self.capital, self.point, self.symbol = (np.zeros(256, bool) for _ in range(4))
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.capital[65:91] = True
        self.point[:] = (np.arange(256) & 0xC0) != 0x80  # a character's first byte
        self.symbol[list(symbols.encode())] = True
        self._powers = None

    def _weights(self, n: int):
        """Powers of the factor and of its inverse; made once, and again only if a block is longer."""
        import numpy as np

        if self._powers is None or len(self._powers[0]) < n:
            out = []
            for f in (FACTOR, pow(FACTOR, -1, 1 << 64)):
                p = np.full(max(n, 1), f, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self._powers = tuple(out)
        return self._powers

    def words(self, buf, bounds):
        """(first byte, byte behind the last, document, hash) of the words of texts buf[bounds[i] : bounds[i + 1]]."""
        import numpy as np

        solid = ~self.space[buf]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(buf))]
        begins[inner] = solid[inner]  # a text's end ends its last word
        ends[inner - 1] = solid[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = self._weights(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
        code = (sums[end] - sums[start]) * inverse[start]
        code ^= code >> np.uint64(32)
        return start, end, np.searchsorted(bounds, start, "right") - 1, code & self.hash_mask

    def distinct(self, buf, start, end, doc, code, n: int):
        """Distinct words of each of `n` documents, and one place of each word."""
        import numpy as np

        key = code * np.uint64(FACTOR) + doc.astype(np.uint64)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        fits = (doc[a] == doc[b]) & (end[a] - start[a] == end[b] - start[b])
        x, y = a[fits], b[fits]
        length = end[x] - start[x]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differ = np.repeat(np.arange(len(x)), length)[buf[np.repeat(start[x], length) + at] != buf[np.repeat(start[y], length) + at]]
        fits[np.flatnonzero(fits)[differ]] = False
        first = np.ones(len(order), bool)
        first[1:] = ~same
        keep = order[first]
        if not fits.all():  # hashes that meet by chance: these documents anew, word by word
            anew = np.unique(np.concatenate([doc[a[~fits]], doc[b[~fits]]]))
            own: dict[tuple[int, bytes], int] = {}
            for k in np.flatnonzero(np.isin(doc, anew)):
                own.setdefault((int(doc[k]), buf[start[k] : end[k]].tobytes()), int(k))
            keep = np.concatenate([keep[~np.isin(doc[keep], anew)], np.fromiter(own.values(), np.int64, len(own))])
        return np.bincount(doc[keep], minlength=n), keep

    def _counts(self, buf, bounds):
        import numpy as np

        out = []
        for kind in (self.capital, self.point, self.symbol):
            sums = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(kind[buf], out=sums[1:])
            out.append(np.diff(sums[bounds]))
        return out

    def _long(self, buf):
        """A text longer than a block, in blocks cut between words; a word longer than a block makes its own longer."""
        import numpy as np

        counts, n_words, at, held = np.zeros(3, np.int64), 0, 0, []
        while at < len(buf):
            to = min(at + self.block, len(buf))
            while to < len(buf) and not self.space[buf[to]]:
                gap = np.flatnonzero(self.space[buf[to : to + self.block]])
                to = to + int(gap[0]) if len(gap) else min(to + self.block, len(buf))
            part, whole = buf[at:to], np.array([0, to - at])
            counts += np.concatenate(self._counts(part, whole))
            start, end, doc, code = self.words(part, whole)
            n_words += len(start)
            keep = self.distinct(part, start, end, doc, code, 1)[1]
            held.append((start[keep] + at, end[keep] + at, code[keep]))
            at = to
        start, end, code = (np.concatenate(x) for x in zip(*held, strict=True))
        return n_words, int(self.distinct(buf, start, end, np.zeros(len(start), np.int64), code, 1)[0][0]), *counts

    def scan(self, buf, bounds):
        """Figures of each text, one row each."""
        import numpy as np

        n = len(bounds) - 1
        out, at = np.zeros((n, 5), np.int64), 0
        while at < n:
            to = int(np.searchsorted(bounds, bounds[at] + self.block, "right")) - 1
            if to <= at:
                out[at], to = self._long(buf[bounds[at] : bounds[at + 1]]), at + 1
            else:
                part, own = buf[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
                start, end, doc, code = self.words(part, own)
                out[at:to, 0] = np.bincount(doc, minlength=to - at)
                out[at:to, 1] = self.distinct(part, start, end, doc, code, to - at)[0]
                out[at:to, 2:] = np.stack(self._counts(part, own), axis=1)
            at = to
        return out


def text_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", symbols: str = "#$%&*|") -> DataFrame:
    """(id, part, figures, digest) of each row, without a shuffle; the digest is a 128-bit BLAKE2b of the text.

    A null text is empty and has the empty text's digest; a null part is the empty string.
    Rows with null or repeated ids each give a row.  Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        scanner = Scanner(symbols)
        for batch in batches:
            texts = batch.column(2)
            texts = texts.fill_null("") if texts.null_count else texts
            wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
            bounds = bounds - bounds[0]
            figures = scanner.scan(buf, bounds)
            digests = [blake2b(buf[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(0), batch.column(1), *[pa.array(figures[:, k]) for k in range(5)], pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", *[c.split()[0] for c in FIGURES.split(", ")], "digest"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, {FIGURES}, digest binary")


def _reports(letters: str):
    """A part's rows (one a mask and labels) as the rows of all orders and steps."""
    orders = ["".join(p) for p in permutations(letters)]

    def run(table):
        import numpy as np
        import pyarrow as pa

        own = {c: table.column(c).to_numpy() for c in ("mask", "good", "toxic", "n")}
        fails = (own["mask"][:, None] >> np.arange(len(letters))) & 1 == 1
        n = own["n"]
        found, total = [], {c: 0 for c in letters}
        for order in orders:
            gone = np.zeros(len(n), bool)
            for step, c in enumerate(order):
                k = letters.index(c)
                here = fails[:, k] & ~gone
                alone = fails[:, k] & (fails.sum(1) == 1)
                removed = int(n[here].sum())
                total[c] += removed
                redundant = int(n[fails[:, k] & gone].sum())
                gone |= fails[:, k]
                found.append((order, step + 1, int(n[~gone].sum()), removed, redundant, int(n[alone].sum()), int(n[here & own["good"]].sum()), int(n[here & own["toxic"]].sum())))
        names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
        out = {"part": pa.array([table.column("part")[0].as_py()] * len(found), pa.string())} | {c: pa.array(list(v)) for c, v in zip(names, zip(*found, strict=True), strict=True)}
        out["step"] = out["step"].cast(pa.int32())
        out["shapley"] = pa.array([total[r[0][r[1] - 1]] for r in found], pa.int64())
        return pa.table(out)

    return run


def filter_audit(
    docs: DataFrame, labels: DataFrame | None = None, filters: dict[str, str] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", symbols: str = "#$%&*|"
) -> DataFrame:
    """One row for each part, order of the filters and step, as counts of documents of the part.

    `filters` names conditions over the figures (one letter each); with `copies` that letter
    fails every row whose text a smaller id has in the whole table.  `labels` is (id, good,
    toxic) as booleans; ids that it has several times have a label if any of their rows does.
    shapley is what the step's filter removes, summed over all orders.

    A null text is empty, a null part is the empty part.  A row with a null id is a copy of
    none, makes none a copy, and has no label.  Rows with the same id and text are copies of
    smaller ids only.  An empty table gives no rows.  Other columns do not matter.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(sorted([*filters, *([copies] if copies else [])]))
    if len(set(letters)) != len(filters) + bool(copies) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters need different letters, {MOST_FILTERS} at most ({factorial(MOST_FILTERS)} orders)")
    bits = [F.when(F.expr(e), F.lit(1 << letters.index(c))).otherwise(0) for c, e in filters.items()]
    rows = text_figures(docs, id_col, text_col, part_col, symbols).select("id", "part", "digest", sum(bits, F.lit(0)).alias("mask"))
    if labels is None:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        own = labels.select(F.col(labels.columns[0]).alias("of"), F.col(labels.columns[1]).alias("good"), F.col(labels.columns[2]).alias("toxic"))
        own = own.groupBy("of").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
        rows = rows.join(own, F.col("id") == F.col("of"), "left").select("id", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    cell = ["digest", "part", "mask", "good", "toxic"]
    # Copies by the million become one row a part and label before their text's smallest id is asked for.
    by_id = rows.groupBy(*cell, "id").agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    groups = by_id.groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("id", "n"))).alias("low"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"))
    if copies:
        groups = stored(groups, "audit-groups")
        first = groups.groupBy(F.col("digest").alias("text")).agg(F.min("low.id").alias("first"))
        joined = groups.join(first, F.col("digest") == F.col("text"))
        own = F.col("unknown") + F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0)
        bit = 1 << letters.index(copies)
        split = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - own).alias("n")))
        groups = joined.select("part", "good", "toxic", F.inline(split))
    counts = groups.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInArrow(_reports(letters), schema)
