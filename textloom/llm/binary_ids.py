"""Token ids as Re-Pair grammars in binary shards.

Documents are dealt by ranges of their ids and sorted, encoded, and gathered into shards
of about `shard_ids` ids.  In each shard frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again, until no pair occurs twice or the symbols run
out.  A shard is a table of rows: first its grammar, then one row for each document, in
order.  So one document is read from storage by its id and its shard's grammar alone, and
expansion lengths lead to any token of it without expanding the rest.

Bytes are little-endian.  Grammar: magic "RPR2", vocabulary u32, end id u32, rules u32;
rules as pairs of u16; expansion lengths u32.  Document: symbols u16.  Symbols below the
vocabulary are ids, the vocabulary itself is a document's end, larger ones are rules.
The rows are a Parquet table, so that Spark's commit protocol and any store that Spark
writes serve them.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from textloom.llm.bpe import encoder
from textloom.llm.runtime import partitions

MAGIC = b"RPR2"
#: Symbols are 16 bits wide: the bound of a grammar's size.
SYMBOLS = 1 << 16
#: Buckets that pairs are counted in before they are sorted.
BUCKETS = 18
FORMAT = "part int, shard int, row int, doc_id long, before long, n_ids long, data binary"


def _live(s, barrier: int):
    """(code of the pair at each place, whether it may be replaced): no pair holds `barrier`, and in a run of one symbol every second place counts."""
    import numpy as np

    code = (s[:-1] << np.uint32(16)) | s[1:]
    live = s != barrier
    live = live[:-1] & live[1:]
    twin = np.flatnonzero(code[1:] == code[:-1]) + 1
    if len(twin):
        # Twins are places whose pair is that of the place before; in each stretch of them the first, third and so on go.
        number = np.arange(len(twin))
        fresh = np.concatenate(([True], np.diff(twin) != 1))
        live[twin[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]] = False
    return code, live


def _ranked(code, live, least: int):
    """(counts, codes, places, group of each place) of pairs with at least `least` live places, the most frequent first; equal ones by code."""
    import numpy as np

    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS)).astype(np.int32)
    held = np.bincount(bucket[live], minlength=1 << BUCKETS)
    some = np.flatnonzero(live & (held >= least)[bucket])
    keyed = np.sort((code[some].astype(np.uint64) << np.uint64(32)) | some.astype(np.uint64))
    codes, places = (keyed >> np.uint64(32)).astype(np.uint32), (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(codes)))
    good = np.flatnonzero(counts >= least)
    good = good[np.argsort(-counts[good], kind="stable")]
    n = counts[good]
    at = np.repeat(starts[good] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return n, codes[starts[good]], places[at], np.repeat(np.arange(len(good)), n)


def repair(ids, vocabulary: int, barrier: int):
    """(symbols, rules): replace frequent pairs by nonterminals from `vocabulary` on.

    A round takes the pairs that are at least half as frequent as the most frequent one
    may be; where two of them overlap, the more frequent one is replaced.  The next round
    counts anew and takes pairs half as frequent, down to pairs that occur twice, until
    there are none or no symbol is left.  No pair holds `barrier`, so no rule spans two
    documents.
    """
    import numpy as np

    if vocabulary >= SYMBOLS:
        raise ValueError(f"a vocabulary of {vocabulary} leaves no 16-bit symbols for rules")
    s = np.array(ids, dtype=np.uint32)
    rules: list[np.ndarray] = []
    top, least = vocabulary, None
    while top < SYMBOLS and len(s) > 1:
        code, live = _live(s, barrier)
        if least is None:
            held = np.bincount(((code[live] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS)).astype(np.int32), minlength=1)
            least = max(2, int(held.max(initial=0)) // 2)
        counts, codes, places, group = _ranked(code, live, least)
        if len(counts):
            # A place is taken if its pair ranks before the pairs of both neighbouring places.
            rank = np.full(len(s) + 1, len(counts), np.int64)
            rank[places + 1] = group
            won = (group < rank[places]) & (group < rank[places + 2]) if len(places) else np.zeros(0, bool)
            enough = np.bincount(group[won], minlength=len(counts)) >= 2
            chosen = np.flatnonzero(enough)[: SYMBOLS - top]
            name = np.zeros(len(counts), np.uint32)
            name[chosen] = np.arange(top, top + len(chosen), dtype=np.uint32)
            won &= name[group] > 0
            places, group = places[won], group[won]
            s[places] = name[group]
            keep = np.ones(len(s), bool)
            keep[places + 1] = False
            s = s[keep]
            rules.append(codes[chosen])
            top += len(chosen)
        elif least == 2:
            break
        least = max(2, least // 2)
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return s.astype(np.uint16), np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], axis=1).astype(np.uint16)


def write_shard(ids, vocabulary: int, end_id: int) -> tuple[bytes, list[bytes]]:
    """(grammar, documents) of ids in which each document ends with the mark `vocabulary`, which stands for `end_id`.

    All other ids must be below `vocabulary`.
    """
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) > vocabulary:
        raise ValueError(f"id {int(ids.max())} is not in a vocabulary of {vocabulary}")
    if len(ids) and ids[-1] != vocabulary:
        raise ValueError("the last document has no end")
    symbols, rules = repair(ids, vocabulary + 1, vocabulary)
    lengths = [1] * (vocabulary + 1)
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    raw = symbols.astype("<u2").tobytes()
    ends = [0, *(2 * (np.flatnonzero(symbols == vocabulary) + 1)).tolist()]
    head = MAGIC + struct.pack("<3I", vocabulary, end_id, len(rules))
    return head + rules.astype("<u2").tobytes() + np.array(lengths[vocabulary + 1 :], "<u4").tobytes(), [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Grammar:
    """A shard's rules: expands documents, or finds single tokens in them."""

    def __init__(self, data):
        import numpy as np

        data = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a grammar")
        self.vocabulary, self.end_id, n_rules = struct.unpack_from("<3I", data, 4)
        self.rules = np.frombuffer(data, "<u2", 2 * n_rules, 16).reshape(-1, 2)
        self.lengths = np.ones(self.vocabulary + 1 + n_rules, np.int64)
        self.lengths[self.vocabulary + 1 :] = np.frombuffer(data, "<u4", n_rules, 16 + 4 * n_rules)

    @cached_property
    def _pool(self):
        """(expansions of all symbols one after the other, where each begins): rules only name earlier symbols."""
        import numpy as np

        base = self.vocabulary + 1
        where = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), "<u4")
        flat[:base] = np.arange(base, dtype=np.uint32)
        flat[self.vocabulary] = self.end_id
        spans = list(zip(where.tolist(), (where + self.lengths).tolist(), strict=True))
        for (at, end), (a, b) in zip(spans[base:], self.rules.tolist(), strict=True):
            (a0, a1), (b0, b1) = spans[a], spans[b]
            flat[at : at + a1 - a0] = flat[a0:a1]
            flat[end - b1 + b0 : end] = flat[b0:b1]
        return flat, where

    def ids(self, document):
        """All ids of documents' bytes, with the end ids."""
        import numpy as np

        s = np.frombuffer(document, "<u2")
        flat, where = self._pool
        n = self.lengths[s]
        ends = np.cumsum(n)
        return flat[np.repeat(where[s] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def token(self, document, position: int) -> int:
        """One id of a document's bytes, by going down the rules with expansion lengths."""
        import numpy as np

        s = np.frombuffer(document, "<u2")
        ends = np.cumsum(self.lengths[s])
        k = int(np.searchsorted(ends, position, side="right"))
        x, at = int(s[k]), position - int(ends[k] - self.lengths[s[k]])
        while x > self.vocabulary:
            a, b = self.rules[x - self.vocabulary - 1].tolist()
            x, at = (a, at) if at < self.lengths[a] else (b, at - int(self.lengths[a]))
        return self.end_id if x == self.vocabulary else x


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents as shards, in ascending order of `id_col`.

    A null text is empty (the end id alone).  A null id comes first.  Rows that share an
    id follow each other by their texts.  Other columns are not carried.  Without rows
    an empty table is written.  A document longer than `shard_ids` is a shard of its own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own = encoder(tokenizer)
        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held, names, counts = [], [], []
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

        def shard():
            nonlocal number, before
            grammar, documents = write_shard(np.concatenate(held), own.vocabulary, end_id)
            n = len(documents) + 1
            sizes = np.array([0, *counts], np.int64)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([None, *names], pa.int64()), pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([grammar, *documents], pa.binary())]
            number, before = number + 1, before + int(sizes.sum())
            for c in (held, names, counts):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        end = np.array([own.vocabulary], np.uint32)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, ids, n in own.chunks(batch.column(1)):
                ends = np.cumsum(n).tolist()
                for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if size and size + b - a + 1 > shard_ids:
                        yield shard()
                        size = 0
                    held += [ids[a:b], end]
                    names.append(ids_of[first + k])
                    counts.append(b - a + 1)
                    size += b - a + 1
        if size:
            yield shard()

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "id", F.xxhash64("text"))
    dealt.sortWithinPartitions("id", F.xxhash64("text"), "text").mapInArrow(run, FORMAT).write.parquet(path)


def _decode(base: dict[int, int], with_ids: bool):
    """Expand documents' rows, which follow their shard's grammar."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        grammar = None
        for batch in batches:
            at = 0
            rows, data = batch.column(2).to_numpy(), batch.column(6)
            while at < len(rows):
                if rows[at] == 0:
                    grammar = Grammar(data[at].as_buffer())
                    at += 1
                    continue
                end = at + int(np.argmax(np.append(rows[at:], 0) == 0))  # documents up to the next grammar
                some, names = data.slice(at, end - at), batch.column(3).slice(at, end - at)
                n = batch.column(5).slice(at, end - at).to_numpy()
                ids = grammar.ids(b"".join(some.to_pylist()))
                ends = np.cumsum(n)
                if len(ids) != ends[-1]:
                    raise ValueError("a document's expansion has another length than was stored")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                start = batch.column(4).slice(at, end - at).to_numpy() + np.array([base[p] for p in batch.column(0).slice(at, end - at).to_pylist()])
                out = [names, pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                at = end

    return run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids


def read_shards(spark, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Return (id, start, n_tokens, ids_crc32) and, by default, ids of each document from the shards.

    Shards are dealt to tasks whole, their grammar first.  What comes before a part is
    summed on the driver from one row for each part, of which there are as many as shuffle
    partitions, however large the table.
    """
    rows = spark.read.schema(FORMAT).parquet(path)
    sums = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n
    dealt = rows.repartition("part", "shard").sortWithinPartitions("part", "shard", "row")
    return dealt.mapInArrow(*_decode(base, with_ids)).withColumnRenamed("id", id_col)


def read_documents(spark, path: str, ids: list[int]) -> dict[int, list[list[int]]]:
    """{id: ids of each document with it}: only rows of these documents and their shards' grammars are asked of storage."""
    rows = spark.read.schema(FORMAT).parquet(path)
    found = rows.filter((F.col("row") > 0) & F.col("doc_id").isin(ids)).select("part", "shard", "doc_id", "data").collect()
    out: dict[int, list[list[int]]] = {}
    for part, shard in sorted({(r.part, r.shard) for r in found}):
        grammar = Grammar(rows.filter(f"part = {part} and shard = {shard} and row = 0").first().data)
        for r in found:
            if (r.part, r.shard) == (part, shard):
                out.setdefault(r.doc_id, []).append(grammar.ids(r.data).tolist())
    return out
