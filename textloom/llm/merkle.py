"""Merkle fingerprints of documents.

Paragraphs are lines; their clauses are the leaves, and long clauses are cut where a hash
of the last bytes says so, so that an edit moves no cut elsewhere.  Paragraph nodes stand
over clauses, section nodes over runs of paragraphs that end where a node's hash says so,
and further sections over sections up to one top node.  Equal roots mean equal texts; a
comparison goes down differing branches only and ends at the leaves that were edited.

A fingerprint is the root and, behind a point, the leaves (hash, length, whether a
paragraph ends there): the branches follow from them.  So fingerprints alone tell how
alike two texts are, and where they differ.
"""

from __future__ import annotations

import base64
import struct
from functools import cache

from pyspark.sql import DataFrame, functions as F

from textloom.llm.runtime import partitions

#: A clause longer than this many bytes is cut further.
LEAF_BYTES = 64
#: No leaf is longer than this: clauses that the hash does not cut, as it never falls well in them, are cut from their start on.
MOST_BYTES = 256
#: A section ends at a node with a chance of one in this many.
FAN = 8
#: Bytes of a leaf's hash in a fingerprint, and of its length.
HASH_BYTES, LENGTH_BYTES = 6, 3
_END = 1 << (8 * LENGTH_BYTES - 1)


@cache
def _clause_end():
    """A table over bytes: marks behind which a space ends a clause."""
    import numpy as np

    out = np.zeros(256, bool)
    out[list(b".!?;,:")] = True
    return out


def leaf_ends(data: bytes):
    """Where leaves end, in order, and whether a paragraph ends there."""
    import numpy as np

    if not data:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    b = np.frombuffer(data, np.uint8)
    line = b == 10
    cut = line.copy()
    cut[1:] |= (b[1:] == 32) & _clause_end()[b[:-1]]
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(ends, prepend=0)
    if len(b) > LEAF_BYTES and int(sizes.max()) > LEAF_BYTES:
        window = b[3:].astype(np.uint32) | b[2:-1].astype(np.uint32) << 8 | b[1:-2].astype(np.uint32) << 16 | b[:-3].astype(np.uint32) << 24
        # One place in 32, but not within runs of one byte.
        some = np.flatnonzero(((window * np.uint32(0x9E3779B1)) >> np.uint32(27) == 0) & (window != b[3:].astype(np.uint32) * np.uint32(0x01010101))) + 4
        some = some[sizes[np.minimum(np.searchsorted(ends, some), len(ends) - 1)] > LEAF_BYTES]
        ends = np.union1d(ends, some)
        if int(np.diff(ends, prepend=0).max()) > MOST_BYTES:
            starts = np.append(0, ends[:-1])
            ends = np.union1d(ends, np.concatenate([np.arange(s + MOST_BYTES, e, MOST_BYTES) for s, e in zip(starts, ends, strict=True) if e - s > MOST_BYTES]))
    last = line[ends - 1]
    last[-1] = True
    return ends, last


class Tree:
    """hashes[0] are leaves, hashes[1] paragraphs, further levels sections up to one node; weights are bytes of text."""

    def __init__(self, leaves: list[bytes], weights: list[int], ends: list[bool], root: bytes):
        from hashlib import blake2b

        self.root, self._ends = root, ends
        self.hashes, self.weights = [leaves], [weights]
        #: spans[k]: which nodes of level k each node of level k + 1 is over.
        self.spans: list[list[tuple[int, int]]] = []
        cuts = [i + 1 for i, e in enumerate(ends) if e]
        while leaves and (not self.spans or len(self.hashes[-1]) > 1):
            below, heavy = self.hashes[-1], self.weights[-1]
            if self.spans:
                cuts = [*[i + 1 for i, h in enumerate(below[:-1]) if h[0] % FAN == 0], len(below)]
                if len(cuts) == len(below):
                    cuts = [len(below)]
            spans = list(zip([0, *cuts[:-1]], cuts, strict=True))
            self.spans.append(spans)
            self.hashes.append([blake2b(b"".join(below[a:b]), digest_size=16).digest() for a, b in spans])
            self.weights.append([sum(heavy[a:b]) for a, b in spans])

    @classmethod
    def of(cls, text: str | None) -> Tree:
        """The tree of a text; its root binds the top node, the text and its length."""
        from hashlib import blake2b

        data = (text or "").encode("utf-8", "surrogatepass")
        ends, last = leaf_ends(data)
        cuts = ends.tolist()
        parts = [data[a:b] for a, b in zip([0, *cuts], cuts)]
        tree = cls([blake2b(x, digest_size=HASH_BYTES).digest() for x in parts], [len(x) for x in parts], last.tolist(), b"")
        top = tree.hashes[-1][0] if parts else b""
        tree.root = blake2b(top + struct.pack("<Q", len(data)) + blake2b(data, digest_size=16).digest(), digest_size=16).digest()
        return tree

    def fingerprint(self) -> str:
        rows = [h + (w | _END * e).to_bytes(LENGTH_BYTES, "little") for h, w, e in zip(self.hashes[0], self.weights[0], self._ends, strict=True)]
        return self.root.hex() + "." + base64.b64encode(b"".join(rows)).decode()

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        """The tree of a fingerprint."""
        root, _, rest = fingerprint.partition(".")
        data, step = base64.b64decode(rest), HASH_BYTES + LENGTH_BYTES
        marks = [int.from_bytes(data[i + HASH_BYTES : i + step], "little") for i in range(0, len(data), step)]
        return cls([data[i : i + HASH_BYTES] for i in range(0, len(data), step)], [m & (_END - 1) for m in marks], [m >= _END for m in marks], bytes.fromhex(root))


def compare(a: Tree, b: Tree) -> tuple[float, list[int], list[int]]:
    """(likeness, leaves of `a` below differing branches, leaves of `b` below them).

    From the top down, branches that both trees have (as often as both have them, at any
    place of the level) count with all their bytes and are not entered; the others are.
    Likeness is what they count by the larger text's bytes; 1 for equal roots.
    """
    if a.root == b.root:
        return 1.0, [], []
    from collections import Counter

    most = max(sum(a.weights[0]), sum(b.weights[0]))
    shared, open_a, open_b = 0, [], []
    for level in range(max(len(a.hashes), len(b.hashes)) - 1, -1, -1):
        open_a, open_b = (list(range(len(t.hashes[level]))) if level == len(t.hashes) - 1 else at for t, at in ((a, open_a), (b, open_b)))
        if open_a and open_b:
            mine, theirs = ([t.hashes[level][i] for i in at] for t, at in ((a, open_a), (b, open_b)))
            both = Counter(mine) & Counter(theirs)
            if both:
                left = {}
                for which, (t, at, found) in enumerate(((a, open_a, mine), (b, open_b, theirs))):
                    budget, rest = Counter(both), []
                    for i, h in zip(at, found, strict=True):
                        if budget[h]:
                            budget[h] -= 1
                            shared += t.weights[level][i] * (which == 0)
                        else:
                            rest.append(i)
                    left[which] = rest
                open_a, open_b = left[0], left[1]
        if level:
            open_a, open_b = ([j for i in at for j in range(*t.spans[level - 1][i])] if level < len(t.hashes) else at for t, at in ((a, open_a), (b, open_b)))
    return (min(1.0, shared / most) if most else 0.0), open_a, open_b


def likeness(one: str, other: str) -> float:
    """How alike the texts of two fingerprints are, from 0 to 1."""
    return compare(Tree.parse(one), Tree.parse(other))[0]


def edited(text: str, following: str) -> str:
    """`text` with its last quarter (rounded down) replaced by as many characters from the start of `following`, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def merkle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, fingerprint, root, n_leaves, n_paragraphs) of each row.

    A null text is empty: a tree without leaves.  Rows with null or repeated ids each
    give a row.  Other columns are not carried.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            trees = [Tree.of(t.as_py()) for t in batch.column(1)]
            out = [pa.array([t.fingerprint() for t in trees]), pa.array([t.root.hex() for t in trees])]
            out += [pa.array([len(t.hashes[k]) if k < len(t.hashes) else 0 for t in trees], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["id", "fingerprint", "root", "n_leaves", "n_paragraphs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string, root string, n_leaves long, n_paragraphs long").withColumnRenamed("id", id_col)


REPORT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_at long"


def _compare(text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    from hashlib import sha256

    new = edited(text, following)
    new_tree = Tree.of(new)
    near, places, _ = compare(tree, new_tree)
    at = None if tree.root == new_tree.root else sum(tree.weights[0][: places[0]]) if places else sum(tree.weights[0])
    return (len(text), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), tree.fingerprint(), new_tree.fingerprint(), near, compare(tree, next_tree)[0], at)


def _neighbours(batches):
    """Compare neighbours of one bucket, in order; a guest is only a next document."""
    import pyarrow as pa

    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in REPORT.split(", ")]
    held = None
    for b in batches:
        out = []
        for bucket, doc, guest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            text = t.as_py() or ""
            tree = Tree.of(text)
            if held is not None and held[0] == bucket:
                out.append((held[1], *_compare(held[2], held[3], text, tree)))
            held = None if guest else (bucket, doc, text, tree)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _range_of(value: str, cuts: list[int]):
    """How many of the sorted `cuts` are at most `value`: a binary search over a literal array; 0 for null."""
    if not cuts:
        return F.lit(0)
    array = "array(" + ", ".join(f"{c}L" for c in cuts) + ")"
    step = f"if({array}[shiftright(s.lo + s.hi, 1)] <= {value}, named_struct('lo', shiftright(s.lo + s.hi, 1) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi, 1)))"
    return F.expr(f"aggregate(sequence(0, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo < s.hi, {step}, s)).lo")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Compare each document with its edited text and with the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edit_at): edit_at is the byte at which the first differing leaf begins (the
    text's length if leaves were only added), null if the edit changes nothing.  The next document is that with the next larger
    id; after the last comes the first; one document alone is its own next.

    A null text is empty.  Rows with a null id come first.  Rows that share an id follow
    each other by a hash of their texts, then their texts.  Other columns are not
    carried.  An empty table gives an empty result.

    Documents are dealt to ranges of ids; the first document of each range goes to the
    range before as well, as a guest.  Only bounds and first ids of ranges, of which
    there are at most as many as shuffle partitions, pass the driver.
    """
    spark = docs.sparkSession
    n = buckets or partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    marks = base.select(F.percentile_approx("id", [k / n for k in range(n)], 100 * n)).first()[0]
    rows = base.withColumn("bucket", _range_of("id", sorted(set(marks or []))[1:]))
    firsts = sorted((r.bucket, r.first) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("first")).collect())
    guests = [(first.id, first.h, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the very first goes to the last range
    hosts = spark.createDataFrame(guests, "id long, h long, host int")
    here = rows.join(F.broadcast(hosts), rows.id.eqNullSafe(hosts.id) & (rows.h == hosts.h), "left").select("bucket", rows.id, rows.h, "text", "host")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    dealt = here.select("id", "h", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("at"))
    dealt = dealt.select(F.col("at.bucket").alias("bucket"), "id", F.col("at.guest").alias("guest"), "text", "h")
    dealt = dealt.repartitionById(max([b for b, _ in firsts], default=0) + 1, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", "guest", "id", "h", "text").drop("h")
    return dealt.mapInArrow(_neighbours, REPORT).withColumnRenamed("id", id_col)
