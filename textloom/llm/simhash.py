"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints that differ
in at most three bits, one segment differs in at most one bit.  So each segment is
indexed as it is, and once for each of its bits with that bit left out; equal entries
are joined and the pair is verified.  Entries with a bit left out are joined only where
that bit differs, so no pair is found twice by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.components import component_minima
from textloom.llm.runtime import keep_ids, slices, stored

SEED = 42


def majority(hashes) -> int:
    """The bits that are set in over half of an array of unsigned 64-bit hashes; 0 without any."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        part = hashes[at : at + 65_536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def simhash(words: list[bytes], size: int = 3) -> int:
    """64 majority bits over the XXH64 of all shingles of `size` words; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    n = len(words) - size + 1
    if not words:
        return 0
    if n < 1:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return majority(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Return (id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().lower().split()
                fp = simhash(words, size)
                out.append(fp - (1 << 64) if fp >> 63 else fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _distance(a: str, b: str):
    return F.expr(f"bit_count({a} ^ {b})")


def links(fps: DataFrame, within: int = 3) -> DataFrame:
    """Return each pair (a, b), a < b, of the distinct `fp` that differ in at most `within` bits, once.

    Groups are keyed by 32 bits of one segment, and those of an equal segment also by
    one of four bytes of the other, so that a crowd of fingerprints with one equal
    segment is not compared pair by pair.
    """
    if within > 3:
        raise ValueError("two segments hold at most three differing bits")
    low, high = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    parts = fps.select("fp", F.expr(f"posexplode(array({high}, {low}))").alias("seg", "own"), F.expr(f"array({low}, {high})").alias("both"))
    parts = parts.select("fp", "seg", "own", F.expr("both[seg]").alias("other"))

    # Equal segment: of four bytes of the other, one at least is equal too; the first such byte reports the pair.
    same = parts.select("fp", "seg", "own", "other", F.expr("posexplode(array(other & 255, shiftright(other, 8) & 255, shiftright(other, 16) & 255, shiftright(other, 24) & 255))").alias("byte", "value"))
    left = same.select("seg", "own", "byte", "value", F.col("fp").alias("a"))
    right = same.select("seg", "own", "byte", "value", F.col("fp").alias("b"))
    differing = "(case when seg = 0 then (a ^ b) & 4294967295L else shiftrightunsigned(a ^ b, 32) end)"
    first = f"(case when {differing} & 255 = 0 then 0 when {differing} & 65280 = 0 then 1 when {differing} & 16711680 = 0 then 2 else 3 end)"
    equal = left.join(right.hint("merge"), ["seg", "own", "byte", "value"]).filter(F.expr(f"a < b and bit_count(a ^ b) <= {within} and byte = {first}"))

    # One bit of the segment left out, and different there.
    holed = parts.select("fp", "seg", F.expr("own"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("hole"))
    holed = holed.select("fp", "seg", "hole", F.expr("own & ~shiftleft(1L, hole)").alias("rest"), F.expr("shiftright(own, hole) & 1").alias("bit"))
    zero = holed.filter("bit = 0").select("seg", "hole", "rest", F.col("fp").alias("a"))
    one = holed.filter("bit = 1").select("seg", "hole", "rest", F.col("fp").alias("b"))
    off = zero.join(one.hint("merge"), ["seg", "hole", "rest"]).filter(F.expr(f"bit_count(a ^ b) <= {within}"))

    # The other segment may report a pair as well.
    pairs = equal.select("a", "b").unionByName(off.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = 3, size: int = 3) -> DataFrame:
    """Return (id, fingerprint, component_id) for each row of `docs`.

    component_id is the smallest id that links reach.  A null text has no words
    (fingerprint zero).  A row with a null id has a fingerprint and links its copies and
    neighbours, but is no candidate for a component_id (null if a component has no
    other).  Repeated rows each give a row.  Other columns are not carried.  An empty
    table gives an empty result.
    """
    own = stored(fingerprints(docs, id_col, text_col, size), "simhash-fp")
    classes = stored(own.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    edges = stored(links(classes.select("fp"), within), "simhash-links")
    # Written, so that Spark splits the rows of a fingerprint that very many documents share.
    members = stored(component_minima(classes.select(F.col("fp").alias("node"), F.col("first").alias("value")), edges), "simhash-members")
    out = own.join(members.hint("merge"), own.fp == members.node, "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("value").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = 3, size: int = 3) -> DataFrame:
    """Rows of `docs` whose id is their component's smallest, with all columns.

    Of rows that share an id all stay or go together.  Rows with a null id stay.
    """
    groups = simhash_groups(docs, id_col, text_col, within, size)
    stay = groups.filter(F.col(f"`{id_col}`") == F.col("component_id")).select(F.col(f"`{id_col}`").alias("id")).distinct()
    return keep_ids(docs, stay, id_col)
