"""Which tokens may follow where only certain words may be said, and how likely given candidates are.

The words of a scope are a prefix tree in flat arrays, one row; a sequence walks it with a
set of places, as a prefix may be of several words at once.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

TREE = "tokens array<int>, begins array<int>, ends array<boolean>"


def flat_tree(sequences: list[tuple[int, ...]]) -> tuple[list[int], list[int], list[bool]]:
    """(tokens, begins, ends): node k is reached by tokens[k], its children are nodes begins[k] to begins[k + 1], in order of tokens; ends where a sequence does.

    Nodes are numbered level by level, so that siblings lie together; node 0 is the root.
    """
    rows = sorted(set(sequences))
    tokens, begins, ends = [-1], [], []
    level = [(0, len(rows))]  # spans of sequences that share the node's prefix
    depth = 0
    while level:
        below = []
        for a, b in level:
            done = a < b and len(rows[a]) == depth
            ends.append(done)
            begins.append(len(tokens))
            at = a + done
            while at < b:
                token, end = rows[at][depth], at
                while end < b and rows[end][depth] == token:
                    end += 1
                tokens.append(token)
                below.append((at, end))
                at = end
        level, depth = below, depth + 1
    return tokens, [*begins, len(tokens)], ends


class Words:
    """Two trees: words that may come first, and words that may follow another."""

    def __init__(self, first, following):
        self.trees = [tuple(np.asarray(x) for x in t) for t in (first, following)]

    def _child(self, place: tuple[int, int], token: int) -> tuple[int, int] | None:
        which, node = place
        tokens, begins, _ = self.trees[which]
        a, b = begins[node], begins[node + 1]
        k = a + int(np.searchsorted(tokens[a:b], token))
        return (which, k) if k < b and tokens[k] == token else None

    def _children(self, place: tuple[int, int]) -> list[int]:
        which, node = place
        tokens, begins, _ = self.trees[which]
        return tokens[begins[node] : begins[node + 1]].tolist()

    def _ends(self, places) -> bool:
        return any(self.trees[w][2][k] for w, k in places)

    def allowed(self, said: list[int], end: int) -> list[int] | None:
        """Tokens that may come next, `end` among them where a word is complete; null if what is said is none of these words.

        After the end only the end may come.
        """
        places = [(0, 0)]
        for i, token in enumerate(said):
            if token == end:
                fine = (i == 0 or self._ends(places)) and all(t == end for t in said[i:])
                return [end] if fine else None
            places = [p for p in (self._child(q, token) for q in places + [(1, 0)] * (i > 0 and self._ends(places))) if p]
            if not places:
                return None
        out = {t for p in places for t in self._children(p)}
        if not said or self._ends(places):
            out.add(end)
            out.update(self._children((1, 0)) if said else ())
        return sorted(out) or None


def word_trees(words: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, first, following): a row of two flat trees for each scope of `words` (scope, tokens: array<int>, follows).

    follows says that the tokens begin a word behind another; such words may come first too.
    Null or empty tokens are left out, repeated ones are one, a null scope is a scope.
    A scope's words are in one task, as its tree is one row.
    """
    kind = words.schema[scope].dataType.simpleString()
    tree = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in TREE.split(', '))}>"

    def build(key, table):
        import pyarrow as pa

        rows = list(zip((tuple(t) for t in table.column("tokens").to_pylist()), table.column("follows").to_pylist(), strict=True))
        out = {}
        for name, own in (("first", [t for t, _ in rows]), ("following", [t for t, f in rows if f])):
            tokens, begins, ends = flat_tree(own)
            fields = [pa.array([x], pa.list_(t)) for x, t in ((tokens, pa.int32()), (begins, pa.int32()), (ends, pa.bool_()))]
            out[name] = pa.StructArray.from_arrays(fields, names=["tokens", "begins", "ends"])
        return pa.table({scope: pa.array([key[0].as_py()], table.schema.field(scope).type), **out})

    rows = words.select(scope, "tokens", F.coalesce("follows", F.lit(False)).alias("follows")).filter("size(tokens) > 0").distinct()
    return rows.groupBy(scope).applyInArrow(build, f"`{scope}` {kind}, first {tree}, following {tree}")


#: Nodes of all trees together up to which every task holds them; beyond, a tree goes to `PARTS` tasks of its scope's sequences.
MOST_NODES, PARTS = 5_000_000, 8


def allowed_next(said: DataFrame, trees: DataFrame, end: int, scope: str = "scope", most_nodes: int = MOST_NODES) -> DataFrame:
    """`said` (scope, sequence, ...) with next: the tokens that may follow, null where the sequence is not of the scope's words or the scope has none.

    A null sequence is an empty one.  Columns named like those of `trees` must not be there.
    """
    sides = ("first", "following")
    trees = trees.persist(StorageLevel.DISK_ONLY)  # made once: their size, and they themselves
    size = trees.agg(F.sum(F.size("first.tokens") + F.size("following.tokens"))).first()[0] or 0
    known = {r[scope]: r for r in trees.collect()} if size <= most_nodes else None
    names = said.columns
    at, to = names.index(scope), names.index("sequence")
    made: dict = {}

    def words(key) -> Words | None:
        if key not in made:
            made[key] = Words(*[(known[key][c]["tokens"], known[key][c]["begins"], known[key][c]["ends"]) for c in sides]) if key in known else None
        return made[key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scopes, out = batch.column(at).to_pylist(), []
            for key, s in zip(scopes, batch.column(to).to_pylist(), strict=True):
                own = words(key)
                out.append(None if own is None else own.allowed(s or [], end))
            kept = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.int32()))], names=[*names, "next"])

    answer = T.StructField("next", T.ArrayType(T.IntegerType()))
    if known is not None:
        return said.mapInArrow(run, T.StructType([*said.schema.fields, answer]))

    def walk(left, right):
        import pyarrow as pa

        own = None
        if left.num_rows and right.num_rows:
            parts = [[right.column(c).combine_chunks().field(f)[0].values.to_numpy(zero_copy_only=False) for f in ("tokens", "begins", "ends")] for c in sides]
            own = Words(*parts)
        out = [None if own is None else own.allowed(s or [], end) for s in left.column("_sequence").to_pylist()]
        return pa.table([left.column("_scope"), left.column("_sequence"), pa.array(out, pa.list_(pa.int32()))], names=["_scope", "_sequence", "next"])

    # A large tree meets each different sequence once, `PARTS` tasks a scope: it never lies beside a row.
    asked = said.select(F.col(scope).alias("_scope"), F.col("sequence").alias("_sequence")).distinct().withColumn("_part", F.pmod(F.xxhash64("_sequence"), F.lit(PARTS)))
    held = trees.select(F.col(scope).alias("_scope"), *sides, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")).alias("_part"))
    fields = [T.StructField("_scope", said.schema[scope].dataType), T.StructField("_sequence", said.schema["sequence"].dataType), answer]
    told = asked.groupBy("_scope", "_part").cogroup(held.groupBy("_scope", "_part")).applyInArrow(walk, T.StructType(fields))
    return said.join(told, said[scope].eqNullSafe(told["_scope"]) & said["sequence"].eqNullSafe(told["_sequence"]), "left").select(*[said[c] for c in names], "next")


def allowed_after(said: DataFrame, words: DataFrame, end: int, scope: str = "scope") -> DataFrame:
    """`said` with next as `allowed_next` has it, for the words of `word_trees`: without a tree, so that a scope's words are in no one task or row.

    A saying is taken apart into spans, which are looked up among the beginnings of words
    that are no longer than the longest saying; beginnings are rows that are shuffled.
    """
    names, none = said.columns, F.array().cast("array<int>")
    own = F.coalesce("sequence", none)
    ended = F.array_position(own, end)
    asked = said.select(F.col(scope).alias("_scope"), F.col("sequence").alias("_sequence")).distinct().withColumnRenamed("_sequence", "sequence")
    asked = asked.select("_scope", F.col("sequence").alias("_sequence"), F.when(ended > 0, F.slice(own, 1, (ended - 1).cast("int"))).otherwise(own).alias("_said"), F.when(ended > 0, F.forall(F.slice(own, ended.cast("int"), F.size(own)), lambda t: t == end)).alias("_over"))
    most = asked.agg(F.max(F.size("_said"))).first()[0] or 0

    given = words.select(F.col(scope).alias("_scope"), "tokens", F.coalesce("follows", F.lit(False)).alias("follows")).filter("size(tokens) > 0")
    given = given.select("_scope", "tokens", F.explode(F.when(F.col("follows"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_behind"))
    begun = given.select("_scope", "_behind", "tokens", F.explode(F.sequence(F.lit(0), F.least(F.size("tokens"), F.lit(most)))).alias("n"))
    begun = begun.select("_scope", "_behind", F.slice("tokens", 1, F.col("n")).alias("_span"), F.get("tokens", F.col("n")).alias("t"), (F.col("n") == F.size("tokens")).alias("word")).distinct()
    begun = begun.groupBy("_scope", "_behind", "_span").agg(F.collect_set("t").alias("next"), F.max("word").alias("word"))

    # Spans of a saying of n tokens: from i to j; the one at n, n is the beginning of a word behind it.
    n, i, j = F.size("_said"), F.col("i"), F.col("j")
    spans = asked.select("*", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("*", F.explode(F.when(i < n, F.sequence(i + 1, n)).otherwise(F.array(n))).alias("j"))
    spans = spans.select("_scope", "_sequence", "_said", "_over", "i", "j", (i > 0).alias("_behind"), F.slice("_said", i + 1, j - i).alias("_span"))
    # A scope without words allows nothing, not even the end of nothing: its empty beginning tells.
    spans = spans.union(asked.select("_scope", "_sequence", "_said", "_over", F.lit(-1), F.lit(-1), F.lit(False), none))
    met = spans.join(begun.withColumnRenamed("_scope", "_of"), F.col("_scope").eqNullSafe(F.col("_of")) & (spans["_behind"] == begun["_behind"]) & (spans["_span"] == begun["_span"]))
    found = met.groupBy("_scope", "_sequence", "_said", "_over").agg(F.collect_list(F.struct("i", "j", "word", "next")).alias("_found"))

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            out = [_next_of(len(s), over, f, end) for s, over, f in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=["_scope", "_sequence", "next"])

    fields = [T.StructField("_scope", said.schema[scope].dataType), T.StructField("_sequence", said.schema["sequence"].dataType), T.StructField("next", T.ArrayType(T.IntegerType()))]
    answers = found.mapInArrow(told, T.StructType(fields))
    return said.join(answers, said[scope].eqNullSafe(answers["_scope"]) & said["sequence"].eqNullSafe(answers["_sequence"]), "left").select(*[said[c] for c in names], "next")


def _next_of(n: int, over: bool | None, found: list[dict], end: int) -> list[int] | None:
    """Tokens that may follow a saying of `n` tokens, by its spans that begin a word; `over` says that the end has been said, and whether nothing else followed."""
    held = {(f["i"], f["j"]): f for f in found}
    complete = {0}
    for j in range(1, n + 1):
        if any(i in complete and (f := held.get((i, j))) and f["word"] for i in range(j)):
            complete.add(j)
    if over is not None:
        return [end] if over and n in complete else None
    out = {t for i in range(n) if i in complete for t in held.get((i, n), {"next": ()})["next"]}
    if n == 0:
        out = {end, *held[-1, -1]["next"]}
    elif n in complete:
        out |= {end, *held.get((n, n), {"next": ()})["next"]}
    return sorted(out) or None


def candidate_score(logits: Column, ids: Column, skipped: Column | int = 0) -> Column:
    """The summed log-probability of a candidate: `logits` (array of an array a step) at its `ids`, without the first `skipped` steps.

    Steps without an id, and ids without a step, do not count; null for null columns, 0 for
    no steps.  An id outside a step's logits makes it null.
    """
    steps = F.slice(F.arrays_zip(logits.alias("l"), ids.alias("i")), F.lit(skipped) + 1 if isinstance(skipped, int) else skipped + 1, F.greatest(F.least(F.size(logits), F.size(ids)), F.lit(0)))

    def step(x: Column) -> Column:
        top = F.array_max(x["l"])
        total = F.aggregate(x["l"], F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - top))
        return F.get(x["l"], x["i"]) - top - F.log(total)

    known = F.filter(steps, lambda x: x["l"].isNotNull() & x["i"].isNotNull())
    return F.aggregate(F.transform(known, step), F.lit(0.0), lambda s, v: s + v)
