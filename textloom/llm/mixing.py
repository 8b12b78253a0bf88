"""Mixing documents to target weights with soft membership.

A classifier trained on a labelled table predicts each document's domain posteriors.
Rates r >= 0 for documents are then fitted by projected gradient so that the expected
token totals of the domains, sum over documents of r * tokens * posterior, come as near
to the targets as least squares allows.  Each step needs one short vector, which Spark
sums over all documents; the rates themselves never leave the executors.
"""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.bpe import encoder
from textloom.llm.runtime import slices, stored

SPACES = " \t\n\x0b\x0c\r"
#: Features are hashed to so many buckets: the bound of a model's size.
BUCKETS = 1 << 18


_SHAPES = {k: [crc32(f"\0{k}:{v}".encode()) % BUCKETS for v in range(10)] for k in ("capitals", "symbols", "distinct", "lines", "length")}


def features(text: str):
    """Buckets (an array; some may come twice) of a text's distinct words (letters of ASCII in lower case, marks at their ends cut), and of its shape."""
    import numpy as np

    raw = text.encode()
    words = raw.lower().split()
    distinct = set(words)
    marks = b".,;:!?\"'()[]*#%&$|"
    found = np.fromiter(map(crc32, [w.strip(marks) for w in distinct]), np.int64, len(distinct)) % BUCKETS
    n = max(1, len(words))
    upper = sum(len(w) > 1 for w in filter(bytes.isupper, raw.split()))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = list(filter(bytes.strip, raw.split(b"\n")))
    shape = {
        "capitals": upper / n,
        "symbols": symbols / n,
        "distinct": len(distinct) / n ** 0.8,
        "lines": len(set(lines)) / max(1, len(lines)),
        "length": math.log2(n) / 20,
    }
    return np.append(found, [_SHAPES[k][min(9, int(10 * v))] for k, v in shape.items()])


class PosteriorModel:
    """Softmax regression over the presence of a few hundred telling features."""

    def __init__(self, domains: list[str], weights: dict[int, list[float]], prior: list[float]):
        self.domains, self.weights, self.prior = domains, weights, prior
        self._has = None

    def posteriors(self, text: str | None) -> list[float]:
        if not self.domains:
            return []
        import numpy as np

        if self._has is None:
            self._has = np.zeros(BUCKETS, bool)
            self._has[list(self.weights)] = True
        score, found = list(self.prior), features(text or "")
        for f in sorted(set(found[self._has[found]].tolist())):
            for k, w in enumerate(self.weights[f]):
                score[k] += w
        top = max(score)
        e = [math.exp(x - top) for x in score]
        return [x / sum(e) for x in e]


def telling(priors: dict[str, int], counts: list[tuple[int, str, int]], most: int = 200, least: int = 4) -> list[int]:
    """The `most` buckets, held by at least `least` texts, that say most about the domain (mutual information)."""
    total = sum(priors.values())
    by: dict[int, dict[str, int]] = {}
    for bucket, domain, n in counts:
        by.setdefault(bucket, {})[domain] = n
    scored = []
    for bucket, found in by.items():
        held = sum(found.values())
        if held < least:
            continue
        gain = 0.0
        for d, size in priors.items():
            n = found.get(d, 0)
            for part, whole in ((n, held), (size - n, total - held)):
                if part:
                    gain += part * math.log(part * total / (size * whole))
        scored.append((-gain, bucket))
    return [bucket for _, bucket in sorted(scored)[:most]]


def fit(domains: list[str], rows: list[tuple[str, list[int]]], chosen: list[int], ridge: float = 0.5, rounds: int = 300) -> PosteriorModel:
    """Softmax regression with an L2 penalty by accelerated gradient descent."""
    import numpy as np

    column = {f: i + 1 for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen) + 1))
    x[:, 0] = 1
    y = np.zeros((len(rows), len(domains)))
    for i, (d, found) in enumerate(sorted(rows)):
        x[i, [column[f] for f in found]] = 1
        y[i, domains.index(d)] = 1
    penalty = np.full((x.shape[1], 1), ridge)
    penalty[0] = 0
    rate = 1 / (0.5 * float(np.linalg.norm(x, 2)) ** 2 + ridge)
    w = ahead = np.zeros((x.shape[1], len(domains)))
    for k in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ (p - y) + penalty * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return PosteriorModel(domains, {f: w[i].tolist() for f, i in column.items()}, w[0].tolist())


def train(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 6_000) -> PosteriorModel:
    """Fit on at most `max_labels` labelled documents, those with the smallest hash of the id.

    The labels in use are so few that they are broadcast, and their features are so few
    that the driver fits the model.  Label rows with a null id or domain are left out; of
    several labels of one document the last domain counts.  Without labelled documents the
    model has no domains.
    """
    used = labels.select(F.col(id_col).alias("_label_id"), domain.alias("_domain")).dropna().groupBy("_label_id").agg(F.max("_domain").alias("_domain"))
    used = stored(used.orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_labels), "labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(used), F.col("_id") == F.col("_label_id")).select("_domain", "_text")

    def find(batches):
        import pyarrow as pa

        for batch in slices(batches):
            lists = [sorted(set(features(t.as_py() or "").tolist())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["domain", "found"])

    held = stored(rows.mapInArrow(find, "domain string, found array<long>"), "labelled")
    priors = {r.domain: r["count"] for r in held.groupBy("domain").count().collect()}
    if not priors:
        return PosteriorModel([], {}, [])
    # At most BUCKETS rows for each domain, then at most `max_labels` rows of chosen features.
    counts = held.select("domain", F.explode("found").alias("bucket")).groupBy("domain", "bucket").count()
    chosen = telling(priors, [(r.bucket, r.domain, r["count"]) for r in counts.filter("count > 1").collect()])
    some = held.select("domain", F.array_intersect("found", F.array(*[F.lit(c) for c in chosen]).cast("array<bigint>")).alias("found"))
    return fit(sorted(priors), [(r.domain, r.found) for r in some.collect()], chosen)


def with_posteriors(docs: DataFrame, model: PosteriorModel, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, tokens, p): the tokenizer's ids of the whole text, posteriors in the order of model.domains."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own = encoder(tokenizer)
        for batch in slices(batches):
            posteriors = [model.posteriors(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.counts(batch.column(1))), pa.array(posteriors, pa.list_(pa.float64()))], names=["id", "tokens", "p"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, tokens long, p array<double>")


@dataclass(frozen=True)
class Fit:
    """Rates of `rows` (those of the written table, and r), and how near they come to the targets."""

    rows: DataFrame
    totals: list[float]
    #: The largest miss of a target, by the sum of targets.
    residual: float
    #: Whether the targets are met, or no step comes nearer (then they cannot all be met).
    converged: bool
    rounds: int


def fit_rates(scored: DataFrame, targets: list[float], p: Column, rounds: int = 40, tolerance: float = 1e-6, keep: int = 8) -> Fit:
    """Nonnegative rates r for rows (tokens, and posteriors `p`) by projected gradient, from rates 1: r <- max(0, r - p . g).

    Minimises half the squared distance of totals to `targets`, in the metric of the
    totals' own Gram matrix, over rates weighted by tokens; a step is scaled by the Gram
    matrix of the rows whose rate is above 0, and halves while it does not come nearer.  One short vector a round passes the driver.  Rates are written every
    `keep` steps, so that a round's work does not grow with the rounds before.
    """
    import numpy as np

    k = len(targets)
    goal = np.array(targets)
    rows = scored.withColumn("r", F.lit(1.0))
    row = scored.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    gram = np.array([0.0 if x is None else x for x in row]).reshape(k, k)
    if not gram.any():
        return Fit(rows, [0.0] * k, 0.0 if not goal.any() else 1.0, not goal.any(), 0)
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-9 * np.trace(gram))

    def look(steps):
        """How far totals are off, and the inverse Gram matrix of rows with a rate above 0: only those can still give way."""
        r = rate(F.col("r"), p, steps)
        pairs = [F.sum(F.when(r > 0, F.col("tokens") * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        got = rows.agg(*[F.sum(r * F.col("tokens") * p[i]) for i in range(k)], *pairs).first()
        live = np.array(got[k:], float).reshape(k, k)
        return np.array(got[:k], float) - goal, np.linalg.pinv(live + np.eye(k) * 1e-9 * np.trace(gram))

    steps: list[list[float]] = []
    off, metric = look(steps)
    distance, size = off @ inverse @ off, 1.0
    scale = max(1.0, float(np.abs(goal).sum()))
    done, used = False, 0
    for used in range(1, rounds + 1):
        if np.abs(off).max() <= tolerance * scale:
            done = True
            break
        step = (size * (metric @ off)).tolist()
        new, other = look([*steps, step])
        nearer = new @ inverse @ new
        if nearer < distance:
            gain = (distance - nearer) / distance
            steps, off, metric, distance, size = [*steps, step], new, other, nearer, min(1.0, 2 * size)
            if len(steps) == keep:
                rows, steps = stored(rows.withColumn("r", rate(F.col("r"), p, steps)), "rates"), []
            if gain < 1e-9:
                done = True
                break
        else:
            size /= 2
            if size < 1e-6:
                done = True
                break
    return Fit(rows.withColumn("r", rate(F.col("r"), p, steps)), (off + goal).tolist(), float(np.abs(off).max() / scale), done or bool(np.abs(off).max() <= tolerance * scale), used)


def rate(r: Column, p: Column, steps: list[list[float]]) -> Column:
    """A document's rate after `steps` from `r`."""
    out = r
    for g in steps:
        out = F.greatest(F.lit(0.0), out - sum((p[i] * x for i, x in enumerate(g)), F.lit(0.0)))
    return out


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], tokenizer: str, total_tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 6_000, rounds: int = 40, labelled: DataFrame | None = None) -> DataFrame:
    """Return (id, tokens, rate, p_<domain>...): how often to take each document.

    `weights` are shares of tokens by domain, among those of weighted domains; a domain
    without a weight has no target.  A weighted domain without labels cannot be told
    apart: the others share its weight in proportion.  `total_tokens` is the sum of the targets; without it, it is such that
    the heaviest domain keeps the tokens that it has.  The classifier learns from the
    labelled rows of `labelled` (ids and texts; `docs` by default).

    A null text has no tokens and does not change totals; its rate follows from its
    posteriors.  Rows with null or repeated ids each have a rate.  Other columns are not
    carried.  An empty table gives an empty result.  Without labelled documents of a
    weighted domain there is nothing to match, and all rates are 1.  A fit that ends
    before its rates settle is warned of.
    """
    model = train(docs if labelled is None else labelled, labels, domain, id_col, text_col, max_labels)
    scored = stored(with_posteriors(docs, model, tokenizer, id_col, text_col), "posteriors")
    at = [i for i, d in enumerate(model.domains) if d in weights]
    told = sum(weights[model.domains[i]] for i in at)
    rows = scored.withColumn("r", F.lit(1.0))
    if told:
        aimed = F.array(*[F.col("p")[i] for i in at])
        share = [weights[model.domains[i]] / told for i in at]
        if total_tokens is None:
            k = share.index(max(share))
            total_tokens = (scored.agg(F.sum(F.col("tokens") * aimed[k])).first()[0] or 0.0) / share[k]
        found = fit_rates(scored, [s * total_tokens for s in share], aimed, rounds)
        rows = found.rows
        if not found.converged:
            warnings.warn(f"the mix has not settled after {found.rounds} rounds: a target is missed by {found.residual:.2%} of all tokens", stacklevel=2)
    names = [re.sub(r"\W", "_", d) for d in model.domains]
    return rows.select(F.col("id").alias(id_col), "tokens", F.col("r").alias("rate"), *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(names)])


def copies(rate: Column, key: Column) -> Column:
    """Whole copies for a rate: up or down by a hash of `key`, in proportion, so that copies come to the rate on average."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), key), 11) / F.lit(float(1 << 53))
    return F.floor(rate + unit).cast("int")


def apply_mix(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeat each row of `docs` as often as its rate in `rates` (id, rate) says; a row whose id has no rate goes.

    Rows that share an id, and their rates, cannot be told apart: all take the mean of
    those rates, so totals stay as they are on average; rows with a null id likewise share
    the mean rate of null ids.  All columns come back as they are, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    each = stored(rates.groupBy(F.col(f"`{id_col}`").alias("of")).agg(F.avg("rate").alias("rate")), "mean-rates")
    # Rows draw by id and text, so those that share an id draw apart unless they are equal.
    key = F.struct("id", F.col(f"row.`{text_col}`")) if text_col in docs.columns else F.col("id")
    times = rows.join(each.hint("merge"), F.col("id").eqNullSafe(F.col("of"))).withColumn("n", copies(F.col("rate"), key)).filter("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
