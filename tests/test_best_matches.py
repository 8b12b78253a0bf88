"""Best matches: different texts once, by the bound of letter counts, equal to all pairs."""

import random
from difflib import SequenceMatcher

from textloom.operators import audits as A


def test_equal_to_all_pairs_and_texts_once(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9)))
    rows = [(k, word()) for k in range(300)] + [(300, None), (None, "abc")]
    asked = [(q, word()) for q in range(60)] + [(60, ""), (61, None), (62, "zzz"), (7, "abcabc")]
    corpus, queries = spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame(asked, "q long, t string")
    best = {}
    for q, x in asked:
        for k, t in rows:
            if k is not None and x is not None and (r := SequenceMatcher(None, x, t or "").ratio()) > 0:
                best[q] = min(best.get(q, (0.0, k)), (-r, k))
    out = A.best_matches(corpus, queries, "k", "t", "q", block=17, run_of=11)
    assert {r.q: (-r.ratio, r.k) for r in out.collect()} == best
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("MapInPandas") :]
