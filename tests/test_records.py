"""Records: errors that must be raised, paths, and greedy interval matches against plain ones."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import records as R
from textloom.plans import catalog, records


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert [r.x for r in R.select_named(df, "x", ["a"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown names: c"):
        R.select_named(df, "x", exclude=["c"])


def test_duplicates_and_conflicts_are_errors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key: 1"):
        R.no_duplicates(df, ["k"]).collect()
    assert R.no_duplicates(df.filter("v <> 'b'"), ["k"]).count() == 2
    with pytest.raises(Exception, match="conflicting labels for 1"):
        R.conflict_free(df, ["k"], "v").collect()


def test_paths(spark):
    paths = {"a/b.wav": True, "": False, "/a": False, "a/../b": False, "..": False, "c:\\x": False, "a\\b": False, "a..b/c": True, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", R.safe_path(F.col("p")).alias("ok")).collect()} == paths


def plain_matches(events, guesses):
    used, out = set(), []
    for g in sorted(guesses):
        best = None
        for e in sorted(events):
            if e[0] in used or e[1] != g[1]:
                continue
            shared, union = max(0.0, min(e[3], g[3]) - max(e[2], g[2])), max(e[3], g[3]) - min(e[2], g[2])
            if union > 0 and shared / union >= (best[1] if best else 0.5):
                best = (e[0], shared / union)
        if best:
            used.add(best[0])
            out.append((best[0], g[0], round(best[1], 9)))
    return out


def test_interval_matches_are_plain(spark, sf):
    got = sorted((r.clip, r.event, r.guess, round(r.iou, 9)) for r in catalog.queries()["j12_interval_matches"](spark, sf).collect())
    clips = {}
    for r in records.read(spark, sf, "events").collect():
        start = r.value % 30
        clips.setdefault(r.user_id % 50, ([], []))[r.event_id % 2].append((r.event_id, r.event_type, start, start + 1 + r.value % 3))
    assert got == sorted((c, *m) for c, (e, g) in clips.items() for m in plain_matches(e, g))


def test_pools_top_up(spark):
    a, b = (spark.createDataFrame(x, "g int, k int, w int") for x in ([(1, 1, 5), (2, 2, 1)], [(1, 1, 0), (1, 3, 0), (1, 4, 0), (2, 2, 0)]))
    got = sorted((r.g, r.k, r.pool) for r in R.pooled([a, b], "k", F.col("w"), ["g"], 2).collect())
    assert got == [(1, 1, 0), (1, 3, 1), (2, 2, 0)]


def test_intervals_match_as_all_against_all(spark):
    import random
    import time

    from textloom.operators.records import match_spans

    def plain(events, guesses, least):
        used, out = set(), []
        for g, a, b in guesses:
            best, most = None, least
            for e, c, d in events:
                shared, union = max(0.0, min(d, b) - max(c, a)), max(d, b) - min(c, a)
                if e not in used and union > 0 and shared / union >= most:
                    best, most = e, shared / union
            if best is not None:
                used.add(best)
                out.append((best, g, most))
        return out

    def stacks(events):
        held = {}
        for e, c, d in events:
            held.setdefault((c, d), []).append(e)
        return held

    rnd = random.Random(3)
    for grain in (1, 10, 1000):
        for least in (0.5, 0.2, 1.0, 0.0):
            rows = [(i, s, s + rnd.randint(0, 3 * grain) / grain) for i in range(200) for s in [rnd.randint(0, 30 * grain) / grain]]
            assert match_spans(stacks(rows[::2]), rows[1::2], least) == plain(rows[::2], rows[1::2], least)
    many = [(i, v % 30, v % 30 + 1 + v % 3) for i in range(40_000) for v in [i * 7 % 9_000 / 100]]
    began = time.monotonic()
    assert len(match_spans(stacks(many[::2]), many[1::2], 0.5)) > 15_000
    assert time.monotonic() - began < 30  # all against all takes minutes
