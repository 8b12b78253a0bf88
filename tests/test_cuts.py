"""Chained cuts on made recordings, and a decay against a plain loop."""

import numpy as np
import pytest

from textloom.operators import cuts

RATE = 16_000


def recording(*parts):
    """(seconds, loudness) one after the other."""
    rng = np.random.default_rng(1)
    return np.concatenate([a * rng.normal(size=int(s * RATE)) for s, a in parts]).astype(np.float32)


def test_clips_are_cut_in_the_pauses_between_them():
    x = recording((1.0, 0.2), (0.4, 0), (1.5, 0.2), (0.3, 0), (1.0, 0.2), (0.8, 0))
    clips = [cuts.Clip(1, 0.0, 0.95, 0.5, 1.45, 2.0), cuts.Clip(2, 1.45, 2.85, 2.4, 3.25, 3.8), cuts.Clip(3, 3.25, 4.15, 3.7)]
    moved, _ = cuts.refined(x, RATE, clips)
    rows = list(cuts.cut(x, RATE, moved))
    assert [(r[0], r[3], r[4]) for r in rows] == [(1, "pause", None), (2, "pause", None), (3, "pause", None)]
    assert rows[0][2] == rows[1][1] and rows[1][2] == rows[2][1]  # no sample twice, none lost
    assert 1.0 < rows[0][2] / RATE < 1.4 and 2.9 < rows[1][2] / RATE < 3.2 and 4.2 <= rows[2][2] / RATE < 4.4


def test_joined_clips_are_flagged_and_refused_and_move_nothing():
    x = recording((2.5, 0.2), (0.4, 0), (1.0, 0.2), (0.8, 0))
    clips = [cuts.Clip(1, 0.0, 1.2, 0.8, 1.2, 2.2), cuts.Clip(2, 1.2, 2.45, 2.0, 2.95, 3.5), cuts.Clip(3, 2.95, 3.85, 3.4)]
    moved, _ = cuts.refined(x, RATE, clips)
    assert [c.flags for c in moved] == [("end has no pause",), ("start has no pause",), ()]
    rows = list(cuts.cut(x, RATE, moved))
    assert [r[4] for r in rows] == ["unsafe", "unsafe", None] and rows[2][1] / RATE == pytest.approx(moved[1].wall)


def test_openings_and_limits():
    x = recording((1.0, 0.2), (0.4, 0), (1.0, 0.2), (1.0, 0))
    moved, wall = cuts.refined(x, RATE, [cuts.Clip(1, 1.42, 2.35, 1.9)], 0.95)
    assert 1.0 < wall < 1.4 and moved[0].start == pytest.approx(wall)
    assert [r[4] for r in cuts.cut(x, RATE, [cuts.Clip(0, 0, 1), cuts.Clip(1, 0.5, 0.6), cuts.Clip(2, 3.0, 9.0), cuts.Clip(3, 1.5, float("nan"))])] == ["impossible times", "impossible times", None]
    assert [r[4] for r in cuts.cut(recording((40.0, 0.2)), RATE, [cuts.Clip(1, 0.5, 35.0)])] == ["too short or long"]
    assert list(cuts.cut(x, RATE, [])) == []


def plain_decay(x, end, wall):
    start, limit, frame, hop = int(end * RATE), int(wall * RATE), 400, 160
    own = x[max(0, start - 5_600) : start + frame].astype(float)
    floor = max(1e-5, 0.04 * np.sqrt(np.mean(own**2)))
    spoken, run = start, 0
    for k, at in enumerate(range(start, limit, hop)):
        part = x[at : min(limit, at + frame)].astype(float)
        if np.sqrt(np.mean(part**2)) > floor:
            spoken, run = min(limit, at + frame), 0
        else:
            began = at if run == 0 else began
            run += hop
            if run >= 3_200:
                return min(limit, max(spoken, began) + 800) / RATE
    return wall


@pytest.mark.parametrize("seed", range(12))
def test_decay_against_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    x = recording(*[(rng.uniform(0.02, 0.4), rng.choice([0, 0.001, 0.2])) for _ in range(12)])
    end = rng.uniform(0, len(x) / RATE / 2)
    assert cuts.decay(x, RATE, end, len(x) / RATE)[0] == pytest.approx(plain_decay(x, end, len(x) / RATE), abs=1e-9)


def test_no_two_clips_share_a_sample():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x = recording(*[(rng.uniform(0.1, 0.8), rng.choice([0, 0.2])) for _ in range(10)])
        ends = np.sort(rng.uniform(0, len(x) / RATE, 8))
        own = [cuts.Clip(k + 1, a, b, None, float(ends[k + 1]) if k < 6 else None) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
        rows = [r for r in cuts.cut(x, RATE, cuts.refined(x, RATE, own)[0]) if r[4] is None]
        assert all(a[2] <= b[1] for a, b in zip(rows, rows[1:])) and all(0 <= r[1] < r[2] <= len(x) for r in rows)


def test_recordings_on_spark(spark):
    x = recording((1.0, 0.2), (0.4, 0), (1.0, 0.2), (0.8, 0)).tolist()
    clips = [(1, 0.0, 0.95, 0.5, 1.45, 2.0), (2, 1.45, 2.35, 1.9, None, None), (3, None, 2.0, None, None, None)]
    rows = [("a", x, None, clips), ("b", None, 0.5, clips[:1]), ("c", x, 0.0, None)]
    df = spark.createDataFrame(rows, "rec string, samples array<float>, opening double, clips array<struct<number: int, start: double, end: double, last_word: double, wall: double, next_end: double>>")
    got = {(r.rec, r.number): r for r in cuts.cut_recordings(df).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 3), ("b", 1)} and got["a", 1].stop == got["a", 2]["first"] and got["a", 3].refused == got["b", 1].refused == "impossible times"
