"""Cutting a recording into clips whose ends hang on one another: an ordered fold in memory of one recording."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.operators.sound import RATE, pause, true_runs


@dataclass(frozen=True)
class Clip:
    """What is known of a clip before it is cut, in seconds; `wall` is the onset of what follows."""

    number: int
    start: float
    end: float
    last_word: float | None = None
    wall: float | None = None
    next_end: float | None = None
    flags: tuple[str, ...] = ()
    #: Whether the ends lie in measured pauses.
    starts_clean: bool = False
    ends_clean: bool = False


#: Fixed values in seconds: onsets that are the same, what a clip may begin early, overlap that is none, shortest and longest clip.
SAME_ONSET, EARLY, TOUCH, SHORTEST, LONGEST = 0.025, 0.04, 0.001, 0.25, 30.0
#: Frames of the search for a decay, what before it tells the level, the share of it that is silent, how long silence lasts, and what stays of it.
FRAME, STEP, BEFORE, SILENT, LASTS, STAYS = 0.025, 0.01, 0.35, 0.04, 0.2, 0.05


def decay(x: np.ndarray, rate: int, end: float, wall: float) -> tuple[float, str]:
    """Where speech has died down behind `end`, or the wall if it has not before: silence must last a fifth of a second."""
    length = len(x) / rate
    end, wall = min(max(0.0, end), length), min(max(0.0, wall), length)
    if end > wall:
        return wall, "crosses the wall"
    first, last, frame, step = int(end * rate), int(wall * rate), max(1, int(FRAME * rate)), max(1, int(STEP * rate))
    heard = x[max(0, first - int(BEFORE * rate)) : first + frame].astype(np.float64)
    limit = max(1e-5, SILENT * float(np.sqrt(np.mean(heard**2)))) if len(heard) else 1e-5
    sums = np.append(0.0, np.cumsum(np.square(x[first:last], dtype=np.float64)))
    at = np.arange(0, last - first, step)
    stop = np.minimum(at + frame, last - first)
    voiced = np.sqrt((sums[stop] - sums[at]) / np.maximum(1, stop - at)) > limit
    needed = -(-int(LASTS * rate) // step)
    for a, b in true_runs(~voiced):
        if b - a >= needed:
            spoken_to = stop[a - 1] if a else 0
            return min(last, first + max(int(spoken_to), int(at[a])) + int(STAYS * rate)) / rate, "decay"
    return wall, "no silence"


def refined(x: np.ndarray, rate: int, clips: Iterable[Clip], opening: float = 0.0) -> tuple[list[Clip], float]:
    """Clips with their ends, and the starts of their neighbours, moved into measured pauses; the end of the opening likewise.

    A clip without a pause behind it is flagged, and so is the one that begins there.
    """
    order = sorted(clips, key=lambda c: c.start)
    done = {c.number: c for c in order}
    if order and opening > 0:
        first = order[0]
        found = pause(x, rate, max(0.0, opening - 0.6), opening, first.start, None)
        if "reason" in found:
            done[first.number] = replace(first, flags=(*first.flags, "opening has no pause"))
        else:
            opening = found["left_end"]
            done[first.number] = replace(first, start=found["right_start"])
    for number in [c.number for c in order]:
        c = done[number]
        found = pause(x, rate, c.start if c.last_word is None else max(c.start, c.last_word), c.end, c.wall, c.next_end)
        beside = [] if c.wall is None else [k for k, o in done.items() if k != number and abs(o.start - c.wall) < SAME_ONSET][:1]
        if "reason" in found:
            done[number] = replace(c, flags=(*c.flags, "end has no pause"))
            for k in beside:
                done[k] = replace(done[k], flags=(*done[k].flags, "start has no pause"))
        else:
            done[number] = replace(c, end=found["left_end"], ends_clean=True, wall=c.wall if c.wall is None else found["right_start"])
            for k in beside:
                done[k] = replace(done[k], start=found["right_start"], starts_clean=True)
    return [done[c.number] for c in order], opening


def cut(x: np.ndarray, rate: int, clips: Iterable[Clip], opening: float = 0.0) -> Iterator[tuple]:
    """(number, first sample, sample behind the last, how it ends, why it was refused) of each clip: impossible ones first, then by starts.

    A clip begins no earlier than the last one that was accepted ends; one that was refused
    moves nothing.  No two clips share a sample.
    """
    length, frontier = len(x) / rate, int(np.ceil(opening * rate))
    known = [c for c in clips if c.number >= 1]
    possible = [c for c in known if np.isfinite([c.start, c.end]).all() and 0 <= c.start < c.end <= length]
    order = sorted(possible, key=lambda c: c.start)
    for c in known:
        if c not in possible:
            yield c.number, None, None, None, "impossible times"
    # An onset is one even where the clip's own end is not possible.
    onsets = sorted(c.start for c in known if np.isfinite(c.start))
    for c in order:
        wall = min([length, *([] if c.wall is None else [c.wall]), *[o for o in onsets if o > c.start][:1]])
        if c.flags or c.end > wall + TOUCH or c.start < opening or c.start < frontier / rate - TOUCH:
            yield c.number, None, None, None, "unsafe"
        else:
            end, how = (c.end, "pause") if c.ends_clean else decay(x, rate, c.end, wall)
            a = max(frontier, int((c.start if c.starts_clean else max(0.0, c.start - EARLY)) * rate))
            b = min(len(x), int(end * rate))
            if SHORTEST <= (b - a) / rate <= LONGEST:
                frontier = b
                yield c.number, a, b, how, None
            else:
                yield c.number, None, None, None, "too short or long"


_CUT = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("how", T.StringType()), T.StructField("refused", T.StringType())]))


def cut_recordings(recordings: DataFrame, rec: str = "rec", rate: int = RATE) -> DataFrame:
    """(rec, number, first, stop, how, refused) of the clips of recordings (rec, samples, opening, clips: array of (number, start, end, last_word, wall, next_end)).

    Ends are moved into pauses first.  Null samples, clips or opening are none.  Of clips
    with one number the last one given counts.  A recording is cut in one row, with memory
    for its samples; recordings are spread by Spark.
    """

    @F.pandas_udf(_CUT)
    def run(samples: pd.Series, opening: pd.Series, clips: pd.Series) -> pd.Series:
        out = []
        for x, o, own in zip(samples, opening, clips, strict=True):
            x = np.zeros(0, np.float32) if x is None else np.asarray(x, np.float32)
            none = lambda v: None if pd.isna(v) else float(v)
            given = {c["number"]: Clip(c["number"], *(float("nan") if pd.isna(c[k]) else float(c[k]) for k in ("start", "end")), *(none(c[k]) for k in ("last_word", "wall", "next_end"))) for c in ([] if own is None else own)}
            fine = [c for c in given.values() if np.isfinite([c.start, c.end]).all()]
            moved, wall = refined(x, rate, fine, 0.0 if pd.isna(o) else float(o)) if len(x) else (fine, 0.0)
            odd = [c for c in given.values() if c not in fine]
            rows = [*cut(x, rate, moved, wall), *((c.number, None, None, None, "impossible times") for c in odd if c.number >= 1)]
            out.append([dict(zip(("number", "first", "stop", "how", "refused"), r, strict=True)) for r in rows])
        return pd.Series(out)

    return recordings.select(rec, F.explode(run("samples", "opening", "clips")).alias("c")).select(rec, "c.*")
