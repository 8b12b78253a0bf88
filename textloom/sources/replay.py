"""Recordings as a paced stream: a data source that plays the clips of sessions, with silence behind each."""

from __future__ import annotations

import json
import time
import wave
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Samples a second, of a frame, and of the silence behind a clip.
RATE, FRAME, GAP = 16_000, 2_048, 16_000
#: Frames that one task reads at most.
TASK_FRAMES = 1_024
SCHEMA = "session string, start long, samples array<float>, at timestamp, stop boolean"


def opened(path: str) -> wave.Wave_read:
    """A clip in any file system that Arrow knows; it must be mono, of 16 bits and `RATE`."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    clip = wave.open(store.open_input_file(place))
    if (clip.getnchannels(), clip.getsampwidth(), clip.getframerate()) != (1, 2, RATE):
        raise ValueError(f"{path} is not mono PCM of 16 bits and {RATE} samples a second")
    return clip


class Frames(InputPartition):
    def __init__(self, session: str, first: int, last: int):
        self.session, self.first, self.last = session, first, last


class ReplayReader(DataSourceStreamReader):
    """An offset is a number of frames that all sessions have played; it follows from the clock alone, so that a restart goes on where it was."""

    def __init__(self, options):
        self.sessions: dict[str, list[list]] = json.loads(options["sessions"])
        self.began, self.speed = float(options["began"]), float(options["speed"])

    def samples(self, session: str) -> int:
        return sum(n + GAP for _, n in self.sessions[session])

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        heard = int(max(0.0, time.time() - self.began) * self.speed * RATE) // FRAME
        return {"frame": min(heard, max((-(-self.samples(s) // FRAME) for s in self.sessions), default=0))}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        if end["frame"] < start["frame"]:
            raise ValueError("the replay began later than the one that its checkpoint is of: pass the same `began`")
        out = []
        for s in self.sessions:
            last = min(end["frame"], -(-self.samples(s) // FRAME))
            out += [Frames(s, k, min(k + TASK_FRAMES, last)) for k in range(start["frame"], last, TASK_FRAMES)]
        return out

    def _read(self, session: str, a: int, b: int) -> np.ndarray:
        """Samples [a, b) of a session; only what is asked for of a clip is read."""
        parts, at = [], 0
        for path, n in self.sessions[session]:
            x, y = max(a, at), min(b, at + n)
            if x < y:
                with opened(path) as clip:
                    clip.setpos(x - at)
                    parts.append(np.frombuffer(clip.readframes(y - x), "<i2").astype(np.float32) / 32_768)
            quiet = min(b, at + n + GAP) - max(a, at + n)
            parts.append(np.zeros(max(0, quiet), np.float32))
            at += n + GAP
        return np.concatenate(parts)

    def read(self, partition: Frames) -> Iterator[tuple]:
        total = self.samples(partition.session)
        begin = datetime.fromtimestamp(self.began, timezone.utc)
        sound = self._read(partition.session, partition.first * FRAME, min(partition.last * FRAME, total))
        for k in range(partition.first, partition.last):
            frame = sound[(k - partition.first) * FRAME : (k - partition.first + 1) * FRAME]
            end = k * FRAME + len(frame)
            yield partition.session, k * FRAME, frame.tolist(), begin + timedelta(seconds=end / RATE), end == total

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


def replay(spark: SparkSession, clips: DataFrame, began: float, speed: float = 1.0) -> DataFrame:
    """A stream (session, start, samples, at, stop) of frames of `clips` (session, number, path), in the order of numbers.

    A session's clips follow one another, each with a second of silence behind it; all
    sessions play at once, from `began` (seconds of the epoch) on, at `speed` times the pace
    of a microphone.  at is when the frame's last sample is heard at speed 1, stop marks a
    session's last frame.  What is due when the stream starts, or starts again, comes at once.
    A restart needs the same clips and `began`.  Of two clips with one number that with the
    smaller path comes first; rows with a null session or path are left out.  The list of
    files, not their sound, is held by the driver, as for any stream of files.
    """

    def lengths(frames):
        for frame in frames:
            sizes = []
            for path in frame["path"]:
                with opened(path) as clip:
                    sizes.append(clip.getnframes())
            frame["length"] = sizes
            yield frame

    rows = clips.filter("session is not null and path is not null").selectExpr("cast(session as string) session", "cast(number as long) number", "path")
    found = rows.mapInPandas(lengths, "session string, number long, path string, length long").orderBy("session", "number", "path").collect()
    sessions: dict[str, list[list]] = {}
    for r in found:
        sessions.setdefault(r.session, []).append([r.path, r.length])
    spark.dataSource.register(Replay)
    return spark.readStream.format("replay").options(sessions=json.dumps(sessions), began=str(began), speed=str(speed)).load()
