"""Following readers: the state machine, live sound with recovery, paired streams, replayed clips; all with restarts."""

import sys
import time
import wave
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle

from textloom.operators import openings
from textloom.sources import replay
from textloom.streaming import live, paired, stitch, tracker

OPEN = ("in the name of peace".split(), "we begin right here".split())


def reader(*lines, **settings):
    own = [tracker.Line(i + 1, x.split()) for i, x in enumerate(lines)]
    return tracker.Reading(lambda k: own[k] if k < len(own) else None, tracker.Settings(openings=OPEN, **settings))


class Told:
    """Feeds a reading and keeps the last verdict on each line."""

    def __init__(self, *lines):
        self.r, self.v = reader(*lines), {}

    def __call__(self, text, **how):
        self.changed, out = self.r.feed(text.split(), **how)
        self.v |= {v.line: v for v in out}
        return self

    def marks(self, line):
        return "".join(w.status[0] for w in self.v[line].words)

    @property
    def at(self):
        return self.r.current and self.r.current.number


RIVER = ("the river runs to sea", "it never rests", "stones are its bed")


def test_a_line_needs_two_feeds_a_pause_or_steady_words():
    t = Told(*RIVER)
    assert t("the river runs to").at == 1 and t.v[1].status == "correct" and not t.v[1].closed
    assert t("the river runs to sea").at == 1 and t("the river runs to sea").at == 2 and t.v[1].closed
    assert Told(*RIVER)("the river runs to sea", final=True).at == 2
    assert Told(*RIVER)("the river runs to sea", steady=5).at == 2 and Told(*RIVER)("the river runs to sea", steady=4).at == 1


@pytest.mark.parametrize("heard", ["sea", "the river runs to see", "nothing of the kind", ""])
def test_what_does_not_end_a_line(heard):
    t = Told(*RIVER)(heard, final=True)
    assert t.at == 1 and (heard or not t.v)


def test_omissions_are_told_once_confirmed():
    t = Told(*RIVER)
    assert t("the runs to").marks(1) == "cpccp" and t("the runs to").marks(1) == "cmccp" and t.at == 1
    assert t("the river runs to").marks(1) == "ccccp"
    assert Told(*RIVER)("the runs", final=True).marks(1) == "cmcpp"
    short = Told("go now then", "and rest")("go then", final=True)
    assert short.marks(1) == "cmc" and short.at == 2 and short.v[1].status == "correct" and short.v[1].missing == ["now"]
    low = Told("one two three four five", "and rest")("one five", final=True)
    assert low.at == 2 and low.v[1].status == "missed"


def test_words_in_order_and_by_number():
    t = Told("so so it is")
    assert t("so it is", final=True).marks(1) == "cmcc" and t.at is None
    assert Told("a b c")("c b a", final=True).marks(1).count("c") < 3
    assert not Told("a b c")("a b c", final=True)("more words", final=True).changed


def test_later_lines_close_those_before():
    t = Told(*RIVER)
    t("it never rests")
    assert t.at == 1 and t("it never rests").at == 3
    assert (t.v[1].status, t.v[1].closed, t.marks(1)) == ("missed", True, "mmmmm") and t.v[2].status == "correct"
    kept = Told(*RIVER)("the river")("it never rests", final=True)
    assert kept.marks(1) == "ccmmm"
    partly = Told(*RIVER)("the river runs to")("the river runs to it never rests", final=True)
    assert partly.at == 3 and partly.marks(1) == "ccccm"
    far = Told("a b", "c d", "e f", "g h", "i j")
    assert far("i j", final=True).at == 1 and far("g h", final=True).at == 5


def test_jumps_credit_what_was_heard_on_the_way():
    lines = ("five ships came home today", "nobody knew where the captain had left them", "every sailor sang until the moon went down")
    t = Told(*lines)(f"five ships came home todey {lines[1]} {lines[2]}", final=True, continuous=True)
    assert t.v[2].status == "correct" and t.marks(2) == "c" * 8 and t.v[1].status == "correct"
    gone = Told(*lines)(f"five ships came home todey {lines[2]}", final=True, continuous=True)
    assert gone.marks(2) == "m" * 8 and gone.v[2].status == "missed"


def test_context_that_is_heard_again():
    t = Told(*RIVER)
    t(RIVER[0], final=True, continuous=True)
    assert t(RIVER[0], final=True, continuous=True).at == 2 and 2 not in t.v
    assert t(f"{RIVER[0]} {RIVER[2]}", final=True, continuous=True).at is None and t.marks(2) == "mmm"
    assert t.r.context == f"{RIVER[0]} {RIVER[2]}".split()
    long = Told(" ".join(f"w{i}" for i in range(120)), "the end")(" ".join(f"w{i}" for i in range(120)), final=True, continuous=True)
    assert len(long.r.context) == 80 and long.r.context[-1] == "w119"


def test_a_lone_word_waits_for_another():
    t = Told(*RIVER)(f"{RIVER[0]} it", final=True, continuous=True)
    assert t.at == 2 and t.r.tentative and 2 not in t.v
    assert t(f"{RIVER[0]} it never rests", final=True, continuous=True).v[2].status == "correct"
    over = Told(*RIVER)(f"{RIVER[0]} it", final=True, continuous=True)(f"{RIVER[0]} it {RIVER[2]}", final=True, continuous=True)
    assert over.at is None and over.marks(2) == "mmm"
    new = Told(*RIVER)(RIVER[0], final=True, continuous=True)
    new.r.context = []
    assert new("it", final=True, continuous=True).r.tentative and new("it never rests", final=True, continuous=True).at == 3


def test_lost_sound_accuses_nobody():
    t = Told(*RIVER)("the runs")
    t.r.doubt()
    assert t("the runs to", final=True).marks(1) == "cpccp" and t.v[1].status == "listening"
    assert t("it never rests", final=True).marks(1) == "cpccp" and t.v[1].status == "listening"


def test_openings():
    assert openings.opening_length("in a name of peace we begin right here x".split(), OPEN) == 9
    assert openings.opening_length("in the name".split(), OPEN) == 0 and openings.opening_length([], OPEN) == 0
    t = Told("we begin again", "right here")
    assert t("in the name of peace we begin right here", final=True).v == {} and t.at == 1
    assert t("in the name of peace we begin right here we begin again", final=True).at == 2
    assert t("we begin right here", final=True).v[2].status == "correct"  # behind the first line they are words like others


def test_tags_go_with_matched_words():
    t = Told("one two three")("in the name of peace one two four", tags=[[]] * 5 + [["x"], ["y", "z"], ["lost"]])
    assert [list(w.tags) for w in t.v[1].words] == [["x"], ["y", "z"], []]
    assert all(not w.tags for w in Told("one two")("one two", tags=[["x"]]).v[1].words)


# On Spark


FEEDS = "session string, seq long, heard array<string>, final boolean, continuous boolean, steady int, tags array<array<string>>"
LINES = "session string, line int, words array<string>"


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def run_stream(df, at):
    """Run what is there, going on from the checkpoint; all rows so far."""
    q = df.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(str(at / "out")).collect()


def test_tracker_over_a_table_and_a_restarted_stream(spark, tmp_path):
    texts = [RIVER[0][:14], RIVER[0], f"{RIVER[0]} it", f"{RIVER[0]} it never rests", "stones its", "stones its", "stones are its bed", "more"]
    feeds = [("a", k, x.split(), k in (3, 6), True, 0, [["g"]] * len(x.split())) for k, x in enumerate(texts)]
    feeds += [("b", 0, None, None, None, None, None), ("b", 1, ["x"], True, False, 0, None), ("c", 5, RIVER[1].split(), True, True, 3, None), ("c", 4, ["late"], True, True, 0, None), ("c", None, ["x"], True, True, 0, None)]
    df = spark.createDataFrame(feeds, FEEDS)
    lines = spark.createDataFrame([(s, i + 1, x.split()) for s in "ac" for i, x in enumerate(RIVER)] + [("c", 2, ["again"]), ("c", None, ["x"]), (None, 1, ["x"])], LINES)
    batch = {(r.session, r.seq): r for r in tracker.track(df, lines).collect()}
    assert set(batch) == {("a", k) for k in range(8)} | {("b", 0), ("b", 1), ("c", 4), ("c", 5)}
    assert all(batch["b", k].complete and not batch["b", k].verdicts for k in (0, 1))
    told = tracker.Reading(lambda k: tracker.Line(k + 1, RIVER[k].split()) if k < 3 else None)
    for k, x in enumerate(texts):
        changed, verdicts = told.feed(x.split(), k in (3, 6), True, 0, [["g"]] * len(x.split()))
        row = batch["a", k].asDict(recursive=True)
        assert (row["advanced"], row["verdicts"], row["current"]) == (changed, tracker.verdict_rows(verdicts), told.current and told.current.number), k

    (tmp_path / "in").mkdir()
    halves = [df.filter("session != 'a' or seq < 4"), df.filter("session = 'a' and seq >= 3")]  # one feed twice
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FEEDS).parquet(str(tmp_path / "in"))
        got = run_stream(tracker.track(stream, lines), tmp_path)
    assert len(got) == len(batch) and all(r == batch[r.session, r.seq] for r in got)


#: Letters as loudness: a word is a stretch of samples, white space is silence.
SLOW = live.Timing(rate=20, silent=0.001, frame=0.05)


def spoken(text, pause=24):
    out = [0.0]
    for c in text.encode():
        out += [0.0] * pause if c == 10 else [0.0] if c == 32 else [(c + 1) / 512]
    return np.array(out, np.float32)


def listened(sound, whole):
    """Words that lie within the sound; those cut at its edges are not understood."""
    text = bytes(0 if x == 0 else round(float(x) * 512) - 1 for x in sound).decode(errors="ignore")
    words = text.replace("\0", " ")
    begin = 0 if not words or words[0] == " " else words.find(" ")
    end = len(words) if whole or words[-1:] == " " else words.rfind(" ")
    return words[max(begin, 0) : max(end, 0)] if begin >= 0 else ""


STORY = ["morning came over the quiet hill", "two old men walked to the well", "they spoke of rain and of their sons", "none had come home since the war", "evening found them still at the well"]


def told_by(sound, size, decode=listened, lines=STORY, stop=True, timing=SLOW):
    own = [tracker.Line(i + 1, x.split()) for i, x in enumerate(lines)]
    s = live.Live(tracker.Reading(lambda k: own[k] if k < len(own) else None), decode, timing)
    out = [x for at in range(0, len(sound), size) for x in s.hear(at, sound[at : at + size])]
    return s, out + list(s.hear(len(sound), [], stop))


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_live_lines_are_read_whatever_the_chunks(size):
    s, out = told_by(spoken("\n".join(STORY) + "\n"), size)
    last = {v.line: v for x in out for v in x.verdicts}
    assert [last[k].status for k in range(1, 6)] == ["correct"] * 5 and all(not last[k].missing for k in last)
    assert s.reading.current is None and out[-1].kind == "finished" and not s.reading.doubtful


def test_live_omissions_and_lag():
    said = "\n".join([STORY[0], "two old walked to the well", STORY[2]])
    s, out = told_by(spoken(said + "\n"), 16, lines=STORY[:3])
    last = {v.line: v for x in out for v in x.verdicts}
    assert last[2].missing == ["men"] and last[2].closed and last[3].status == "correct"
    assert s.sound.end - s.decoded < SLOW.samples(SLOW.step) or s.reading.current is None


def test_silence_moves_the_frontier_without_decoding():
    def never(sound, whole):
        raise AssertionError("silence was decoded")

    s, out = told_by(np.zeros(2_000), 50, decode=never)
    assert {x.kind for x in out} == {"silence", "finished"} and s.decoded == 2_000 and len(s.sound.samples) <= SLOW.samples(SLOW.lead) and s.origin > 1_900


def test_a_failed_join_widens_and_a_second_one_resets():
    text = " ".join(f"word{i:02d}" for i in range(60))
    sizes = []

    def odd(sound, whole):
        sizes.append(len(sound))
        fine = np.array_equal(sound[:20], spoken(text)[:20]) or max(sizes) > SLOW.samples(SLOW.usual)
        return listened(sound, whole) if fine else "no such words"

    s, out = told_by(spoken(text), 16, decode=odd, lines=[text])
    assert any(x.widened and x.joined for x in out) and max(sizes) > SLOW.samples(SLOW.usual) and not s.reading.doubtful

    def worse(sound, whole):
        sizes.append(len(sound))
        return listened(sound, whole) if len(sizes) < 12 or len(sizes) > 18 else ""

    sizes.clear()
    s, out = told_by(spoken(text), 16, decode=worse, lines=[text])
    failed = [k for k, x in enumerate(out) if x.joined is False]
    assert failed and out[failed[0]].widened and s.reading.doubtful
    assert any(x.joined for x in out[failed[0] + 1 :])  # it goes on
    assert not any(w.status == "missed" for x in out[failed[0] :] for v in x.verdicts for w in v.words)


def test_sound_that_is_kept_is_bounded():
    text = " ".join(f"word{i:03d}" for i in range(400))
    kept = []
    own = [tracker.Line(1, text.split())]
    s = live.Live(tracker.Reading(lambda k: own[0] if k == 0 else None), listened, SLOW)
    sound = spoken(text)
    for at in range(0, len(sound), 16):
        list(s.hear(at, sound[at : at + 16]))
        kept.append(len(s.sound.samples))
    assert max(kept) <= SLOW.samples(SLOW.widened) + 20
    tiny = SLOW._replace(most=1.0)
    assert any(x.kind == "overflow" for x in told_by(sound, 16, timing=tiny)[1])


def test_chunks_again_late_and_lost():
    sound = spoken("\n".join(STORY[:2]) + "\n")
    own = [tracker.Line(i + 1, x.split()) for i, x in enumerate(STORY[:2])]
    s = live.Live(tracker.Reading(lambda k: own[k] if k < 2 else None), listened, SLOW)
    for at in range(0, len(sound), 20):
        list(s.hear(at, sound[at : at + 20]))
        list(s.hear(at, sound[at : at + 20]))
        list(s.hear(max(0, at - 10), sound[max(0, at - 10) : at + 20]))
    list(s.hear(len(sound), [], True))
    assert s.sound.end == len(sound) and s.reading.current is None and not s.reading.doubtful
    s = live.Live(tracker.Reading(lambda k: own[k] if k < 2 else None), listened, SLOW)
    list(s.hear(0, sound[:20])), list(s.hear(40, sound[40:60]))
    assert s.reading.doubtful and s.sound.end == 60


SOUND = "session string, start long, samples array<float>, at timestamp, stop boolean"


def chunks(session, text, size, stop):
    sound, t0 = spoken(text), datetime(2024, 1, 1)
    return [(session, at, sound[at : at + size].tolist(), t0 + timedelta(seconds=(at + size) / SLOW.rate), stop and at + size >= len(sound)) for at in range(0, len(sound), size)]


def test_live_stream_with_restart_and_idle_end(spark, tmp_path):
    text = "\n".join(STORY) + "\n"
    lines = spark.createDataFrame([(s, i + 1, x.split()) for s in "ab" for i, x in enumerate(STORY)], LINES)
    a, b = chunks("a", text, 20, True), chunks("b", text[:80], 20, False)
    late = [("z", 0, [], datetime(2024, 1, 2), False)]  # moves the watermark past the others' ends
    rows = lambda xs: spark.createDataFrame(xs, SOUND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    for part in (a[:8] + b, a[7:], late, [("z", 1, [], datetime(2024, 1, 3), False)]):
        rows(part)
        stream = spark.readStream.schema(SOUND).parquet(str(tmp_path / "in"))
        got = run_stream(live.follow_live(stream, lines, listened, SLOW), tmp_path)
    _, want = told_by(spoken(text), 40, stop=True)
    got.sort(key=lambda r: (r.heard_s, r.kind == "finished", r.decoded_s))
    own = [r for r in got if r.session == "a"]
    last = lambda rs: {v.line: (v.status, v.closed, tuple(v.missing)) for x in rs for v in x.verdicts}
    assert last(own) == last(want) == {k: ("correct", True, ()) for k in range(1, 6)}
    assert own[-1].kind == "finished" and own[-1].complete and sum(r.kind == "finished" for r in own) == 1
    assert all(r.pending_s == pytest.approx(max(0, r.heard_s - r.decoded_s), abs=2e-3) for r in got)
    ended = [r for r in got if r.session == "b"]
    assert ended[-1].kind == "finished" and ended[-1].pending_s == 0 and last(ended)[1][0] == "correct" and not ended[-1].complete


def test_live_table(spark):
    rows = chunks("a", "\n".join(STORY), 64, False) + [("b", None, [1.0], None, None), ("c", 0, None, None, None)]
    lines = spark.createDataFrame([("a", i + 1, x.split()) for i, x in enumerate(STORY)], LINES)
    got = live.follow_live(spark.createDataFrame(rows, SOUND).repartition(3), lines, listened, SLOW).collect()
    own = [r for r in got if r.session == "a"]
    assert {v.line: v.status for r in own for v in r.verdicts} == {k: "correct" for k in range(1, 6)} and own[-1].kind == "finished"
    assert {r.kind for r in got if r.session in "bc"} == {"finished"}


PAIRS = "session string, window long, at timestamp, text string"


def test_paired_streams(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    words = [("a", 1, at(10), "one two three"), ("a", 2, at(12), "four five"), ("b", 1, at(11), None), ("a", 3, at(14), "six"), (None, 1, at(10), "seven"), ("a", 9, None, "eight")]
    tags = [("a", 1, at(11), "one<x> too three<y>"), ("a", 3, at(40), "six<far>"), ("c", 1, at(10), "lost<z>"), (None, 1, at(10), "seven<n>")]
    for n, xs in (("w", words), ("t", tags)):
        spark.createDataFrame(xs, PAIRS).write.parquet(str(tmp_path / f"table-{n}"))
    table = paired.paired_streams(spark.read.parquet(str(tmp_path / "table-w")), spark.read.parquet(str(tmp_path / "table-t"))).collect()
    shape = lambda rs: {(r.session, r.window): [(w.word, list(w.tags)) for w in r.words] for r in rs}
    want = {("a", 1): [("one", ["x"]), ("two", []), ("three", ["y"])], ("a", 2): [("four", []), ("five", [])], ("b", 1): [], ("a", 3): [("six", [])], (None, 1): [("seven", [])]}
    assert shape(table) == want

    # Tags first or words first, in several batches; the last one moves both watermarks.  Tags for window 2 come too late.
    steps = [(words[:1], tags[2:]), ([], tags[:1]), (words[1:], tags[1:2]), ([("y", 1, at(100), "end")], [("y", 2, at(100), "end")]), ([("y", 1, at(200), "end")], [("a", 2, at(12), "four<late>")]), ([("y", 3, at(300), "end")], [("y", 4, at(300), "end")])]
    for w, t in steps:
        for name, xs in (("w", w), ("t", t)):
            spark.createDataFrame(xs, PAIRS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
        sides = [spark.readStream.schema(PAIRS).parquet(str(tmp_path / f"in-{x}")) for x in "wt"]
        got = run_stream(paired.paired_streams(*sides), tmp_path)
    real = [r for r in got if r.session != "y"]
    assert shape(real) == want and len(real) == len(want)


def clip(path, samples):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(replay.RATE)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return str(path)


def test_replay_resumes_at_its_offset(spark, tmp_path):
    rng = np.random.default_rng(1)
    clips = {("a", 2): rng.integers(-9_000, 9_000, 20_000), ("a", 1): rng.integers(-9_000, 9_000, 5_000), ("b", 1): rng.integers(-9_000, 9_000, 400_000)}
    rows = [(s, k, clip(tmp_path / f"{s}{k}.wav", x)) for (s, k), x in clips.items()]
    df = spark.createDataFrame([*rows, (None, 1, "none"), ("c", 1, None)], "session string, number int, path string")
    quiet = np.zeros(replay.GAP)
    want = {"a": np.concatenate([clips["a", 1], quiet, clips["a", 2], quiet]), "b": np.concatenate([clips["b", 1], quiet])}
    began, ends = time.time() + 1, []
    for n in range(2):
        stream = replay.replay(spark, df, began, speed=1.0 if n == 0 else 1_000.0)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            if n == 0:
                while not q.lastProgress or not q.lastProgress["numInputRows"]:
                    time.sleep(0.05)
            else:
                q.processAllAvailable()
        finally:
            q.stop()
        got = spark.read.schema(replay.SCHEMA).parquet(str(tmp_path / "out")).collect()
        ends.append(max(r.start for r in got))
    assert 0 < ends[0] < ends[1] and len({(r.session, r.start) for r in got}) == len(got)
    for s, sound in want.items():
        own = sorted((r for r in got if r.session == s), key=lambda r: r.start)
        assert np.array_equal(np.round(np.concatenate([r.samples for r in own]) * 32_768), sound)
        assert [r.stop for r in own] == [False] * (len(own) - 1) + [True]
        assert (own[-1]["at"] - own[0]["at"]).total_seconds() == pytest.approx((len(sound) - replay.FRAME) / replay.RATE, abs=1e-3)


def test_replay_refuses_other_clips_and_a_later_begin(tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(replay.RATE)
    with pytest.raises(ValueError, match="mono"):
        replay.opened(str(tmp_path / "x.wav"))
    r = replay.ReplayReader({"sessions": '{"s": [["p", 100]]}', "began": "0", "speed": "1"})
    assert r.latestOffset() == {"frame": 8} and r.partitions({"frame": 8}, {"frame": 8}) == []
    with pytest.raises(ValueError, match="began"):
        r.partitions({"frame": 5}, {"frame": 4})


def test_stitched_reset():
    s = stitch.Stitched()
    s.add(0, ["a", "b"], False)
    s.reset()
    assert s.words == [] and s.add(5, ["c"], False)
