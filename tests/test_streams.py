"""Streams over files, and the parts of stitching and of sources."""

import pytest

from pyspark.sql import functions as F

from textloom.sources import files
from textloom.streaming import stitch, windows


@pytest.mark.parametrize("old, new, at", [("a b c d", "c d e", {2}), ("a b c d x", "b c d e", {1}), ("a b x", "a b c", set()), ("a b a b", "a b a b", {0, 2}), ("a b", "x y", set())])
def test_overlap(old, new, at):
    assert stitch.overlap_starts(old.split(), new.split()) == at


def test_stitched_windows_of_a_session():
    s = stitch.Stitched()
    assert s.add(0, "one two three".split(), False) and s.add(0, "one two three four".split(), False)
    assert s.add(4, "three four five".split(), False) and s.words == "one two three four five".split()
    assert not s.add(8, "seven eight".split(), False) and s.add(8, "seven".split(), True)
    assert s.words[-2:] == ["five", "seven"] and not s.add(2, ["late"], False)
    assert not s.add(9, [], True) and s.words[-1] == "seven"  # an empty window changes nothing
    assert not s.add(10, "three four six".split(), False)  # an overlap with older windows is none
    s.commit(12)
    assert s.add(14, "after it".split(), True) and s.words[-3:] == ["seven", "after", "it"]


def test_ambiguous_even_in_silence():
    s = stitch.Stitched()
    assert s.add(0, "a b a b".split(), False) and not s.add(4, "a b a b".split(), True)


def test_buffer_and_retention():
    b = stitch.Buffer(4)
    b.append([1, 2, 3])
    with pytest.raises(OverflowError):
        b.append([4, 5])
    b.discard_before(2)
    b.append([4, 5])
    assert b.read(2, 5).tolist() == [3, 4, 5] and b.end == 5
    with pytest.raises(IndexError):
        b.read(1, 3)
    assert [stitch.kept_after(100, 60, 10, *f) for f in ((True, False, False), (False, False, False), (True, True, False), (True, False, True))] == [50, 100, 100, 100]


@pytest.mark.parametrize("rate, to", [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000)])
def test_resampling_goes_on_over_chunks(rate, to):
    x = [float(i % 17) for i in range(1_000)]
    r, got = stitch.Resampler(rate, to), []
    for at in range(0, 1_000, 37):
        got += r.push(x[at : at + 37])
    places = [i * rate / to for i in range(len(got))]
    assert got == pytest.approx([x[int(p)] + (x[min(int(p) + 1, 999)] - x[int(p)]) * (p - int(p)) for p in places], abs=1e-6)
    assert abs(len(got) - 1_000 * to / rate) <= 2


def test_stitch_stream(spark, tmp_path):
    rows = [("s", 0, "one two three", False), ("t", 0, None, False), ("s", 4, "two three four", False), ("s", 8, "lost words", False)]
    spark.createDataFrame(rows, "session string, origin long, transcript string, silent boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, origin long, transcript string, silent boolean").parquet(str(tmp_path / "in"))
    run = stitch.stitch_stream(stream).writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r.session, r.origin): (r.transcript, r.joined) for r in spark.table("stitched").collect()}
    assert got == {("s", 0): ("one two three", True), ("s", 4): ("one two three four", True), ("s", 8): (None, False), ("t", 0): (None, False)}


def test_windows_on_a_stream(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    args = (["user_id"], "ts", "8 hours", "4 hours", [F.count("*").alias("n")])
    run = windows.sliding_counts(stream, *args).writeStream.format("memory").queryName("slid").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    cols = ["user_id", "n", F.col("window_start").cast("string")]
    assert sorted(map(tuple, spark.table("slid").select(cols).collect())) == sorted(map(tuple, windows.sliding_counts(table, *args).select(cols).collect()))


def test_sources(spark, tmp_path):
    path = tmp_path / "set_a"
    path.mkdir()
    (path / "m.jsonl").write_text('{"name": "002255_3.wav", "s": 1.5}\n\nbroken\n{"name": "other.wav", "s": null}\n')
    rows = files.read_manifests(spark, f"{tmp_path}/set_*", "name string, s double", folder=r"set_(\w+)/")
    chapter, verse = files.clip_key(F.col("name"))
    assert {(r.folder, r.c, r.v) for r in rows.select("folder", chapter.alias("c"), verse.alias("v")).collect()} == {("a", 2, 255), ("a", None, None)}
    good, bad = files.route(rows, F.col("s") > 1)
    assert good.count() == 1 and bad.count() == 1
    files.write_new(good, str(tmp_path / "out"), "folder")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_new(good, str(tmp_path / "out"), "folder")
