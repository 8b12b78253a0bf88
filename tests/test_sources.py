"""Sources and sinks over small files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import files


def test_validated_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1, "s": 3.0}\n\nnot json\n{"a": 2, "s": 90.0}\n{"s": 1.0}\n')
    good, bad = files.read_validated(spark, f"file://{tmp_path}/m.jsonl", "a int, s double", {"key": F.col("a").isNotNull(), "length": F.col("s") <= 30})
    assert [(r.a, r.s) for r in good.collect()] == [(1, 3.0)]
    assert sorted(sum((r.reasons for r in bad.collect()), [])) == ["json", "key", "key", "length", "length"]


def test_nested_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 7, "items": [{"n": 1, "t": "x"}, {"n": 2, "t": "y"}]}, indent=1))
    rows = files.read_nested(spark, f"file://{tmp_path}/a.json", "id int, items array<struct<n:int,t:string>>", "items").collect()
    assert [(r.id, r.place, r.n, r.t) for r in rows] == [(7, 0, 1, "x"), (7, 1, 2, "y")]


def test_python_literals(spark):
    values = [[{"a": 1, "b": "x", "ok": True}, {"a": None, "b": "it's None, True", "ok": False}], []]
    df = spark.createDataFrame([(repr(v),) for v in values], "t string")
    got = [r.v for r in df.select(files.literal(F.col("t"), "array<struct<a:int,b:string,ok:boolean>>").alias("v")).collect()]
    assert [[tuple(x) for x in v] for v in got] == [[(1, "x", True), (None, "it's None, True", False)], []]


def test_csv_with_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "so"'), (2, None)], "k int, v string").coalesce(1)
    files.write_csv(df, f"file://{tmp_path}/out")
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b'\xef\xbb\xbf"k","v"') or raw.startswith(b'"\xef\xbb\xbfk","v"')
    back = files.read_csv(spark, f"file://{tmp_path}/out", "k int, v string").orderBy("k").collect()
    assert [(r.k, r.v) for r in back][0] == (1, 'say "so"')
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_csv(df, f"file://{tmp_path}/out")


def test_parts_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "part int, v string")
    one = {r.part: (r.rows, r.digest) for r in files.write_parts(df, f"file://{tmp_path}/a", "part").collect()}
    two = {r.part: (r.rows, r.digest) for r in files.write_parts(df.repartition(3), f"file://{tmp_path}/b", "part").collect()}
    assert one == two and one[1][0] == 2 and (tmp_path / "a/parts/part=2").is_dir()


def test_relocation(spark, tmp_path):
    (tmp_path / "from").mkdir()
    for n in "xy":
        (tmp_path / "from" / n).write_bytes(n.encode() * 9)
    out = files.relocate(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to").collect()
    assert sorted((r.name, r.moved) for r in out) == [("x", True), ("y", True)]
    with pytest.raises(FileExistsError):
        files.relocate(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to")


def test_folder_inventory(spark, tmp_path):
    for name, size in (("a/x.wav", 3), ("a/y.wav", 5), ("a/z.txt", 7), ("b/c/w.wav", 11)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"." * size)
    got = {r.folder.removeprefix(f"file:{tmp_path}/"): (r.files, r.bytes) for r in files.folder_inventory(spark, str(tmp_path), "*.wav").collect()}
    assert got == {"a": (2, 8), "b/c": (1, 11)} and files.folder_inventory(spark, str(tmp_path), "*.none").count() == 0
