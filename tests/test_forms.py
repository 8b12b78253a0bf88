"""Normal forms take few passes over a text, and what Python makes of a batch is kept in Arrow's form."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import arabic as A


def test_few_patterns(spark):
    df = spark.createDataFrame([("",)], "t string")
    for form, most in ((A.asr_form_v1, 8), (A.asr_form, 12), (A.vowelled_form, 5)):
        plan = df.select(form(F.col("t")).alias("f"))._jdf.queryExecution().analyzed().toString()
        n = plan.splitlines()[0].count("regexp_replace(")
        assert 0 < n <= most, (form.__name__, n)


def test_short_words_at_once(spark):
    rows = [(f"{a}{long}{b}", short) for long, short in A.SHORT_SPELLINGS for a, b in (("", ""), ("كتب ", " كتب"))]
    got = spark.createDataFrame(rows, "t string, short string").select("short", A.asr_form_v1(F.col("t")).alias("f"))
    assert all(r.short.translate(str.maketrans("إ", "ا")) in r.f.split(" ") for r in got.collect())
    inside = spark.createDataFrame([("كهاذا",)], "t string").select(A.asr_form_v1(F.col("t"))).first()[0]
    assert inside == "كهاذا"


def test_python_strings_do_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(A, "AT_ONCE", 2_000)
    for form in (A.word_key, A.nfc):
        peaks = []
        for n in (20, 400):
            texts = pa.array(["رَحْمَـٰن été " * 50] * n)
            tracemalloc.start()
            form.func(texts)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 5 * peaks[0], peaks
        assert form.func(pa.array([None, "", "a"], pa.string())).to_pylist() == [None, "", "a"]
