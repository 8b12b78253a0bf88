"""Sounds of a batch are kept in Arrow's form: Python's strings of a few texts at a time, whatever the batch."""

import tracemalloc

import pyarrow as pa

from textloom.functions import sounds as S


def test_python_strings_do_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 2_000)
    peaks = []
    for n in (20, 100):
        texts = pa.array(["مِنْ بَعْدِ " * 50] * n)
        tracemalloc.start()
        out = S.sounds_of.func(texts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert out.to_pylist() == [S.sounds(t) for t in texts.to_pylist()]
    assert peaks[1] < 2 * peaks[0], peaks


def test_empty_and_null():
    assert S.sounds_of.func(pa.array([], pa.string())).to_pylist() == []
    assert S.sounds_of.func(pa.array([None], pa.string())).to_pylist() == [S.sounds(None)]
