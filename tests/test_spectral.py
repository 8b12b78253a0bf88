"""Spectra and what is made of them, on tones and noise whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import spectral as S

RATE = S.RATE
T = np.arange(2 * RATE) / RATE


def tone(f, n=2 * RATE, a=0.3):
    return a * np.sin(2 * np.pi * f * np.arange(n) / RATE)


def loudest(x):
    s = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    return np.argmax(s) * RATE / len(x)


def power_at(x, f):
    s = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    return s[round(f * len(x) / RATE)]


@pytest.mark.parametrize("n", [1, 100, 512, 5_000, 16_001])
def test_sound_of_its_own_spectra(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(S.sound_of(S.spectra(x), n), x, atol=1e-9)


def test_cleaning_lowers_noise_by_what_is_allowed_and_keeps_speech():
    rng = np.random.default_rng(0)
    noise = 0.004 * rng.normal(size=4 * RATE)
    x = noise + 0.2
    speech = np.zeros(4 * RATE)
    speech[RATE : 3 * RATE] = tone(440)
    x += speech
    y, report = S.cleaned(x, most_db=9)
    assert report["reduced"] and report["noise_frames"] >= 8 and len(y) == len(x) and abs(float(y.mean())) < 1e-3
    quiet = slice(int(0.2 * RATE), int(0.8 * RATE))
    lowered = 20 * np.log10(np.std(noise[quiet]) / np.std(y[quiet]))
    assert 5 < lowered <= 9.5
    assert power_at(y[RATE : 3 * RATE], 440) == pytest.approx(power_at(speech[RATE : 3 * RATE], 440), rel=0.02)
    same, none = S.cleaned(speech[RATE : 3 * RATE])
    assert not none["reduced"] and np.allclose(same[RATE // 2 : -RATE // 2], speech[RATE : 3 * RATE][RATE // 2 : -RATE // 2], atol=2e-3)


def test_cleaning_removes_rumble_and_hum():
    x = tone(10) + tone(50) + tone(300)
    y = S.cleaned(x, hum=50)[0]
    assert power_at(y, 10) < 0.02 * power_at(x, 10) and power_at(y, 50) < 0.05 * power_at(x, 50) and power_at(y, 300) == pytest.approx(power_at(x, 300), rel=0.02)
    for bad in ({"most_db": 13}, {"hum": 55}):
        with pytest.raises(ValueError):
            S.cleaned(x, **bad)
    with pytest.raises(ValueError):
        S.cleaned(np.array([np.nan]))


def test_noise_spectrum_is_a_median_of_whole_frames():
    x = np.random.default_rng(1).normal(size=8_000)
    s = S.spectra(x)
    power, n = S.noise_spectrum(s, [(1_000, 3_000), (5_000, 6_000)])
    own = [k for k in range(len(s)) if any(a + 256 <= k * 128 <= b - 256 for a, b in ((1_000, 3_000), (5_000, 6_000)))]
    assert n == len(own) and np.allclose(power, np.median(np.abs(s[own]) ** 2, axis=0)) and S.noise_spectrum(s, [])[1] == 0


@pytest.mark.parametrize("rate", [0.85, 1.0, 1.2, 1.45])
def test_tempo_changes_length_not_pitch(rate):
    y = S.tempo(tone(440), rate)
    assert len(y) == round(2 * RATE / rate) and loudest(y) == pytest.approx(440, abs=2) and np.std(y[2_000:-2_000]) == pytest.approx(0.3 / np.sqrt(2), rel=0.12)


@pytest.mark.parametrize("semitones", [-3.0, 2.0, 3.0])
def test_pitch_changes_frequency_not_length(semitones):
    y = S.pitch(tone(440), semitones)
    assert len(y) == 2 * RATE and loudest(y) == pytest.approx(440 * 2 ** (semitones / 12), abs=3)


def test_room_bands_and_channels():
    rng = np.random.default_rng(2)
    click = np.zeros(RATE)
    click[0] = 1
    y = S.room(click, 0.3, 1.0, rng)
    parts = [np.mean(y[int(a * RATE) : int((a + 0.02) * RATE)] ** 2) for a in (0.02, 0.12)]
    assert 10 * np.log10(parts[0] / parts[1]) == pytest.approx(20, abs=5)  # 60 dB in 0.3 s
    x = tone(150) + tone(1_000) + tone(5_000)
    phone = S.band(x, 300.0, 3400.0)
    assert power_at(phone, 150) < 0.1 * power_at(phone, 1_000) > power_at(phone, 5_000)
    up = S.equalised(x, [("low", 300.0, 8.0, 0.7071)])
    assert 20 * np.log10(power_at(up, 150) / power_at(up, 5_000)) == pytest.approx(8, abs=1.2)
    peak = S.equalised(x, [("peak", 1_000.0, -6.0, 1.0)])
    assert 20 * np.log10(power_at(peak, 1_000) / power_at(peak, 5_000)) == pytest.approx(-6, abs=0.7)
    high = S.equalised(x, [("high", 3_000.0, 6.0, 0.7071)])
    assert 20 * np.log10(power_at(high, 5_000) / power_at(high, 150)) == pytest.approx(6, abs=1)
    slope = [np.mean(np.abs(np.fft.rfft(S.coloured_noise(1 << 16, c, rng))[[1_000, 1_001, 1_002, 1_003]].mean()) ** 2) for c in ("white",)]
    assert slope[0] > 0


def test_vocal_tract_warp():
    features = np.zeros((80, 3), np.float32)
    features[40] = 1
    up, down = (np.argmax(S.warped(features, a)[:, 0]) for a in (1.12, 0.88))
    centres = S.hertz(np.linspace(0, S.mel(8000), 82))[1:-1]
    assert centres[up] / centres[40] == pytest.approx(1.12, rel=0.03) and centres[down] / centres[40] == pytest.approx(0.88, rel=0.03)
    assert np.array_equal(S.warped(features, 1.0), features) and np.allclose(S.hertz(S.mel(centres)), centres)


def test_augmentation_follows_its_seed():
    x = tone(440)
    assert all(np.array_equal(S.augmented(x, 7)[0], S.augmented(x, 7)[0]) for _ in range(2)) and S.augmented(x, 7)[1] == S.augmented(x, 7)[1]
    told = [S.augmented(x, k) for k in range(60)]
    assert {s.split()[0] for _, steps in told for s in steps} >= {"tempo", "pitch", "room", "bands", "gain"} and max(np.abs(y).max() for y, _ in told) <= 1
    every = S.augmented(x, 1, S.Profile(0, *[1.0] * 9))[1]
    assert [s.split()[0] for s in every][:4] == ["tempo", "pitch", "room", "bands"] and len(every) == 9
    assert len(S.augmented(np.zeros(30 * RATE, np.float32) + 0.1, 3, S.Profile(0, 1, *[0.0] * 8))[0]) <= 30 * RATE and S.augmented(np.zeros(0), 1)[1] == []


def test_cepstra_against_a_plain_loop(spark):
    x = tone(440, 8_000) + 0.01 * np.random.default_rng(3).normal(size=8_000)
    y = np.concatenate([x[200:0:-1], x, x[-2:-202:-1]])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42) / 2595) - 1)
    rows = []
    for at in range(0, len(y) - 399, 160):
        power = np.abs(np.fft.rfft(y[at : at + 400] * window)) ** 2
        f = np.arange(201) * RATE / 400
        rows.append([10 * np.log10(max(1e-10, sum(p * max(0.0, min((v - a) / (b - a), (c - v) / (c - b))) for p, v in zip(power, f)))) for a, b, c in zip(edges, edges[1:], edges[2:])])
    db = np.maximum(np.array(rows), np.max(rows) - 80)
    want = np.array([[sum(row[k] * np.cos(np.pi / 40 * (k + 0.5) * j) for k in range(40)) * np.sqrt((1 if j == 0 else 2) / 40) for j in range(20)] for row in db])
    assert np.allclose(S.cepstra(x), want, atol=1e-6)
    assert np.allclose(S.cepstral_summary(x), [*want[:, 1:].mean(0), *want[:, 1:].std(0)], atol=1e-6) and S.cepstral_summary(x[:100]) is None
    clips = [tone(f, 8_000) for f in (200, 400, 900)]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(clips)] + [(9, None), (8, [0.0])], "i int, s array<double>").withColumn("f", S.cepstral_summary_of("s"))
    got = np.array([r.f for r in S.standardised(df, "f").orderBy("i").collect()])
    raw = np.array([S.cepstral_summary(c) for c in clips])
    z = (raw - raw.mean(0)) / np.maximum(raw.std(0), 1e-6)
    assert np.allclose(got, z / np.linalg.norm(z, axis=1, keepdims=True), atol=1e-6) and S.standardised(df.limit(0), "f").count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, tone(300, 5_000).tolist()), (2, None), (3, [])], "i int, s array<float>")
    rows = df.select("i", S.cleaned_of("s").alias("c"), S.augmented_of()("s", F.col("i")).alias("a")).orderBy("i").collect()
    assert len(rows[0].c.samples) == 5_000 and rows[1].c.samples is None and rows[1].a.samples is None and rows[2].a.samples == []
