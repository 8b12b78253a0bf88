"""Spectra of sound, in numpy alone: cleaning, tempo, pitch, rooms, bands, cepstra, with the columns that carry them.

Rows are clips; each is worked on by itself, in time and memory proportional to its length
times the logarithm of it.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.operators.sound import RATE, energy, gained, mu_law, soft_clipped, with_noise

SIZE, HOP = 512, 128
_SAMPLES = T.ArrayType(T.FloatType())


def spectra(x: np.ndarray, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """Short-time spectra, a row a frame; frame k is centred at sample k * hop."""
    padded = np.pad(np.asarray(x, np.float64), (size // 2, size // 2 + (-len(x)) % hop))
    return np.fft.rfft(sliding_window_view(padded, size)[::hop] * np.hanning(size + 1)[:-1])


def sound_of(spectrum: np.ndarray, n: int, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """The sound of `spectra`: frames added where they overlap, over the sum of their squared windows; exact for unchanged ones."""
    window, per = np.hanning(size + 1)[:-1], size // hop
    parts = (np.fft.irfft(spectrum, size) * window).reshape(len(spectrum), per, hop)
    weights = (window**2).reshape(per, hop)
    out, weight = (np.zeros((len(spectrum) + per - 1, hop)) for _ in range(2))
    for k in range(per):
        out[k : k + len(spectrum)] += parts[:, k]
        weight[k : k + len(spectrum)] += weights[k]
    flat = (out / np.maximum(weight, 1e-8)).ravel()[size // 2 :]
    return np.pad(flat, (0, max(0, n - len(flat))))[:n]


def filtered(x: np.ndarray, rate: int, gain) -> np.ndarray:
    """Sound with the level of each frequency changed by `gain(frequencies)`, without shifts; ends are mirrored first, so that they do not meet."""
    pad = min(len(x) - 1, rate // 4)
    y = np.pad(np.asarray(x, np.float64), pad, mode="reflect") if pad > 0 else np.asarray(x, np.float64)
    out = np.fft.irfft(np.fft.rfft(y) * gain(np.fft.rfftfreq(len(y), 1 / rate)), len(y))
    return out[pad : pad + len(x)]


def _smoothed(a: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    wide = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric")
    return sliding_window_view(wide, 2 * reach + 1, axis=axis) @ (kernel / kernel.sum())


class Cleaning(NamedTuple):
    #: Rumble below this goes (Hz), quality of a hum's notch, quiet is this share of loud, and how long it lasts (s) without its edges (s).
    rumble: float = 40.0
    notch: float = 35.0
    quiet: float = 0.065
    least: float = 0.35
    edge: float = 0.064
    #: Quiet that is needed in all (s), frames of it, and the loudest that cleaned sound may be.
    needed: float = 0.5
    frames: int = 8
    peak: float = 0.98


def quiet_stretches(x: np.ndarray, rate: int, how: Cleaning = Cleaning()) -> list[tuple[int, int]]:
    """Stretches (samples) that stay quiet against the loud parts of the sound, less their edges."""
    at, level, frame = energy(x, rate, 0.032, 0.016)
    loud = float(np.quantile(level, 0.9)) if len(level) else 0.0
    if loud <= 1e-6:
        return []
    turns = np.flatnonzero(np.diff(np.concatenate(([0], (level < how.quiet * loud).astype(np.int8), [0]))))
    edge = round(how.edge * rate)
    spans = [(int(at[a]) + edge, int(at[b - 1]) + frame - edge) for a, b in turns.reshape(-1, 2)]
    return [(a, b) for a, b in spans if b - a >= round(how.least * rate)]


def noise_spectrum(spectrum: np.ndarray, stretches: list[tuple[int, int]], size: int = SIZE, hop: int = HOP) -> tuple[np.ndarray | None, int]:
    """(median power of each frequency, frames) over frames that lie wholly in the stretches."""
    centre = np.arange(len(spectrum)) * hop
    inside = np.zeros(len(spectrum), bool)
    for a, b in stretches:
        inside |= (centre >= a + size / 2) & (centre <= b - size / 2)
    n = int(inside.sum())
    return (np.median(np.abs(spectrum[inside]) ** 2, axis=0) if n else None), n


def cleaned(x: np.ndarray, rate: int = RATE, hum: int | None = None, most_db: float = 9.0, how: Cleaning = Cleaning()) -> tuple[np.ndarray, dict]:
    """Sound of the same length without offset, rumble, hum (50 or 60 Hz) and, where quiet stretches tell what the noise is, with less noise.

    No frequency of a frame is lowered by more than `most_db` (12 at most).  Nothing is
    trimmed, and nothing made louder.
    """
    x = np.asarray(x, np.float64)
    if x.ndim != 1 or not len(x) or not np.isfinite(x).all() or rate < 1000:
        raise ValueError("cleaning needs finite sound of one channel and at least 1,000 samples a second")
    if not 0 <= most_db <= 12 or hum not in (None, 50, 60):
        raise ValueError("noise is lowered by 0 to 12 dB, hum is 50 or 60 Hz or none")
    report = {"noise_frames": 0, "noise_seconds": 0.0, "reduced": False}
    y = x - x.mean()
    if len(y) >= 128:
        high = lambda f: 1 / (1 + (how.rumble / np.maximum(f, 1e-9)) ** 4)
        notch = lambda f: 1.0 if hum is None else (f**2 - hum**2) ** 2 / ((f**2 - hum**2) ** 2 + (f * hum / how.notch) ** 2 + 1e-30)
        y = filtered(y, rate, lambda f: high(f) * notch(f))
    quiet = quiet_stretches(y, rate, how)
    report["noise_seconds"] = sum(b - a for a, b in quiet) / rate
    if report["noise_seconds"] >= how.needed and len(y) >= SIZE:
        s = spectra(y)
        noise, report["noise_frames"] = noise_spectrum(s, quiet)
        if report["noise_frames"] >= how.frames:
            gain = np.sqrt(np.maximum(0, 1 - noise / np.maximum(np.abs(s) ** 2, 1e-20)))
            gain = np.maximum(10 ** (-most_db / 20), _smoothed(_smoothed(gain, 1, 1), 2, 0))
            y, report["reduced"] = sound_of(s * gain, len(x)), True
    top = float(np.abs(y).max())
    return (y * min(1.0, how.peak / top) if top else y).astype(np.float32), report


# Changes of voice, room and channel


def tempo(x: np.ndarray, rate: float) -> np.ndarray:
    """Faster or slower at the same pitch: frames are taken at other times, and phases go on by what they advance there."""
    n = round(len(x) / rate)
    if rate == 1 or len(x) < 2 * SIZE:
        return np.asarray(x, np.float32)
    s = spectra(x)
    at = np.arange(0, len(s) - 1, rate)
    k, part = at.astype(int), (at % 1)[:, None]
    size = (1 - part) * np.abs(s[k]) + part * np.abs(s[k + 1])
    advance = np.angle(s[k + 1] * np.conj(s[k]))
    phase = np.angle(s[0]) + np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(advance, axis=0)[:-1]])
    return sound_of(size * np.exp(1j * phase), n).astype(np.float32)


def resized(x: np.ndarray, n: int) -> np.ndarray:
    """The same sound in `n` samples: its spectrum cut or filled up."""
    s = np.fft.rfft(x)
    keep = min(len(s), n // 2 + 1)
    return np.fft.irfft(np.concatenate([s[:keep], np.zeros(n // 2 + 1 - keep)]), n) * (n / len(x))


def pitch(x: np.ndarray, semitones: float) -> np.ndarray:
    """Higher or lower, as long as before."""
    return x if len(x) < 2 * SIZE else level(resized(tempo(x, 2 ** (-semitones / 12)), len(x)))


def level(x: np.ndarray, like: np.ndarray | None = None, peak: float = 0.999) -> np.ndarray:
    """Sound with the power of `like`, then no louder than `peak`."""
    x = np.asarray(x, np.float64)
    if like is not None and (own := float(np.mean(x**2))) > 0:
        x = x * np.sqrt(float(np.mean(np.square(like, dtype=np.float64))) / own)
    top = float(np.abs(x).max(initial=0))
    return (x * (peak / top) if top > peak else x).astype(np.float32)


def room(x: np.ndarray, rt60: float, wet: float, rng: np.random.Generator, rate: int = RATE) -> np.ndarray:
    """In a room whose echo falls by 60 dB in `rt60` seconds: decaying noise, convolved by FFT."""
    t = np.arange(max(1, int(rt60 * rate))) / rate
    echo = rng.normal(size=len(t)) * 10 ** (-3 * t / rt60)
    n = len(x) + len(t) - 1
    far = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(echo / np.sqrt(np.sum(echo**2)), n), n)[: len(x)]
    return level((1 - wet) * x + wet * far, x)


def equalised(x: np.ndarray, bands: list[tuple[str, float, float, float]], rate: int = RATE) -> np.ndarray:
    """Shelves and peaks (low, high or peak; frequency; decibels; quality) as gains of frequencies."""

    def gain(f: np.ndarray) -> np.ndarray:
        out = np.ones(len(f))
        for kind, at, db, q in bands:
            a, r = 10 ** (db / 40), 1j * f / at
            if kind == "peak":
                h = (r**2 + r * a / q + 1) / (r**2 + r / (a * q) + 1)
            else:
                r = r if kind == "low" else 1 / np.where(f == 0, 1e-9j, r)
                h = a * (r**2 + np.sqrt(a) / q * r + a) / (a * r**2 + np.sqrt(a) / q * r + 1)
            out = out * np.abs(h)
        return out

    return level(filtered(x, rate, gain), x)


def band(x: np.ndarray, low: float | None, high: float | None, rate: int = RATE) -> np.ndarray:
    """Only what lies between two frequencies, falling off like a Butterworth filter of order 6."""
    gain = lambda f: (1.0 if low is None else 1 / np.sqrt(1 + (low / np.maximum(f, 1e-9)) ** 12)) * (1.0 if high is None else 1 / np.sqrt(1 + (f / high) ** 12))
    return level(filtered(x, rate, gain), x)


def coloured_noise(n: int, colour: str, rng: np.random.Generator) -> np.ndarray:
    """White, pink (power as 1/f) or brown (1/f^2) noise."""
    s, f = np.fft.rfft(rng.normal(size=n)), np.fft.rfftfreq(n)
    if colour != "white":
        s[1:] /= f[1:] ** {"pink": 0.5, "brown": 1.0}[colour]
        s[0] = 0
    return np.fft.irfft(s, n)


def mel(f):
    """Fixed scale: linear below 1 kHz, logarithmic above."""
    f = np.asarray(f, np.float64)
    return np.where(f < 1000, f / (200 / 3), 15 + np.log(np.maximum(f, 1000) / 1000) * 27 / np.log(6.4))


def hertz(m):
    m = np.asarray(m, np.float64)
    return np.where(m < 15, m * (200 / 3), 1000 * np.exp((np.maximum(m, 15) - 15) * np.log(6.4) / 27))


def warped(features: np.ndarray, alpha: float, rate: int = RATE, knee: float = 4800.0) -> np.ndarray:
    """Mel features (bands, frames) of a vocal tract that is shorter (alpha above 1) or longer: frequencies scaled up to a knee, and linearly to the end from there."""
    n, end = len(features), rate / 2
    centres = hertz(np.linspace(0, mel(end), n + 2))[1:-1]
    turn = knee * min(alpha, 1.0)  # where scaled frequencies leave the straight line
    source = np.where(centres <= turn, centres / alpha, end - (end - turn / alpha) / (end - turn) * (end - centres))
    at = np.interp(mel(source), mel(centres), np.arange(n))
    k = np.floor(at).astype(int)
    part = (at - k)[:, None]
    return ((1 - part) * features[k] + part * features[np.minimum(k + 1, n - 1)]).astype(features.dtype)


class Profile(NamedTuple):
    """How likely each change is; names are those of the steps, in the order in which they are drawn."""

    clean: float = 0.1
    tempo: float = 0.5
    pitch: float = 0.3
    room: float = 0.25
    bands: float = 0.3
    channel: float = 0.1
    noise: float = 0.35
    gain: float = 0.4
    clip: float = 0.03
    codec: float = 0.08


def augmented(x: np.ndarray, seed: int, profile: Profile = Profile(), rate: int = RATE, most_s: float = 30.0) -> tuple[np.ndarray, list[str]]:
    """Sound as another voice, room and channel might have it, and what was done; draws follow the seed and the order of the profile.

    A change that would make it longer than `most_s` is left out, its draws are not.
    """
    rng = np.random.default_rng(seed)
    hit = lambda p: p > 0 and rng.random() < p
    x, done = np.asarray(x, np.float32), []
    if not len(x) or hit(profile.clean):
        return level(x), done
    enough = len(x) >= 4 * SIZE
    if enough and hit(profile.tempo):
        r = rng.uniform(0.85, 1.45)
        if round(len(x) / r) <= rate * most_s:
            x, done = tempo(x, r), [*done, f"tempo {r:.2f}"]
    if enough and hit(profile.pitch):
        s = rng.uniform(-3, 3)
        x, done = pitch(x, s), [*done, f"pitch {s:+.1f}"]
    if hit(profile.room):
        rt60, wet = rng.uniform(0.15, 0.8), rng.uniform(0.15, 0.6)
        x, done = room(x, rt60, wet, rng, rate), [*done, f"room {rt60:.2f} {wet:.2f}"]
    if hit(profile.bands):
        shapes = [("low", rng.uniform(80, 400), 0.7071), ("high", rng.uniform(2000, 6000), 0.7071), ("peak", rng.uniform(250, 4000), rng.uniform(0.5, 2))]
        chosen = sorted(rng.choice(3, size=int(rng.uniform(1, 4)), replace=False))
        x, done = equalised(x, [(shapes[k][0], shapes[k][1], rng.uniform(-8, 8), shapes[k][2]) for k in chosen], rate), [*done, f"bands {len(chosen)}"]
    if hit(profile.channel):
        phone = rng.random() < 0.4
        cut = 3400.0 if phone else rng.uniform(3000, 7000)
        x, done = band(x, 300.0 if phone else None, cut, rate), [*done, "telephone" if phone else f"below {cut:.0f}"]
    if hit(profile.noise):
        colour, snr = str(rng.choice(["white", "pink", "brown"])), rng.uniform(12, 35)
        x, done = level(with_noise(x, coloured_noise(len(x), colour, rng), snr)), [*done, f"{colour} noise {snr:.0f}"]
    if hit(profile.gain):
        db = rng.uniform(-6, 6)
        x, done = gained(x, db, 0.999), [*done, f"gain {db:+.1f}"]
    if hit(profile.clip):
        drive = rng.uniform(1.5, 4)
        x, done = soft_clipped(x, drive), [*done, f"clip {drive:.1f}"]
    if hit(profile.codec):
        kind = int(rng.uniform(0, 3))
        x = band(x, None, 4000.0, rate) if kind else x
        x, done = mu_law(x) if kind != 1 else x, [*done, ("mu-law", "narrow", "narrow mu-law")[kind]]
    return level(x), done


# Cepstra


@cache
def _bank(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangles on the HTK mel scale, unscaled: (frequencies, bands)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


def cepstra(x: np.ndarray, rate: int = RATE, count: int = 20, bands: int = 40, size: int = 400, hop: int = 160) -> np.ndarray:
    """Mel cepstra (frames, count): power in decibels within 80 of the loudest, an orthonormal cosine transform."""
    y = np.pad(np.asarray(x, np.float64), size // 2, mode="reflect")
    power = np.abs(np.fft.rfft(sliding_window_view(y, size)[::hop] * np.hanning(size + 1)[:-1])) ** 2
    db = 10 * np.log10(np.maximum(power @ _bank(bands, size, rate), 1e-10))
    db = np.maximum(db, db.max() - 80)
    k = np.arange(bands)
    basis = np.cos(np.pi / bands * (k[:, None] + 0.5) * np.arange(count)) * np.sqrt(2 / bands)
    basis[:, 0] /= np.sqrt(2)
    return db @ basis


def cepstral_summary(x: np.ndarray, rate: int = RATE) -> np.ndarray | None:
    """Means, then deviations, of cepstra 1 to 19; none for sound of a quarter of a second or less, of more than 30 s, or that is not finite."""
    if not 0.25 < len(x) / rate <= 30 or not np.isfinite(x).all():
        return None
    c = cepstra(x, rate)[:, 1:]
    return np.concatenate([c.mean(axis=0), c.std(axis=0)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def cepstral_summary_of(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else cepstral_summary(np.asarray(x)))


def standardised(rows: DataFrame, features: str, size: int = 38) -> DataFrame:
    """Each feature less its mean over its deviation in the whole table, then each row as long as 1; rows without features are left out.

    The statistics are one row; deviations and lengths below a millionth count as one.
    """
    rows = rows.filter(F.col(features).isNotNull())
    parts = [f(F.get(features, F.lit(k))).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    found = rows.agg(*parts).first()
    if found["m0"] is None:
        return rows
    means, spreads = (F.array(*[F.lit(float(found[f"{n}{k}"])) for k in range(size)]) for n in "md")
    z = F.zip_with(F.zip_with(features, means, lambda a, b: a - b), spreads, lambda a, d: a / F.greatest(d, F.lit(1e-6)))
    rows = rows.withColumn(features, z)
    length = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, a: s + a * a))
    return rows.withColumn(features, F.transform(features, lambda a: a / F.greatest(length, F.lit(1e-6))))


@F.pandas_udf(T.StructType([T.StructField("samples", _SAMPLES), T.StructField("noise_frames", T.IntegerType()), T.StructField("noise_seconds", T.DoubleType()), T.StructField("reduced", T.BooleanType())]))
def cleaned_of(samples: pd.Series) -> pd.DataFrame:
    """Cleaned sound and what was done; null and empty sound stay null."""
    rows = []
    for x in samples:
        y, r = (None, {}) if x is None or not len(x) else cleaned(np.asarray(x))
        rows.append((y, r.get("noise_frames"), r.get("noise_seconds"), r.get("reduced")))
    return pd.DataFrame(rows, columns=["samples", "noise_frames", "noise_seconds", "reduced"]).astype({"noise_frames": "Int32", "reduced": "boolean"})


def augmented_of(profile: Profile = Profile()):
    """A function of (samples, seed): struct<samples, steps>."""

    @F.pandas_udf(T.StructType([T.StructField("samples", _SAMPLES), T.StructField("steps", T.ArrayType(T.StringType()))]))
    def run(samples: pd.Series, seed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else augmented(np.asarray(x), int(s), profile) for x, s in zip(samples, seed, strict=True)], columns=["samples", "steps"])

    return run
