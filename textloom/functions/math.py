"""Numbers and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))


def softmax(a: Column) -> Column:
    """Shifted by the largest, so nothing overflows."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def quantise(a: Column) -> Column:
    """struct<q array<tinyint>, scale double>: 127 steps to each side of 0, half to even."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    return F.struct(F.transform(a, lambda x: F.rint(x.cast("double") / scale).cast("tinyint")).alias("q"), scale.alias("scale"))


def quantised_dot(x: Column, y: Column) -> Column:
    """The product of two quantised vectors, in the scale of the originals."""
    return F.aggregate(F.zip_with(x["q"], y["q"], lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v) * x["scale"] * y["scale"]


def rms(a: Column) -> Column:
    return F.sqrt(dot(a, a) / F.nullif(F.size(a), F.lit(0)))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def offset(a: Column) -> Column:
    """The mean of an array."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def clipped(a: Column, limit: float = 0.999) -> Column:
    """Share of samples at or above `limit`."""
    return F.size(F.filter(a, lambda x: F.abs(x) >= limit)) / F.nullif(F.size(a), F.lit(0))


def hash_unit(key: Column) -> Column:
    """A key's place in [0, 1): its SHA-256's first 64 bits by 2**64."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def hash_modulo(key: Column, modulus: int) -> Column:
    """The whole SHA-256 as a number, modulo `modulus`, hex digit by hex digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(F.sha2(key, 256), i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda s, d: (s * 16 + d) % modulus)


def duration_likeness(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0.0))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def round_even(x: Column) -> Column:
    """To a whole number as a double, half to even."""
    return F.rint(x)


def round_up(x: Column) -> Column:
    """To a whole number, half upwards (also below zero)."""
    return F.floor(x + 0.5).cast("double")


def frame_rms(a: Column, frame: int) -> Column:
    """Root mean square of each whole frame of `frame` samples."""
    n = F.floor(F.size(a) / frame).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: rms(F.slice(a, i * frame + 1, F.lit(frame))))


def is_silent(a: Column, frame: int, limit: float) -> Column:
    """Whether no frame is as loud as `limit`; nothing at all is silent."""
    return F.coalesce(F.array_max(frame_rms(a, frame)) < limit, F.lit(True))
