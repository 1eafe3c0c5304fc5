"""Vector functions over array<double> columns, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column, least: float = 1e-8) -> Column:
    """v / |v|; a vector shorter than `least` stays as it is."""
    n = norm(v)
    return F.when(n < least, v).otherwise(F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(n, F.size(v)).alias("n")), lambda p: p["x"] / p["n"]))


def finite(v: Column) -> Column:
    """NaN and infinite values become 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def zscore(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std by position; a std below 1e-8 counts as 1."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / F.when(s < 1e-8, 1.0).otherwise(s))


def weighted_concat(audio: Column, lyrics: Column, scale: float) -> Column:
    return F.concat(F.transform(audio, lambda x: x * scale), lyrics)
