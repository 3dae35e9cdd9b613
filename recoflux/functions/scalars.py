"""Scalar, array and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def zero_if_not_finite(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """0 where the range is empty."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))


def clean(c: Column) -> Column:
    """Stripped, lower case, single spaces; null or blank: 'unknown'."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def keyword_text(c: Column, least: int = 3) -> Column:
    """Stripped lower-case keywords of at least `least` characters, joined; 'unknown' without any."""
    kept = F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= least)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(kept, " ")).otherwise(F.lit("unknown"))


def cast_text(c: Column, top: int = 3) -> Column:
    """Names repeated top, top - 1, ... (at least once) times, joined; 'unknown' without any."""
    many = F.flatten(F.transform(c, lambda x, i: F.array_repeat(F.lower(F.trim(x)), F.greatest(F.lit(1), F.lit(top) - i))))
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(many, " ")).otherwise(F.lit("unknown"))


def year_of(c: Column) -> Column:
    return F.split(c, "-")[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return safe_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(safe_divide(p * (1 - p), n))


def arithmetic_hash(seed: int, *keys: Column) -> Column:
    """A hash that any engine with 64-bit integers computes alike; weak, but a total order with the keys behind it."""
    h = F.lit(seed % PRIME).cast("long")
    for k, m in zip(keys, (1103515245, 12345, 69069, 362437), strict=False):
        h = (h + F.pmod(k.cast("long"), F.lit(PRIME)) * m) % PRIME
    return (h * 48271) % PRIME
