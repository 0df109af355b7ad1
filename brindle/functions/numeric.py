"""Number, hash and vector functions as built-in expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine_constants(n: int, seed: int, low: tuple[int, int], modulus: tuple[int, int] | None = None) -> list[tuple[int, ...]]:
    """(a, b) or (a, b, m) per hash function, drawn in that order."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = [rng.randint(*low), rng.randint(*low)]
        out.append(tuple(c + [rng.randint(*modulus)] if modulus else c))
    return out


def affine(x: Column, a: int, b: int, m: int) -> Column:
    """(a x + b) mod m in 64 bits; take x below 2^63 / a."""
    return (x * F.lit(a).cast("long") + F.lit(b)) % F.lit(m)


def text_mod(text: Column, m: int) -> Column:
    """The UTF-8 bytes of a text as one big-endian number, modulo m: folded byte by byte, so that it
    stays in 64 bits. Null and empty texts give null."""
    raw = F.hex(text.cast("binary"))
    places = F.sequence(F.lit(1), F.octet_length(text))
    digits = F.transform(places, lambda i: F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 256 + d) % m)
    return F.when(F.octet_length(text) > 0, folded)


def text_mod_sql(text: str, m: int) -> str:
    return (
        f"list_reduce([0::BIGINT] || list_transform(range(1, octet_length(encode({text})) + 1), "
        f"lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT), lambda acc, x: (acc * 256 + x) % {m})"
    )


def trailing_zeros(x: Column) -> Column:
    """Zero bits at the end of x; 0 counts as having one."""
    b = F.bin(x)
    return F.length(b) - F.length(F.regexp_replace(b, "0+$", ""))


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def mahalanobis(a: Column, centre: Column, variance: Column, floor: float = 1e-9) -> Column:
    """Distance under a diagonal covariance, with variances of at least `floor`."""
    parts = F.zip_with(F.zip_with(a, centre, lambda x, c: (x - c) * (x - c)), variance, lambda d, v: d / F.greatest(v, F.lit(floor)))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def variance(n: Column, total: Column, squares: Column) -> Column:
    """Per dimension, from sums and sums of squares."""
    return F.zip_with(squares, total, lambda q, s: q / n - (s / n) * (s / n))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    """From the sizes of the intersection and of both sets."""
    return common / (a + b - common)


def binary_cosine(common: Column, a: Column, b: Column) -> Column:
    return common / (F.sqrt(a) * F.sqrt(b))


def clamped(x: Column, low: float, high: float) -> Column:
    """NaN stays."""
    return F.when(F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def years_since(stamp: Column, year: int = 2020) -> Column:
    return F.lit(year) - F.year(F.to_timestamp(stamp))


def hours_class(hours: Column) -> Column:
    """d: only working days (or no day); e: only weekend days; b: both; null for null."""
    days = F.map_keys(hours)
    working = F.forall(days, lambda d: d.isin("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"))
    weekend = F.forall(days, lambda d: d.isin("Saturday", "Sunday"))
    return F.when(hours.isNull(), F.lit(None)).when(working, "d").when(weekend, "e").otherwise("b")
