"""Vector columns as arrays: everything stays in JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 256


def doubles(v: Column) -> Column:
    """Float32 vectors must be widened before any arithmetic."""
    return v.cast("array<double>")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once a row: a function of elements computes what it refers to for each one."""
    return F.get(F.transform(F.array(value), of), 0)


def dimension(v: Column) -> Column:
    """Numbers of a vector; null for a missing one."""
    return F.when(v.isNotNull(), F.size(v))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two double vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, least: float = 1e-12) -> Column:
    """v divided by its norm, the norm taken as `least` at least."""
    return once(v, lambda w: once(F.greatest(norm(w), F.lit(least)), lambda n: F.transform(w, lambda x: x / n)))


def finalised(v: Column, dimensions: int = DIMENSIONS) -> Column:
    """An embedding ready to store: NaN and infinities become 0, the first `dimensions` numbers stay,
    and the rest has norm 1 unless it is all zeros."""
    finite = F.transform(doubles(v), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return once(F.slice(finite, 1, dimensions), lambda cut: once(norm(cut), lambda n: F.when(n > 0, F.transform(cut, lambda x: x / n)).otherwise(cut)))


def drift(a: Column, b: Column) -> Column:
    """Distance of unit vectors from their cosine, clipped so that rounding can't leave the range."""
    cos = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
    return F.sqrt(F.greatest(2 - 2 * cos, F.lit(0.0)))


def char_features(s: Column, chars: int = 100, size: int = DIMENSIONS) -> Column:
    """Code point / 255 of the first `chars` characters, then zeros up to `size`; not clipped at 1."""
    # only the first characters are gone through; a null text has nulls for them
    start = F.transform(F.split(F.substring(s, 1, chars), ""), lambda c: F.ascii(c) / 255.0)
    start = F.when(s.isNull(), F.array_repeat(F.lit(None).cast("double"), chars)).when(s == "", F.array().cast("array<double>")).otherwise(start)
    return once(start, lambda v: F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size))
