"""Expressions over arrays of numbers; arrays are cast to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    size = norm(v)
    return F.transform(doubles(v), lambda x: F.when(size > 0, x / size).otherwise(x))


def power_normalised(v: Column, a: float = 0.35) -> Column:
    """Signed power, then unit length."""
    return l2_normalised(F.transform(doubles(v), lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(a))))


def angle_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def blended(a: Column, b: Column, alpha: Column | float) -> Column:
    """alpha * a + (1 - alpha) * b, not normalised again."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: alpha * x + (1 - alpha) * y)


def fourier_features(v: Column, directions: list[list[float]]) -> Column:
    """cos and sin of the projections on fixed directions, over the square root of their number."""
    scale = len(directions) ** 0.5
    shadows = [dot(v, F.array(*map(F.lit, d))) for d in directions]
    return F.array(*[F.cos(s) / scale for s in shadows], *[F.sin(s) / scale for s in shadows])


def calibrated(score: Column, a: float, b: float) -> Column:
    """The logistic curve 1 / (1 + exp(a * score + b))."""
    return 1 / (1 + F.exp(a * score + b))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over span of two intervals; negative if they are apart, null for two empty ones at one place."""
    span = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(span != 0, (F.least(e1, e2) - F.greatest(s1, s2)) / span)
