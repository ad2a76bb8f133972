"""Vectors as lists of three columns; every function gives plain column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return [F.col(f"{prefix}{c}{suffix}") for c in "xyz"]


def combine(weights: list[float], vectors: list[Vec]) -> Vec:
    """Sum of weight times vector, added from the left."""
    return [reduce(add, (F.lit(float(w)) * v[i] for w, v in zip(weights, vectors))) for i in range(3)]


def minus(a: Vec, b: Vec) -> Vec:
    return [p - q for p, q in zip(a, b)]


def scale(a: Vec, s: Column) -> Vec:
    return [p * s for p in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(add, (p * q for p, q in zip(a, b)))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def angle(a: Vec, b: Vec) -> Column:
    """Angle between two vectors; null if one is zero."""
    c = divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
