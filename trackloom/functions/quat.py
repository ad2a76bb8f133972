"""Quaternions (w, x, y, z) as lists of four columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec, cross, norm, scale

Quat = list[Column]
#: Below this angle a turn is not scaled.
STILL = 1e-4


def quat(suffix: str = "") -> Quat:
    return [F.col(f"q{c}{suffix}") for c in "wxyz"]


def from_axis_angle(v: Vec) -> Quat:
    """Of a vector along the axis, as long as the angle; the zero vector is no rotation."""
    t = norm(v)
    s = F.when(t == 0, F.lit(0.5)).otherwise(F.sin(t / 2) / t)
    return [F.cos(t / 2), *scale(v, s)]


def times(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def conjugate(a: Quat) -> Quat:
    return [a[0], -a[1], -a[2], -a[3]]


def rotate(a: Quat, v: Vec) -> Vec:
    """v + 2 w (u x v) + 2 u x (u x v), u being the vector part."""
    once = cross(a[1:], v)
    twice = cross(a[1:], once)
    return [p + F.lit(2.0) * (a[0] * q + r) for p, q, r in zip(v, once, twice)]


def angle_between(a: Quat, b: Quat) -> Column:
    d = reduce(add, (p * q for p, q in zip(a, b)))
    return F.lit(2.0) * F.acos(F.least(F.lit(1.0), F.abs(d)))


def turn_angle(a: Quat) -> Column:
    """In 0 to pi."""
    return F.lit(2.0) * F.acos(F.least(F.lit(1.0), F.abs(a[0])))


def power(a: Quat, t: float) -> Quat:
    """The share ``t`` of a turn, the short way; turns below ``STILL`` are none."""
    half = F.acos(F.least(F.lit(1.0), F.abs(a[0])))
    s = F.when(a[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.sin(half * F.lit(t)) / norm(a[1:])
    still = 2 * half < STILL
    return [F.when(still, F.lit(1.0)).otherwise(F.cos(half * F.lit(t))), *(F.when(still, F.lit(0.0)).otherwise(c * s) for c in a[1:])]
