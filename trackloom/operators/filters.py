"""Predictors that are filters over the last poses, with weights from least-squares spline fits or tapered sinc functions.

The weights depend on a few parameters only and are computed on the driver; a track's rows are multiplied with them where they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predict import KEYS, down_sampled

MODES = ("extrapolate", "smooth", "accelerate", "smooth_accelerate")
#: Used while there are too few poses for a fit: hold, velocity, quadratic.
SHORT = {1: [1.0], 2: [-1.0, 2.0], 3: [1.0, -3.0, 3.0]}


def basis(u: np.ndarray, degree: int, count: int) -> np.ndarray:
    """Uniform B-spline basis functions with knots 0, 1, 2 ..: a row for each u in [degree, count]."""
    knots = np.arange(count + degree + 1, dtype=float)
    span = np.minimum(np.floor(u).astype(int), count - 1)
    b = (np.arange(len(knots) - 1) == span[:, None]).astype(float)
    for d in range(1, degree + 1):
        left = (u[:, None] - knots[: -d - 1]) / d * b[:, :-1]
        right = (knots[d + 1 :] - u[:, None]) / d * b[:, 1:]
        b = left + right
    return b[:, :count]


def fit_weights(basis_at: Callable, slopes_at: Callable, degree: float, controls: int, inputs: int, mode: str) -> list[float]:
    """Weights of the last ``inputs`` poses, the oldest first, for the next pose.

    A curve with ``controls`` control points is fitted to the poses; ``basis_at`` gives a row of their weights for each place u on it, ``slopes_at`` the
    first and second derivatives at one. extrapolate places one more pose on the curve and takes its end;
    smooth takes the curve at the last pose; accelerate adds the curve's velocity and half its acceleration there to the last pose,
    smooth_accelerate to the smoothed one.
    """
    if not degree < controls <= inputs + (mode == "extrapolate"):
        raise ValueError("a fit needs more control points than its degree, and as many poses")
    u = np.linspace(degree, controls, inputs + (mode == "extrapolate"))
    b = basis_at(u)
    if mode == "extrapolate":
        # The unknown last pose is where the curve ends: the fit of the known ones decides it.
        return (b[-1] @ np.linalg.pinv(b[:-1])).tolist()
    fit = np.linalg.pinv(b)
    start = b[-1] @ fit if mode.startswith("smooth") else np.append(np.zeros(inputs - 1), 1.0)
    if mode == "smooth":
        return start.tolist()
    du = u[1] - u[0] if inputs > 1 else 0.0
    first, second = slopes_at(u[-1:])
    return (start + (first * du + second * du * du / 2) @ fit).tolist()


@cache
def spline_weights(degree: int, controls: int, inputs: int, mode: str = "extrapolate") -> list[float]:
    """``fit_weights`` of a uniform B-spline."""

    def slopes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = np.zeros(controls), np.zeros(controls)
        if degree >= 1:
            lower = basis(at - 1, degree - 1, controls - 1)[0]
            first = np.append(0, lower) - np.append(lower, 0)
        if degree >= 2:
            lower = basis(at - 2, degree - 2, controls - 2)[0]
            step = np.append(0, lower) - np.append(lower, 0)
            second = np.append(0, step) - np.append(step, 0)
        return first, second

    return fit_weights(lambda u: basis(u, degree, controls), slopes, degree, controls, inputs, mode)


def sinc_basis(u: np.ndarray, degree: float, controls: int, radius: float, k: float) -> np.ndarray:
    """Tapered sinc functions in place of B-splines of a real-valued degree: as wide as these, a row that sums to 1 for each u."""
    t = (u[:, None] - np.arange(controls)) / ((degree + 1) / 2) - 1
    inside = np.abs(t) < radius
    t = np.where(inside, t, 0.0)
    b = np.where(inside, np.sinc(t) * np.exp(-k * t * t / (radius * radius - t * t)), 0.0)
    return b / b.sum(axis=1, keepdims=True)


def sinc_spline_weights(degree: float, controls: int, inputs: int, radius: float, k: float, mode: str = "extrapolate") -> list[float]:
    """``fit_weights`` of tapered sinc functions; derivatives by five-point differences."""
    at = lambda u: sinc_basis(u, degree, controls, radius, k)

    def slopes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = 1e-3
        a, b, c, d, e = (at(u + i * h)[0] for i in (-2, -1, 0, 1, 2))
        return (a - 8 * b + 8 * d - e) / (12 * h), (-a + 16 * b - 30 * c + 16 * d - e) / (12 * h * h)

    return fit_weights(at, slopes, degree, controls, inputs, mode)


def growing(degree: float, controls: int, inputs: int, weights: Callable) -> dict[int, list[float]]:
    """Weights by the number of poses at hand: growing fits up to ``inputs``, simple predictors before."""
    out = {n: [0.0] * (n - 3) + SHORT[min(n, 3)] for n in range(1, int(degree) + 1)}
    for n in range(int(degree) + 1, inputs + 1):
        out[n] = weights(min(n, controls), n)
    return out


def spline_filters(degree: int, controls: int, inputs: int, mode: str = "extrapolate") -> dict[int, list[float]]:
    return growing(degree, controls, inputs, lambda c, n: spline_weights(degree, c, n, mode))


def sinc_spline_filters(degree: float, controls: int, inputs: int, radius: float, k: float, mode: str = "extrapolate") -> dict[int, list[float]]:
    return growing(degree, controls, inputs, lambda c, n: sinc_spline_weights(degree, c, n, radius, k, mode))


def sinc_derivative(t: np.ndarray, radius: float, k: float) -> np.ndarray:
    """Derivative of sinc(t) tapered by exp(-k t^2 / (radius^2 - t^2)) within the radius."""
    inside = np.abs(t) < radius
    s = np.where(inside, t, 0.0)
    room = radius * radius - s * s
    taper = np.exp(-k * s * s / room)
    taper_d = taper * (-2 * k * s * radius * radius / (room * room))
    x = np.pi * s
    with np.errstate(all="ignore"):
        sinc_d = np.where(np.abs(s) < 1e-12, 0.0, (np.cos(x) * x - np.sin(x)) / (np.pi * s * s))
    return np.where(inside, sinc_d * taper + np.sinc(s) * taper_d, 0.0)


def sinc_filters(radius: float, k: float) -> dict[int, list[float]]:
    """Velocity at the last pose by tapered sinc functions, added to it; by the number of poses at hand, up to the radius."""
    if radius <= 2:
        raise ValueError("the radius has to be over 2")
    most = ceil(radius)
    out = {1: SHORT[1], 2: SHORT[2]}
    for n in range(3, most + 1):
        t = (n - 1) - np.arange(n, dtype=float)
        taper = np.where(np.abs(t) < radius, np.sinc(t) * np.exp(-k * t * t / np.maximum(radius * radius - t * t, 1e-300)), 0.0)
        d = sinc_derivative(t, radius, k)
        # Weights of a curve through constant values must not move: derivatives of the normalised functions.
        w = (d * taper.sum() - taper * d.sum()) / taper.sum() ** 2
        w[-1] += 1.0
        out[n] = w.tolist()
    return out


def with_past(poses: DataFrame, n: int) -> DataFrame:
    """(track_id, step, k, x, y, z, past_x ..): the last ``n`` values before each row, the oldest first; k from 1."""
    w = Window.partitionBy(*KEYS).orderBy("k").rowsBetween(-n, -1)
    rows = down_sampled(poses).select(*KEYS, "k", "x", "y", "z", *(F.collect_list(c).over(w).alias(f"past_{c}") for c in "xyz"))
    return rows.where("k > 0")


def filtered_errors(poses: DataFrame, filters: dict[int, list[float]], name: str) -> DataFrame:
    """(track_id, step, k, name): the distance of each pose from what the filter makes of those before it."""
    most = max(filters)
    rows = with_past(poses, most)
    weights = F.lit(None).cast("array<double>")
    for n, w in filters.items():
        weights = F.when(F.size("past_x") == n, F.lit(list(map(float, w)))).otherwise(weights)
    rows = rows.select("*", weights.alias("weights"))
    square = None
    for c in "xyz":
        made = F.aggregate(F.zip_with(f"past_{c}", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        term = (F.col(c) - made) * (F.col(c) - made)
        square = term if square is None else square + term
    return rows.select(*KEYS, "k", F.sqrt(square).alias(name))


def grid(degrees=range(1, 6), most_controls: int = 10, most_inputs: int = 20) -> list[tuple[int, int, int]]:
    """All (degree, controls, inputs) that a fit can have."""
    return [(d, c, n) for d in degrees for c in range(d + 1, most_controls + 1) for n in range(max(c, d + 1), most_inputs + 1)]
