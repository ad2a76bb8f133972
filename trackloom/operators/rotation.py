"""Orientation predictors and the screw predictor over tracks with quaternions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quat import angle_between, conjugate, from_axis_angle, power, quat, rotate, times, turn_angle
from ..functions.vec import minus, norm, vec
from .predict import KEYS, down_sampled, order

#: Share of the last turn that the damped predictor repeats.
DAMPED = 0.8525


def oriented(poses: DataFrame) -> DataFrame:
    """Poses (vx, vy, vz: axis times angle) with quaternion columns qw, qx, qy, qz."""
    return poses.select("*", *(c.alias(f"q{n}") for c, n in zip(from_axis_angle([F.col(f"v{c}") for c in "xyz"]), "wxyz")))


def with_turns(poses: DataFrame) -> DataFrame:
    """Down-sampled rows with the two poses before them, in the one window of the track."""
    w = order()
    earlier = [F.lag(c, i).over(w).alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y", "z", "qw", "qx", "qy", "qz")]
    return down_sampled(oriented(poses)).select("*", *earlier)


def errors(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, still, vel, damped, screw, turn): k from 2.

    still, vel and damped are angles between the pose and predictions that hold the last orientation, repeat the last turn or a
    share of it; screw is the distance from the position that the last displacement gives when turned as the object
    turned last; turn is the angle of the row's own turn.
    """
    rows = with_turns(poses).where("k >= 2")
    last = times(quat("1"), conjugate(quat("2")))
    move = rotate(last, minus(vec(suffix="1"), vec(suffix="2")))
    screw = [p + m for p, m in zip(vec(suffix="1"), move)]
    return rows.select(
        *KEYS,
        "k",
        angle_between(quat(), quat("1")).alias("still"),
        angle_between(quat(), times(last, quat("1"))).alias("vel"),
        angle_between(quat(), times(power(last, DAMPED), quat("1"))).alias("damped"),
        norm(minus(vec(), screw)).alias("screw"),
        turn_angle(times(quat(), conjugate(quat("1")))).alias("turn"),
    )


def saturated(x: Column, k: float = 0.75, s: float = 2 * pi) -> Column:
    """x / (1 + |x / s|^k)^(1 / k)."""
    return x / F.pow(F.lit(1.0) + F.pow(F.abs(x / F.lit(s)), F.lit(k)), F.lit(1 / k))


def scale_sweep(turns: DataFrame, scales: list[float]) -> DataFrame:
    """Mean error of scaling the last turn's angle, for each step and scale, and whether it is the step's least.

    Takes (track_id, step, k, turn). Each row meets all scales where it lies; partial averages are exchanged.
    """
    rows = turns.select("step", "turn", F.lag("turn").over(order()).alias("last")).where("last IS NOT NULL")
    every = rows.select("step", "turn", "last", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    mean = every.groupBy("step", "scale").agg(F.avg(F.abs(F.col("turn") - F.col("scale") * F.col("last"))).alias("linear"),
        F.avg(F.abs(F.col("turn") - F.col("scale") * saturated(F.col("last")))).alias("saturated"))
    return mean
