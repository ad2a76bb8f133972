"""Circles through the last points, tangents, arc lengths and local frames of tracks."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import combine, cross, divide, dot, minus, norm, scale, vec
from .predict import KEYS, down_sampled, linear, order, with_history

#: Largest squared radius, and largest angle over the last two steps, of a circular motion.
RADIUS2 = 250000.0
MOST = pi / 2
#: Weights of the last angle and the one before it.
CIRCULAR = {"CIRC_VEL1": (1.0, 0.0), "CIRC_VEL2": (1.5, -0.5), "CIRC_ACC": (2.0, -1.0)}


def circle_errors(poses: DataFrame, fall_back: str = "VEL_DEG1") -> DataFrame:
    """(track_id, step, k, on_circle, angle1, angle2, and an error for each circular predictor); k from 3.

    The circle goes through the last three points; angles are signed about its normal. Collinear points
    have no circle: on_circle is false, angles are null. Off the circle the fall-back predicts.
    """
    rows = with_history(down_sampled(poses), 3).where("k >= 3")
    p, q, r = (vec(suffix=s) for s in "321")  # oldest first
    rows = rows.select("*", *(c.alias(f"m{n}") for c, n in zip(cross(minus(q, p), minus(r, p)), "xyz")))
    m, a, b = vec("m"), minus(q, p), minus(r, p)
    up = [s + t for s, t in zip(scale(cross(m, a), dot(b, b)), scale(cross(b, m), dot(a, a)))]
    rows = rows.select("*", *(divide(c, F.lit(2.0) * dot(m, m)).alias(f"o{n}") for c, n in zip(up, "xyz")))
    centre = [s + t for s, t in zip(p, vec("o"))]
    rows = rows.select("*", *(c.alias(f"d{n}{i}") for i, at in enumerate((p, q, r)) for c, n in zip(minus(at, centre), "xyz")))
    d = [vec("d", str(i)) for i in range(3)]
    square = dot(d[0], d[0])

    def signed(s, t):
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), divide(dot(s, t), square))))
        return F.when(dot(m, cross(s, t)) < 0, -turn).otherwise(turn)

    rows = rows.select("*", signed(d[0], d[1]).alias("angle1"), signed(d[1], d[2]).alias("angle2"))
    valid = F.coalesce((square <= RADIUS2) & (F.abs(F.col("angle1") + F.col("angle2")) <= MOST), F.lit(False))
    unit = [divide(c, norm(m)) for c in m]

    def error(last: float, before: float):
        t = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.lit(last) * F.col("angle2") + F.lit(before) * F.col("angle1")))
        side = cross(unit, d[2])
        to = [c + x * F.cos(t) + y * F.sin(t) for c, x, y in zip(centre, d[2], side)]
        return F.when(valid, norm(minus(vec(), to))).otherwise(norm(minus(vec(), linear(fall_back))))

    return rows.select(*KEYS, "k", valid.alias("on_circle"), "angle1", "angle2", *(error(*w).alias(n) for n, w in CIRCULAR.items()))


#: Weights of a five-point derivative, times 12, from the first of the five points.
TANGENT = {0: (-25, 48, -36, 16, -3), 1: (-3, -10, 18, -6, 1), 2: (1, -8, 0, 8, -1), 3: (-1, 6, -18, 10, 3), 4: (3, -16, 36, -48, 25)}


def tangents(steps: DataFrame) -> DataFrame:
    """``steps`` with tx, ty, tz: five-point derivatives, one-sided at a track's ends; null for tracks of fewer than five rows."""
    w, whole = order(), Window.partitionBy(*KEYS)
    rows = steps.select("*", F.row_number().over(w).alias("i__"), F.count("*").over(whole).alias("n__"))
    place = F.when(F.col("i__") <= 2, F.col("i__") - 1).when(F.col("n__") - F.col("i__") < 2, 4 - (F.col("n__") - F.col("i__"))).otherwise(2)
    rows = rows.select("*", place.alias("p__"))
    for c in "xyz":
        out = F.lit(None).cast("double")
        for at, weights in TANGENT.items():
            near = [F.lead(c, j - at).over(w) if j >= at else F.lag(c, at - j).over(w) for j in range(5)]
            total = sum((F.lit(float(v)) * x for v, x in zip(weights[1:], near[1:])), F.lit(float(weights[0])) * near[0])
            out = F.when((F.col("p__") == at) & (F.col("n__") >= 5), total / 12).otherwise(out)
        rows = rows.withColumn(f"t{c}", out)
    return rows.drop("i__", "n__", "p__")


def even_lengths(poses: DataFrame, parts: int = 10) -> DataFrame:
    """(track_id, i, x, y, z): points 0 to parts - 1 of a track at even lengths along it.

    A segment gives the points that lie in it, so nothing is joined. Tracks that never move have none.
    """
    w = Window.partitionBy("track_id").orderBy("frame")
    step = [F.lead(c).over(w) - F.col(c) for c in "xyz"]
    rows = poses.select("track_id", "frame", "x", "y", "z", *(s.alias(f"s{c}") for s, c in zip(step, "xyz")))
    rows = rows.where("sx IS NOT NULL").select("*", norm(vec("s")).alias("len"))
    rows = rows.select("*", F.sum("len").over(w).alias("end"), F.sum("len").over(Window.partitionBy("track_id")).alias("all")).where("len > 0")
    rows = rows.select("*", (F.col("end") - F.col("len")).alias("start"), (F.col("all") / parts).alias("each"))
    at = F.explode(F.array(*(F.lit(i) for i in range(parts)))).alias("i")
    rows = rows.select("*", at).where("i * each >= start - 1e-9 AND i * each < end - 1e-9")
    share = (F.col("i") * F.col("each") - F.col("start")) / F.col("len")
    return rows.select("track_id", "i", *((F.col(c) + share * F.col(f"s{c}")).alias(c) for c in "xyz"))


#: Velocity, acceleration and jerk as weights of the last points, the newest first.
MOTION = {"velocity": (1, -1), "acceleration": (1, -2, 1), "jerk": (1, -3, 3, -1)}


def ordered_motion(poses: DataFrame, order: tuple[str, str, str] = tuple(MOTION)) -> DataFrame:
    """(track_id, step, k, size, along, across, third0 .. third2, next0 .. next2, frame); k from 4; null where the first two vectors make no frame.

    The frame's first axis is along the first vector of ``order``, its second along the part of the second across that, its third across both. size is the
    first vector's, along and across are the second's parts, third is the last vector in the three axes and next the next displacement in them. frame has the
    axes as rows of a matrix, nine numbers, which takes vectors of the world into the frame.
    """
    if sorted(order) != sorted(MOTION):
        raise ValueError("the order has to name velocity, acceleration and jerk")
    rows = with_history(down_sampled(poses), 4).where("k >= 4")
    p = [vec(suffix=s) for s in "1234"]
    first, second, third = (combine(MOTION[n], p[: len(MOTION[n])]) for n in order)
    rows = rows.select("*", *(divide(c, norm(first)).alias(f"u{n}") for c, n in zip(first, "xyz")))
    across = minus(second, scale(vec("u"), dot(second, vec("u"))))
    rows = rows.select("*", *(c.alias(f"c{n}") for c, n in zip(across, "xyz")))
    rows = rows.select("*", *(divide(c, norm(vec("c"))).alias(f"w{n}") for c, n in zip(vec("c"), "xyz")))
    axes = [vec("u"), vec("w"), cross(vec("u"), vec("w"))]
    moved = minus(vec(), p[0])
    frame = F.when(F.col("wx").isNotNull(), F.array(*(c for e in axes for c in e)))
    return rows.select(
        *KEYS, "k", norm(first).alias("size"), dot(second, axes[0]).alias("along"), dot(second, axes[1]).alias("across"),
        *(dot(third, e).alias(f"third{i}") for i, e in enumerate(axes)), *(dot(moved, e).alias(f"next{i}") for i, e in enumerate(axes)), frame.alias("frame"),
    )


def local_motion(poses: DataFrame) -> DataFrame:
    """``ordered_motion`` in the frame of the last velocity and the acceleration across it, as speed, acc_along, acc_across and the jerk in the three axes."""
    names = {"size": "speed", "along": "acc_along", "across": "acc_across"} | {f"third{i}": f"jerk{i}" for i in range(3)}
    return ordered_motion(poses).withColumnsRenamed(names).drop("frame")
