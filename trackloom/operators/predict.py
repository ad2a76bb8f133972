"""Down-sampling and position predictors over ordered tracks.

All predictors are computed in one pass over one window: partitioned by track and step, so the
exchange that brought a track's rows together serves every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, combine, divide, dot, minus, norm, vec

STEPS = (1, 2, 3)
KEYS = ["track_id", "step"]
#: Weights of the last points, the newest first.
LINEAR: dict[str, list[float]] = {
    "STATIC": [1],
    "VEL_DEG1": [2, -1],
    "VEL_DEG2": [2.5, -2, 0.5],
    "ACC_DEG2": [3, -3, 1],
    "JERK": [4, -6, 4, -1],
    "DEG4": [109 / 24, -25 / 3, 31 / 4, -11 / 3, 17 / 24],
    "SPLINE2": [1 + 1 + 5 / 6, -1 - 10 / 6, 5 / 6],
    "ACC_LERP": [1 + 0.9 + 0.45, -0.9 - 0.9, 0.45],
}
HISTORY = 5


def order() -> Window:
    return Window.partitionBy(*KEYS).orderBy("k")


def down_sampled(poses: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Each step's rows (step, k, ...): the frames divisible by it. No shuffle."""
    every = poses.withColumn("step", F.explode(F.array(*(F.lit(s).cast("long") for s in steps))))
    return every.where("frame % step = 0").withColumn("k", F.expr("frame div step"))


def with_history(steps: DataFrame, n: int = HISTORY) -> DataFrame:
    """x1 .. xn and so on: the positions 1 to n rows earlier."""
    w = order()
    return steps.select("*", *(F.lag(c, i).over(w).alias(f"{c}{i}") for i in range(1, n + 1) for c in "xyz"))


def linear(name: str) -> Vec:
    """A predictor, or while the history is too short the best shorter one: quadratic, velocity, hold."""
    chain = [LINEAR[name], *(c for c in (LINEAR["ACC_DEG2"], LINEAR["VEL_DEG1"], LINEAR["STATIC"]) if len(c) < len(LINEAR[name]))]
    each = [combine(c, [vec(suffix=str(i)) for i in range(1, len(c) + 1)]) for c in chain]
    return [F.coalesce(*(e[i] for e in each)) for i in range(3)]


def angle_scaled_velocity() -> Vec:
    """Velocity scaled by r = 0.63837237 (acc . v) / v.v + 0.83709242; hold without two differences."""
    v, u = minus(vec(suffix="1"), vec(suffix="2")), minus(vec(suffix="2"), vec(suffix="3"))
    r = F.lit(0.63837237) * divide(dot(minus(v, u), v), dot(v, v)) + F.lit(0.83709242)
    return [F.coalesce(p + r * q, p) for p, q in zip(vec(suffix="1"), v)]


def best_scaled_velocity() -> Vec:
    """The best scale of the last velocity, looking at the true next pose: a bound, not a predictor."""
    v, moved = minus(vec(suffix="1"), vec(suffix="2")), minus(vec(), vec(suffix="1"))
    r = divide(dot(moved, v), dot(v, v))
    return [F.coalesce(p + r * q, p) for p, q in zip(vec(suffix="1"), v)]


def predictors() -> dict[str, Vec]:
    return {name: linear(name) for name in LINEAR} | {"VEL_ANG": angle_scaled_velocity(), "VEL_BCS": best_scaled_velocity()}


def errors(poses: DataFrame, models: list[str] | None = None, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(track_id, step, k, and an error norm for each model), wide; k from 1."""
    rows = with_history(down_sampled(poses, steps)).where("k > 0")
    made = predictors()
    return rows.select(*KEYS, "k", *(norm(minus(vec(), made[m])).alias(m) for m in models or made))


def long_errors(wide: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(track_id, step, k, ordinal, model, err): a row for each model."""
    models = models or [c for c in wide.columns if c not in (*KEYS, "k")]
    each = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("model"), F.col(m).alias("err")) for i, m in enumerate(models)))
    return wide.select(*KEYS, "k", F.inline(each))


def kinematics(poses: DataFrame) -> DataFrame:
    """Speed, acceleration and jerk magnitudes by finite differences, divided by step, its square and cube; turn angle."""
    rows = with_history(down_sampled(poses), 3)
    p = [vec(suffix=s) for s in ("", "1", "2", "3")]
    s = F.col("step").cast("double")
    v, u = minus(p[0], p[1]), minus(p[1], p[2])
    from ..functions.vec import angle

    return rows.where("k >= 3").select(
        *KEYS,
        "k",
        (norm(v) / s).alias("speed"),
        (norm(minus(v, u)) / (s * s)).alias("acc"),
        (norm(combine([1, -3, 3, -1], p)) / (s * s * s)).alias("jerk"),
        angle(u, v).alias("turn"),
        divide(dot(v, u), dot(v, v)).alias("vel_bcs_ratio"),
    )


def fir(steps: DataFrame, weights: list[float], column: str, out: str) -> DataFrame:
    """A sliding filter with the newest row's weight first; null until it has all its rows."""
    w = order()
    total: Column = F.lit(weights[0]) * F.col(column)
    for i, c in enumerate(weights[1:], 1):
        total = total + F.lit(c) * F.lag(column, i).over(w)
    return steps.withColumn(out, total)


def since(rows: DataFrame, flag: str, first: int, out: str) -> DataFrame:
    """Rows since the last row with a flag; the ``first`` rows of a track count as flagged."""
    w = order().rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(order())
    rows = rows.withColumn("at__", at)
    last = F.last(F.when(F.col(flag) | (F.col("at__") <= first), F.col("at__")), ignorenulls=True).over(w)
    return rows.withColumn(out, F.col("at__") - last).drop("at__")
