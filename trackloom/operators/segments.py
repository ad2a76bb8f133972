"""Point-to-point movements between still poses, minimum-jerk curves through them, and the nearest rotation to an extrapolated matrix.

A curve of duration d is a polynomial in i / d, i being the rows since the movement's start. So the weighted sums of i^p and of i^p times the way
from the start, running over a movement, hold all that the fit of any duration needs: its end and its residual follow in closed form. No pose of a
movement is left out, however long it is, and no row carries those before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.layers import ORDER, UPTO, Layer, apply, arc, dot, each, lags, matrix, norm
from .features import base
from .predict import KEYS, down_sampled

#: Still is a move of less than this; a turn beyond TURN, or a third difference of jerk that outweighs the acceleration, ends a movement.
STILL, TURN, JUMP, OUTWEIGHS = "10", "pi() / 6", "0.1", "1.25"
#: A weight grows by the inverse square of this with a pose's age, so that a movement's start holds.
FADING = 0.91
#: Durations of a fit, as multiples of the time so far.
DURATIONS = 1 + np.arange(33) / 8

#: From (track_id, step, k, x, y, z): moving, the rows since the last one that belongs to no movement, and moving_x, moving_y, moving_z, the same on one
#: axis, where a move of less than STILL to the positive side is still and a change of sign is a turn. Accelerations are by time, jerks are not.
ARM: list[Layer] = [
    lags(["x", "y", "z"], 6),
    each("v@", "(@ - @1)") | each("u@", "(@1 - @2)") | each("a@", "(@ - 2 * @1 + @2)") | each("p@", "(@ - 6 * @1 + 15 * @2 - 20 * @3 + 15 * @4 - 6 * @5 + @6)"),
    {"nv": norm("v@"), "nu": norm("u@"), "na": norm("a@"), "np": norm("p@"), "uv": dot("u@", "v@")},
    {"turn_cos": "uv / nullif(nu * nv, 0)", "still": f"coalesce(nv < {STILL}, false)", "was_still": f"coalesce(nu < {STILL}, false)"}
    | each("still_@", f"coalesce(v@ < {STILL}, false)") | each("was_still_@", f"coalesce(u@ < {STILL}, false)"),
    {"turn": arc("turn_cos")},
    {
        "outside": f"k = 0 OR still OR (k >= 2 AND coalesce(turn > {TURN}, false) AND NOT was_still) OR coalesce(np > {JUMP} AND np > {OUTWEIGHS} * na / (step * step), false)"
    }
    | each("outside_@", f"k = 0 OR still_@ OR (k >= 2 AND sign(v@) <> sign(u@) AND NOT was_still_@) OR coalesce(abs(p@) > {JUMP} AND abs(p@) > {OUTWEIGHS} * abs(a@), false)"),
    {"moving": f"k - max(CASE WHEN outside THEN k END) OVER {UPTO}"} | each("moving_@", f"k - max(CASE WHEN outside_@ THEN k END) OVER {UPTO}"),
]


def _fit(name: str, moving: str, axes: str) -> list[Layer]:
    """<name>_x and so on: where a curve through the movement's poses, all of ``axes`` on one duration, is a row later; null for fewer than three poses.

    For a duration the best end is the least-squares solution; of the durations the one of the least weighted residual is taken, ties to the shortest.
    With r = 1 / d, the residual is the weighted square of the way, which no duration changes, less ways(r) / sizes(r).
    """
    over = f"OVER (PARTITION BY track_id, step, {name}_start ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    powers = [(3, "w3"), (4, "(w3 * i)"), (5, "(w3 * i * i)")]
    named = lambda p, c: f"{name}_way{p}{c}"
    product = lambda p, q: "(" + " + ".join(f"{named(p, c)} * {named(q, c)}" for c in axes) + ")"
    ways = {6: product(3, 3), 7: product(3, 4), 8: f"(225 * {product(4, 4)} + 120 * {product(3, 5)})", 9: product(4, 5), 10: product(5, 5)}
    quartic = lambda c6, c7, c8, c9, c10: f"(100 * {c6} + r * (-300 * {c7} + r * ({c8} + r * (-180 * {c9} + r * 36 * {c10}))))"
    sizes = quartic(*(f"345 * {name}_size8" if p == 8 else f"{name}_size{p}" for p in range(6, 11)))
    gain = f"named_struct('gain', {quartic(*(f'{name}_ways{p}' for p in range(6, 11)))} / {sizes}, 'order', -j, 'r', r)"
    tau = f"least(1e0, ({moving} + 1) * r)"
    return [
        {f"{name}_start": f"k - {moving}", "i": f"CAST({moving} AS DOUBLE)"},
        {f"{name}_from{c}": f"first_value({c}) {over}" for c in axes} | {"w3": f"power({FADING * FADING!r}e0, i) * i * i * i"},
        {f"{name}_size{p}": f"sum(w3 * {' * '.join(['i'] * (p - 3))}) {over}" for p in range(6, 11)}
        | {named(p, c): f"sum({w} * ({c} - {name}_from{c})) {over}" for p, w in powers for c in axes},
        {f"{name}_ways{p}": e for p, e in ways.items()},
        {f"{name}_best": f"CASE WHEN {moving} >= 2 THEN array_max(transform(transform(sequence(0, {len(DURATIONS) - 1}), j -> 8e0 / ((8 + j) * i)), (r, j) -> {gain})) END"},
        {"r": f"{name}_best.r"},
        {f"{name}_scale": f"(r * r * r * {sizes})", f"{name}_tau": tau},
        {f"{name}_share": f"{name}_tau * {name}_tau * {name}_tau * (10 - 15 * {name}_tau + 6 * {name}_tau * {name}_tau)"},
        {f"{name}_{c}": f"{name}_from{c} + {name}_share * (10 * {named(3, c)} + r * (-15 * {named(4, c)} + r * 6 * {named(5, c)})) / {name}_scale" for c in axes},
    ]


def _apply(rows: DataFrame, name: str, moving: str, axes: str) -> DataFrame:
    kept = rows.columns
    return apply(rows, _fit(name, moving, axes)).select(*kept, *(f"{name}_{c}" for c in axes))


def predictions(rows: DataFrame) -> DataFrame:
    """``rows`` (track_id, step, k, x, y, z and others) with moving, and where minimum-jerk curves are a row later: joint_x, y, z by one duration for all
    axes, split_x, y, z by movements and durations of each axis; null where there is no fit.

    All windows are within a track and step, so there is one exchange.
    """
    kept = rows.columns
    rows = apply(rows, ARM).select(*kept, "moving", *(f"moving_{c}" for c in "xyz"))
    rows = _apply(rows, "joint", "moving", "xyz")
    for c in "xyz":
        rows = _apply(rows, "split", f"moving_{c}", c)
    return rows.drop(*(f"moving_{c}" for c in "xyz"))


def movements(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, moving): rows since the last pose that belongs to no movement, 0 for such a pose itself."""
    return apply(down_sampled(poses).select(*KEYS, "k", "x", "y", "z"), ARM).select(*KEYS, "k", "moving")


#: Errors of the pose after k.
ERRORS: list[Layer] = [
    each("next@", f"lead(@) OVER {ORDER}") | each("quad@", f"(3 * @ - 3 * lag(@) OVER {ORDER} + lag(@, 2) OVER {ORDER})"),
    {"quad": norm("(quad@ - next@)"), "err": norm("(joint_@ - next@)"), "split": norm("(coalesce(split_@, quad@) - next@)"), "axes": " + ".join(f"CAST(split_{c} IS NOT NULL AS INT)" for c in "xyz")},
]


def min_jerk_errors(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, moving, err, split, axes, quad): how far the pose after k is from the minimum-jerk predictions, and from the quadratic one.

    Movements of fewer than three poses have no fit and a null err; of split, the ``axes`` that have no fit take the quadratic prediction.
    """
    rows = predictions(down_sampled(poses).select(*KEYS, "k", "x", "y", "z"))
    return apply(rows, ERRORS).where("nextx IS NOT NULL AND k >= 2").select(*KEYS, "k", "moving", "err", "split", "axes", "quad")


def nearest_rotations(matrices: np.ndarray) -> np.ndarray:
    """Of each 3 x 3 matrix the rotation that is nearest to it."""
    u, _, v = np.linalg.svd(matrices)
    v[:, -1, :] *= (np.linalg.det(u) * np.linalg.det(v))[:, None]
    return u @ v


def matrix_errors(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, err): the angle between an orientation and the rotation nearest to 3 A - 3 B + C, the matrices before it; k from 3.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). A batch of rows is decomposed at once.
    """
    parts = [f"{i}{j}" for i in range(3) for j in range(3)]
    rows = apply(base(poses), [matrix("m", "q@"), lags([f"m{p}" for p in parts], 3)]).where("k >= 3")
    rows = rows.selectExpr(*KEYS, "k", "array(" + ", ".join(f"m{p}" for p in parts) + ") AS true", "array(" + ", ".join(f"3 * m{p}1 - 3 * m{p}2 + m{p}3" for p in parts) + ") AS rough")

    def run(batches):
        for b in batches:
            if len(b):
                true, rough = (np.array(b[c].tolist()).reshape(-1, 3, 3) for c in ("true", "rough"))
                cosine = (np.einsum("rij,rij->r", nearest_rotations(rough), true) - 1) / 2
                yield b[["track_id", "step", "k"]].assign(err=np.arccos(np.clip(cosine, -1, 1)))

    return rows.mapInPandas(run, "track_id long, step long, k long, err double")
