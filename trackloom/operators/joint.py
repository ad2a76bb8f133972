"""Orientations of an object that turns evenly, seen by a camera that turns evenly.

With C and M the turns of camera and object from frame to frame, a view's orientation B obeys B(k-1) = C B(k) M', so the turn D(k) = B(k) B(k-1)' becomes the
one before it when turned by C. C is found from where it takes axes: the axis of D(k) to that of D(k-1), and, once there are four views, the plane of it and
of the axis of two turns together to that plane a frame earlier. Axes are turned to the side of those before, their number of changes carried along the track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.layers import ORDER, UPTO, Layer, apply, conjugate, cross, dot, dot4, each, each4, lags, norm, quat, times
from .features import base
from .predict import KEYS

#: Squared sines of axes below this tell no axis; a turn that C leaves further off than GATE falls back to repeating the last turn.
LEAST, GATE = "1e-5", "pi()"


def _carried(name: str, a: str, size: str) -> list[Layer]:
    """Unit vectors; where there is none the last one before, or the first axis."""
    held = {f"{name}{c}": f"coalesce(max_by({name}_unit{c}, CASE WHEN {size} > 0 THEN k END) OVER {UPTO}, {'1e0' if c == 'x' else '0e0'})" for c in "xyz"}
    return [each(f"{name}_unit@", f"{a} / nullif({size}, 0)"), held]


def _one_side(name: str, a: str) -> list[Layer]:
    """Turned over where the dot product with the one before, unturned, has been negative an odd number of times."""
    return [
        {f"{name}_near": "(" + " + ".join(f"{a.replace('@', c)} * lag({a.replace('@', c)}) OVER {ORDER}" for c in "xyz") + ")"},
        {f"{name}_side": f"1 - 2 * (sum(CASE WHEN {name}_near < 0 THEN 1 ELSE 0 END) OVER {UPTO} % 2)"},
        each(f"{name}@", f"{name}_side * {a}"),
    ]


def layers() -> list[Layer]:
    """From (track_id, step, k, qw .. qz) to c, the camera's turn back, its residual, and jo, the orientation after k by it; vel repeats the last turn."""
    return [
        lags(["qw", "qx", "qy", "qz"], 1),
        times("d@", quat("q@"), conjugate(quat("q@1"))),
        {"d_size": norm("d@")} | each4("b@", f"lag(d@) OVER {ORDER}"),
        times("two@", quat("d@"), quat("b@")) | times("vel@", quat("d@"), quat("q@")),
        {"two_size": norm("two@")},
        *_carried("one", "d@", "d_size"),
        *_carried("both", "two@", "two_size"),
        cross("up@", "one@", "both@"),
        {"up_size": norm("up@")},
        each("plane@", "CASE WHEN up_size > 0 THEN up@ / up_size ELSE up@ END"),
        *_one_side("to", "one@"),
        *_one_side("flat", "plane@"),
        each("from@", f"lag(to@) OVER {ORDER}") | each("was@", f"lag(flat@) OVER {ORDER}") | {"was_up": f"lag(up_size) OVER {ORDER}"},
        each("move@", "(to@ - from@)") | each("tilt@", "CASE WHEN up_size > 0 AND was_up > 0 THEN flat@ - was@ ELSE 0e0 END"),
        cross("pole@", "move@", "tilt@") | cross("least@", "to@", "from@"),
        {"pole_square": dot("pole@", "pole@"), "least_size": norm("least@"), "cosine": dot("to@", "from@")},
        # At the third view there is one plane only.
        {"known": f"coalesce(k >= 3 AND pole_square > {LEAST}, false)"},
        each("axis@", f"CASE WHEN known THEN pole@ / sqrt(pole_square) WHEN least_size >= {LEAST} THEN least@ / least_size ELSE least@ END"),
        {"to_along": dot("to@", "axis@"), "from_along": dot("from@", "axis@"), "against": dot("least@", "axis@")},
        each("to_side@", "(to@ - to_along * axis@)") | each("from_side@", "(from@ - from_along * axis@)"),
        {"side_cosine": f"{dot('to_side@', 'from_side@')} / nullif({norm('to_side@')} * {norm('from_side@')}, 0)"},
        {"bend": "acos(greatest(-1e0, least(1e0, CASE WHEN known THEN side_cosine ELSE cosine END)))"},
        {"angle": "CASE WHEN known AND against < 0 THEN -bend ELSE bend END"},
        {"cw": "cos(angle / 2)"} | each("c@", "axis@ * sin(angle / 2)"),
        times("ct@", quat("c@"), quat("d@")) | times("cb@", quat("c@"), quat("q@")) | times("bc@", conjugate(quat("c@")), quat("q@")),
        times("cdc@", quat("ct@"), conjugate(quat("c@"))) | times("m@", conjugate(quat("q@1")), quat("cb@")),
        times("jo_@", quat("bc@"), quat("m@")) | {"residual": f"2 * acos(least(1e0, abs({dot4(quat('cdc@'), quat('b@'))})))"},
        each4("jo@", f"CASE WHEN k >= 2 AND jo_w IS NOT NULL AND residual <= {GATE} THEN jo_@ ELSE vel@ END"),
    ]


def predictions(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, qw .. qz, cw .. cz, residual, jow .. joz): of each view the camera's turn back and the next orientation, k from 1.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). With fewer than three views, or where C has no axis of its own, the last turn is repeated.
    """
    rows = apply(base(poses), layers()).where("k >= 1")
    return rows.selectExpr(*KEYS, "k", *(f"{n}{c}" for n in ("q", "c") for c in "wxyz"), "residual", *(f"jo{c}" for c in "wxyz"))


def errors(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, residual, err): the angle between the orientation after k and the predicted one, and what C leaves of the last turn; k from 1."""
    rows = apply(base(poses), [*layers(), each4("next@", f"lead(q@) OVER {ORDER}")]).where("k >= 1 AND nextw IS NOT NULL")
    return rows.selectExpr(*KEYS, "k", "CASE WHEN k >= 2 THEN residual END AS residual", f"2 * acos(least(1e0, abs({dot4(quat('next@'), quat('jo@'))}))) AS err")
