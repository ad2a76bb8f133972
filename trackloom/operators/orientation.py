"""Continuous rotation vectors, and predictors of the next orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.layers import ORDER, UPTO, Layer, Quat, apply, arc, conjugate, cross, dot, dot4, each, each4, lags, matrix, norm, quat, times, unit
from .features import base, layers as feature_layers
from .predict import KEYS

#: Turns below this have no axis of their own.
ZERO = "1e-4"


def unwrap_layers(q: str) -> list[Layer]:
    """Rotation vectors rx, ry, rz that don't jump by whole turns, from the matrices of the quaternions ``q``.

    An axis comes from the matrix by its trace or, near a half turn, by its largest diagonal entry. Rows without a
    turn take the last axis before them. Where an axis points away from the one before, both it and the angle change sign from there on. Last,
    whole turns are taken off as often as the angle has jumped by about one.
    """
    largest = {"0": ("1", "2"), "1": ("2", "0"), "2": ("0", "1")}
    grow = {i: f"sqrt(greatest(0e0, 1 + m{i}{i} - m{j}{j} - m{k}{k}))" for i, (j, k) in largest.items()}

    def by_branch(of_trace: str, of: dict[str, str]) -> str:
        return f"CASE WHEN trace >= m00 AND trace >= m11 AND trace >= m22 THEN {of_trace} WHEN m00 >= m11 AND m00 >= m22 THEN {of['0']} WHEN m11 >= m22 THEN {of['1']} ELSE {of['2']} END"

    back = {"0": "m21 - m12", "1": "m02 - m20", "2": "m10 - m01"}
    axis = {}
    for a, c in zip("012", "xyz"):
        of = {i: f"grow{i}" if i == a else f"(m{min(i, a)}{max(i, a)} + m{max(i, a)}{min(i, a)}) / nullif(grow{i}, 0)" for i in "012"}
        axis[f"raw{c}"] = by_branch(back[a], of)
    return [
        matrix("m", q),
        {"trace": "m00 + m11 + m22"} | {f"grow{i}": e for i, e in grow.items()},
        {"turn_cos": by_branch("(trace - 1) / 2", {i: f"({back[i]}) / nullif(2 * grow{i}, 0)" for i in "012"})} | axis,
        {"acos_turn": arc("turn_cos"), "raw_size": norm("raw@")},
        {"angle0": by_branch("acos_turn", dict.fromkeys("012", "2 * acos_turn"))},
        {"good": f"CASE WHEN angle0 >= {ZERO} AND raw_size > 0 THEN k END"} | each("unit@", "raw@ / nullif(raw_size, 0)"),
        each("axis@", f"coalesce(max_by(unit@, good) OVER {UPTO}, 0)"),
        each("last_axis@", f"lag(axis@) OVER {ORDER}"),
        {"away": f"CASE WHEN {dot('axis@', 'last_axis@')} < 0 THEN 1 ELSE 0 END"},
        {"side": f"1 - 2 * (sum(away) OVER {UPTO} % 2)"},
        {"angle1": "side * angle0"},
        {"jump": f"(angle1 - lag(angle1) OVER {ORDER}) / (2 * pi())"},
        {"turns": "rint(jump)"},
        {"angle2": f"angle1 - 2 * pi() * sum(coalesce(turns, 0)) OVER {UPTO}"},
        each("r@", "angle2 * side * axis@"),
    ]


def unwrapped(rows: DataFrame) -> DataFrame:
    """``rows`` (track_id, step, k, qw, qx, qy, qz) with rx, ry, rz, see ``unwrap_layers``."""
    return apply(rows, unwrap_layers("q@")).select(*KEYS, "k", "rx", "ry", "rz")


ALIGN: list[Layer] = [
    lags(["x", "y", "z"], 3),
    each("a@", "(@1 - 2 * @2 + @3)"),
    {"size": norm("a@")},
    unit("h@", "a@", "size"),
    {"near": f"{dot('h@', 'g@')}".replace("gx", f"lag(hx) OVER {ORDER}").replace("gy", f"lag(hy) OVER {ORDER}").replace("gz", f"lag(hz) OVER {ORDER}")},
    {"flips": f"CAST(sum(CASE WHEN near < 0 THEN 1 ELSE 0 END) OVER {UPTO} AS BIGINT)"},
    {"signed": "CASE WHEN flips % 2 = 1 THEN -size ELSE size END"},
]


def aligned(rows: DataFrame) -> DataFrame:
    """(track_id, step, k, signed, flips) of ``rows`` (track_id, step, k, x, y, z): accelerations before k, negative where their axis
    was turned over an odd number of times to stay on the side of the one before. k from 3."""
    return apply(rows, ALIGN).where("k >= 3").select(*KEYS, "k", "signed", "flips")


def _between(name: str, a: Quat, b: Quat, t: str, angle: str) -> Layer:
    """Spherical interpolation by t between quaternions whose angle is a column."""
    near = f"{angle} < {ZERO}"
    return {
        name.replace("@", c): f"CASE WHEN {near} THEN {a[c]} ELSE sin((1 - {t}) * {angle}) / nullif(sin({angle}), 0) * {a[c]} + sin({t} * {angle}) / nullif(sin({angle}), 0) * {b[c]} END"
        for c in "wxyz"
    }


def _twice(name: str, a: str, b: str) -> list[Layer]:
    """Interpolation by 2: as far beyond b as b is from a."""
    return [{f"{name}_dot": f"2 * {dot4(quat(a), quat(b))}"}, each4(f"{name}@", f"{name}_dot * {b} - {a}")]


def _about(name: str, axis: str, angle: str) -> Layer:
    return {f"{name}w": f"cos({angle} / 2)"} | each(f"{name}@", f"coalesce({axis}, 0) * sin({angle} / 2)")


def _angle(a: Quat) -> str:
    return f"2 * acos(least(1e0, abs({dot4(quat('q@'), a)})))"


#: Errors by name, over what ``layers`` gives: angles between the true and the predicted orientation.
PREDICTED = {
    "still": _angle(quat("q@1")), "vel": _angle(quat("vel@")), "squad": _angle(quat("squad@")), "arm": _angle(quat("arm@")), "circle_arm": _angle(quat("carm@")),
    "fixed_axis_bcs": _angle(quat("bcs@")), "fixed_axis_acc": _angle(quat("fa1@")), "fixed_axis_acc2": _angle(quat("fa2@")),
    "linear": _angle(quat("lin@")), "saturated": _angle(quat("sat@")), "aa_vel": _angle(quat("aav@")), "aa_acc": _angle(quat("aaa@")), "aa_acc_lerp": _angle(quat("aal@")),
    "aa_spline2": _angle(quat("aas@")),
}


def layers() -> list[Layer]:
    """From (track_id, step, k, x, y, z, qw .. qz) to the predicted quaternions, on top of ``features.layers``.

    na and nb are the turns to the newest pose and to the one before, wa and wb their axes, phi and phi_p their angles.
    """
    q1, q2 = quat("q@1"), quat("q@2")
    aa = {"aav": "2 * r@1 - r@2", "aaa": "r@1 + (r@1 - r@2) + 0.5 * (r@1 - 2 * r@2 + r@3)",
          "aal": "r@1 + 0.5 * ((r@1 - r@2) + 0.5 * (r@1 - 2 * r@2 + r@3))", "aas": "r@1 + (r@1 - r@2) + 5e0 / 6 * (r@1 - 2 * r@2 + r@3)"}
    rotation_vectors: list[Layer] = [
        {k: v for n, e in aa.items() for k, v in each(f"{n}_@", e).items()},
        {f"{n}_size": norm(f"{n}_@") for n in aa},
        {k: v for n in aa for k, v in ({f"{n}w": f"cos({n}_size / 2)"} | each(f"{n}@", f"{n}_@ * CASE WHEN {n}_size = 0 THEN 0.5 ELSE sin({n}_size / 2) / {n}_size END")).items()},
    ]
    # unwrap_layers uses some names of the features again, so it comes first and hands over its vectors only.
    return [
        *({f"uw_{n}" if n not in ("rx", "ry", "rz") else n: _renamed(e, own) for n, e in layer.items()} for layer, own in _own(unwrap_layers("q@"))),
        lags(["rx", "ry", "rz"], 3),
        *feature_layers(),
        *rotation_vectors,
        times("vel@", quat("na@"), q1) | times("next@", quat("q@"), conjugate(q1)) | {"axis_dot": dot("wa@", "wb@"), "q_cos": dot4(q2, q1), "move_cos": "turn_cos"}
        | cross("mv@", "vh@", "vh@"),
        *_twice("sa", "q@3", "q@2"),
        each4("sb@", "(sa@ + q@1)"),
        {"sb_size": f"sqrt({dot4(quat('sb@'), quat('sb@'))})"},
        each4("sc@", "sb@ / nullif(sb_size, 0)"),
        *_twice("sd", "sc@", "q@2"),
        *_twice("s0", "q@2", "sc@"), *_twice("s1", "sc@", "sd@"), *_twice("s2", "sd@", "q@1"),
        *_twice("s3", "s0@", "s1@"), *_twice("s4", "s1@", "s2@"), *_twice("squad_", "s3@", "s4@"),
        {f"squad{c}": f"squad_{c}" for c in "wxyz"},
        # The least rotation from one direction of motion to the next.
        each("uh@", "u@ / nullif(nu, 0)"),
        {"turn_w": f"1 + {dot('uh@', 'vh@')}"} | cross("turn_@", "uh@", "vh@"),
        {"turn_size": f"sqrt({dot4(quat('turn_@'), quat('turn_@'))})"},
        each4("tn@", "turn_@ / nullif(turn_size, 0)"),
        times("l0@", conjugate(quat("tn@")), q1) | _about("cn", "n@", "greatest(-pi() / 2, least(pi() / 2, 1.5 * th2 - 0.5 * th1))"),
        times("l1@", conjugate(q2), quat("l0@")),
        times("l2@", q1, quat("l1@")),
        times("arm_@", quat("tn@"), quat("l2@")) | times("carm_@", quat("cn@"), quat("l2@")),
        each4("arm@", "coalesce(arm_@, vel@)") | each4("carm@", "CASE WHEN valid THEN coalesce(carm_@, vel@) ELSE vel@ END"),
        {"q_angle": arc("q_cos"), "next_about": dot("next@", "wa@"),
         "ratio1": "2 + CASE WHEN axis_dot < cos(radians(1)) THEN (phi - phi_p) / nullif(phi, 0) ELSE 0 END",
         "ratio2": "2 + least(0e0, phi - closest_next) / nullif(phi, 0)",
         "sat_angle": "phi / pow(1 + pow(phi / (2 * pi()), 0.75e0), 1 / 0.75e0)"},
        {"best_angle": "2 * atan2(CASE WHEN nextw < 0 THEN -next_about ELSE next_about END, abs(nextw))",
         "t1": "coalesce(ratio1, 2)", "t2": "coalesce(ratio2, 2)"} | each("lv@", "(2 * coalesce(wa@ * phi, 0) - coalesce(wb@ * phi_p, 0))"),
        {"lv_size": norm("lv@"), "b_angle": "coalesce(best_angle, 0)"} | _between("fa1@", q2, q1, "t1", "q_angle") | _between("fa2@", q2, q1, "t2", "q_angle"),
        _about("bq", "wa@", "b_angle") | _about("sq", "wa@", "sat_angle")
        | {"lqw": "cos(lv_size / 2)"} | each("lq@", "lv@ * CASE WHEN lv_size = 0 THEN 0.5 ELSE sin(lv_size / 2) / lv_size END"),
        times("bcs@", quat("bq@"), q1) | times("sat@", quat("sq@"), q1) | times("lin@", quat("lq@"), q1),
    ]


def _own(every: list[Layer]) -> list[tuple[Layer, set[str]]]:
    names: set[str] = set()
    out = []
    for layer in every:
        out.append((layer, set(names)))
        names |= set(layer)
    return out


def _renamed(expression: str, own: set[str]) -> str:
    import re

    return re.sub(r"[a-z_]\w*", lambda m: f"uw_{m[0]}" if m[0] in own and m[0] not in ("rx", "ry", "rz") else m[0], expression)


def orientation_errors(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, ``PREDICTED``): angles between each pose's orientation and what the predictors make of those before; k from 4.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). Where a predictor has no axis or circle it repeats the last turn. fixed_axis_bcs
    looks at the true orientation: a bound, not a predictor.
    """
    rows = apply(base(poses), layers()).where("k >= 4")
    return rows.selectExpr(*KEYS, "k", *(f"{e} AS {n}" for n, e in PREDICTED.items()))
