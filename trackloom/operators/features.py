"""Features of a track's motion up to a frame, for learning which model predicts the next frame best.

Rows are targets (track_id, step, k); all features look at the poses before the target only: the newest one, at k - 1, is x1, y1, z1.
Everything is computed in one pass over one window. Ratios with a divisor of 0, and circle features
where no circle of a valid radius goes through the last three points, are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.layers import ORDER, UPTO, Layer, apply, arc, conjugate, cross, dot, each, lags, matrix, norm, quat, ratio, times, unit
from .predict import down_sampled
from .rotation import oriented

#: Displacement that is still, turn that is a new direction, distance from the circle that ends a circular motion, as a share of its radius.
STILL, TURN, OFF_CIRCLE = "10", "pi() / 6", "0.1"
CIRCLES = {"circ1": ("1", "0"), "circ2": ("1.5", "-0.5"), "circ3": ("2", "-1")}


def _since(event: str, name: str, sums: dict[str, tuple[str, int]]) -> list[Layer]:
    """Rows since the last event, and what ``sums`` (name: column, earlier rows counted in) add up to since."""
    at = f"CASE WHEN k > 0 AND ({event}) THEN k END"
    run = {f"run_{n}": f"sum(coalesce({c}, 0)) OVER {UPTO}" for n, (c, _) in sums.items()}
    before = {f"before_{n}": f"lag(run_{n}, {rows}, 0e0) OVER {ORDER}" for n, (_, rows) in sums.items()}
    last = {f"last_{name}": f"max({at}) OVER {UPTO}"} | {f"held_{n}": f"max_by(before_{n}, {at}) OVER {UPTO}" for n in sums}
    return [run, before, last, {name: f"k - last_{name}"} | {n: f"run_{n} - held_{n}" for n in sums}]


def layers() -> list[Layer]:
    """From (track_id, step, k, x, y, z, qw, qx, qy, qz) to all features and what they are made of."""
    p1, p2, p3 = (quat(f"q@{i}") for i in (1, 2, 3))
    motion = [
        lags(["x", "y", "z"], 5) | lags(["qw", "qx", "qy", "qz"], 3) | {"s": "CAST(step AS DOUBLE)"},
        each("v@", "(@1 - @2)") | each("u@", "(@2 - @3)") | each("t@", "(@3 - @4)") | each("j@", "(@1 - 3 * @2 + 3 * @3 - @4)"),
        each("a@", "(v@ - u@)") | each("ab@", "(@1 - @3)") | {"nv": norm("v@"), "nu": norm("u@"), "nj": norm("j@")},
        each("v2@", "(v@ + a@ / 2)") | {"na": norm("a@"), "uv": dot("u@", "v@")} | cross("m@", "u@", "ab@"),
        {"nv2": norm("v2@"), "nm": norm("m@"), "mm": dot("m@", "m@"), "uu": dot("u@", "u@"), "bb": dot("ab@", "ab@"), "turn_cos": "uv / nullif(nu * nv, 0)"}
        | cross("f@", "m@", "u@") | cross("g@", "ab@", "m@"),
        unit("vh@", "v@", "nv") | unit("v2h@", "v2@", "nv2") | unit("ah@", "a@", "na") | unit("n@", "m@", "nm")
        | each("o@", "(f@ * bb + g@ * uu) / nullif(2 * mm, 0)") | {"turn": arc("turn_cos")},
        each("c@", "(@3 + o@)") | {"rr": dot("o@", "o@"), "av": dot("a@", "v2h@")} | cross("pn@", "v2h@", "ah@"),
        each("d@", "(@3 - c@)") | each("e@", "(@2 - c@)") | each("h@", "(@1 - c@)") | each("w@", "(a@ - v2h@ * av)") | {"rad": "sqrt(rr)", "npn": norm("pn@")},
        {"cos1": f"{dot('d@', 'e@')} / nullif(rr, 0)", "cos2": f"{dot('e@', 'h@')} / nullif(rr, 0)", "nw": norm("w@")}
        | cross("de@", "d@", "e@") | cross("eh@", "e@", "h@") | cross("side@", "n@", "h@") | unit("pm@", "pn@", "npn"),
        {"abs1": arc("cos1"), "abs2": arc("cos2"), "sign1": dot("m@", "de@"), "sign2": dot("m@", "eh@")} | unit("wh@", "w@", "nw"),
        {"th1": "CASE WHEN sign1 < 0 THEN -abs1 ELSE abs1 END", "th2": "CASE WHEN sign2 < 0 THEN -abs2 ELSE abs2 END"},
        {"valid": "coalesce(rr <= 250000 AND abs(th1 + th2) <= pi() / 2, false)"},
    ]
    circle = [
        {"circ_rad": "CASE WHEN valid THEN rad END", "circ_speed": "CASE WHEN valid THEN rad * th2 END", "ang": "CASE WHEN valid THEN th2 END", "ang1": "CASE WHEN valid THEN th1 END"},
        {f"{c}_p": f"lag({c}) OVER {ORDER}" for c in ("circ_rad", "cx", "cy", "cz", "nx", "ny", "nz", "turn", "pmx", "pmy", "pmz", "valid")},
        each("i@", "(@1 - c@_p)"),
        {"height": dot("i@", "n@_p")},
        each("in@", "(i@ - height * n@_p)"),
        {"away": norm("in@")},
        {"from_circle": "CASE WHEN valid AND valid_p THEN sqrt((away - circ_rad_p) * (away - circ_rad_p) + height * height) END"},
        {"from_circle_ratio": "from_circle / nullif(circ_rad_p, 0)"},
        {"circular": f"coalesce(from_circle_ratio <= {OFF_CIRCLE}, false)"},
        *_since(f"k < 2 OR nv < {STILL}", "still_rows", {}),
        *_since(f"k < 3 OR coalesce(turn > {TURN}, false)", "turn_rows", {"dist_since_turn": ("nv", 1)}),
        *_since("k < 4 OR NOT circular", "circle_rows", {"ang_sum": ("ang", 3), "arc_sum": ("circ_speed", 3)}),
    ]
    turned = [
        times("na@", p1, conjugate(p2)) | times("nb@", p2, conjugate(p3)),
        {"size_a": norm("na@"), "size_b": norm("nb@")},
        {"phi_cos": "abs(naw)", "phi_p_cos": "abs(nbw)"}
        | each("wa@", "CASE WHEN naw < 0 THEN -na@ ELSE na@ END / nullif(size_a, 0)") | each("wb@", "CASE WHEN nbw < 0 THEN -nb@ ELSE nb@ END / nullif(size_b, 0)"),
        {"half": arc("phi_cos"), "half_p": arc("phi_p_cos"), "about_last": dot("na@", "wb@"), "about_next": dot("nb@", "wa@")},
        {"phi": "2 * half", "phi_p": "2 * half_p",
         "closest_last": "2 * atan2(CASE WHEN naw < 0 THEN -about_last ELSE about_last END, abs(naw))",
         "closest_next": "2 * atan2(CASE WHEN nbw < 0 THEN -about_next ELSE about_next END, abs(nbw))"}
        | matrix("ma", "q@1") | matrix("mb", "q@2"),
        each("wd@", "(wa@ - wb@)") | each("rot@", "coalesce(wa@ * phi / s, 0)") | each("rotacc@", "(coalesce(wa@ * phi, 0) - coalesce(wb@ * phi_p, 0)) / s"),
    ]
    entries = " + ".join(f"(ma{r}{c} - mb{r}{c} + v{a}) * (ma{r}{c} - mb{r}{c} + v{a})" for r, a in enumerate("xyz") for c in range(3))
    return [*motion, *circle, *turned, {"axes_diff": f"2 * ({entries})"}]


#: Scalar features by name, over what ``layers`` gives.
SCALARS = {
    "timestep": "s", "frame_num": "CAST(k - 1 AS DOUBLE)", "timestamp": "(k - 1) * s",
    "speed_deg1": "nv / s", "speed_deg2": "nv2 / s", "acc_mag": "na / (s * s)", "jerk_mag": "nj / (s * s * s)",
    "speed_acc_ratio": ratio("nv2 / s", "na / (s * s)"), "vel_bcs_ratio": ratio("uv", "nv * nv"),
    "disp_mag_diff": "nv - nu", "disp_mag_diff_timescaled": "(nv - nu) / s", "disp_mag_ratio": ratio("nv", "nu"),
    "bounce_angle": "turn", "bounce_angle_2_sum": "turn + turn_p", "vel_dot": "nu * nv",
    "circ_rad": "circ_rad", "circ_ang_speed": "ang / s", "circ_speed": "circ_speed / s", "circ_acc": "circ_rad * (ang - ang1) / (s * s)",
    "circ_ang_acc": "(ang - ang1) / s", "circ_speed_circ_acc_ratio": ratio("circ_speed / s", "circ_rad * (ang - ang1) / (s * s)"),
    "circ_ang_speed_circ_ang_acc_ratio": ratio("ang / s", "(ang - ang1) / s"), "circ_ang_ratio": ratio("ang", "ang1"),
    "rad_diff": "circ_rad - circ_rad_p", "timescaled_rad_diff": "(circ_rad - circ_rad_p) / s",
    "circ_centre_diff": "CASE WHEN valid AND valid_p THEN sqrt((cx - cx_p) * (cx - cx_p) + (cy - cy_p) * (cy - cy_p) + (cz - cz_p) * (cz - cz_p)) END",
    "circ_vec6_diff": "CASE WHEN valid AND valid_p THEN sqrt(" + " + ".join(
        f"(c{c} - c{c}_p) * (c{c} - c{c}_p) + (rad * n{c} - circ_rad_p * n{c}_p) * (rad * n{c} - circ_rad_p * n{c}_p)" for c in "xyz") + ") END",
    "dist_from_circle": "from_circle", "ratio_from_circle": "from_circle_ratio",
    "time_since_stationary": "still_rows * s", "time_since_dir_change": "turn_rows * s", "dist_since_dir_change": "dist_since_turn",
    "time_circ_motion": "(circle_rows + 3) * s", "ang_sum_circ_motion": "ang_sum", "dist_sum_circ_motion": "arc_sum",
    "unit_rot_ax_diff": "sqrt(wdx * wdx + wdy * wdy + wdz * wdz)", "unit_rot_ax_diff_timescaled": "sqrt(wdx * wdx + wdy * wdy + wdz * wdz) / s",
    "prev_fa_ang_acc": "(phi - closest_last) / (s * s)", "next_fa_ang_acc": "(closest_next - phi_p) / (s * s)", "ax3_sq_diff": "axes_diff",
    "ortho_acc_mag": "nw / (s * s)", "plane_normal_dot": "pmx * pmx_p + pmy * pmy_p + pmz * pmz_p",
    "speed_jerk_ratio": ratio("nv2 / s", "nj / (s * s * s)"), "acc_jerk_ratio": ratio("na / (s * s)", "nj / (s * s * s)"),
    "speed_ortho_acc_ratio": ratio("nv2 / s", "nw / (s * s)"), "acc_vel_deg2_err_ratio": ratio("na / (s * s * s)", "nj / (s * s * s)"),
}

#: Vectors and relative axes whose dot products and angles are features, over the layers of ``layers`` and ``pairs``.
VECTORS = {"acc": "a@ / (s * s)", "jerk": "j@ / (s * s * s)", "rot_vel": "rot@", "rot_acc": "rotacc@", "err_circ_vel_deg1": "lag_circ1_@",
           "err_circ_vel_deg2": "lag_circ2_@", "err_circ_acc": "lag_circ3_@", "err_jerk": "lag_jerk_@ / (s * s * s * s)"}
RELATIVE = {"vel_deg1": "vh@", "vel_deg2": "v2h@", "acc": "ah@", "ortho_acc": "wh@", "plane_normal": "pm@", "rotation": "wa@"}


def error_layers() -> list[Layer]:
    """What the circular predictors, off the circle the velocity, and the jerk predictor missed the last target by; the axes a frame earlier."""
    held = "(2 * @1 - @2)"
    angle = {n: f"greatest(-pi() / 2, least(pi() / 2, {a} * th2 + {b} * th1))" for n, (a, b) in CIRCLES.items()}
    out: Layer = {}
    for n in CIRCLES:
        out |= each(f"{n}_@", f"@ - CASE WHEN valid THEN c@ + h@ * cos({n}_angle) + side@ * sin({n}_angle) ELSE {held} END")
    out |= each("jerk_@", "@ - (4 * @1 - 6 * @2 + 4 * @3 - @4)")
    earlier = {f"lag_{n}_{c}": f"lag({n}_{c}) OVER {ORDER}" for n in (*CIRCLES, "jerk") for c in "xyz"}
    return [{f"{n}_angle": e for n, e in angle.items()}, out, earlier | {k: v for a in RELATIVE.values() for k, v in each(f"was_{a}", f"lag({a}) OVER {ORDER}").items()}]


def base(poses: DataFrame) -> DataFrame:
    """Down-sampled rows with quaternions of poses (track_id, frame, x, y, z, vx, vy, vz), v being the rotation's axis times its angle."""
    return down_sampled(oriented(poses)).select("track_id", "step", "k", "x", "y", "z", "qw", "qx", "qy", "qz")


def scalar_features(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, ``SCALARS``), a row for each target with four poses before it.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). Frames must not repeat within a track.
    """
    rows = apply(base(poses), layers()).where("k >= 4")
    return rows.selectExpr("track_id", "step", "k", *(f"{e} AS {n}" for n, e in SCALARS.items()))


def _structs(name: str, columns: dict[str, str]) -> str:
    return "inline(array(" + ", ".join(f"named_struct('{name}', '{n}', " + ", ".join(f"'{name}_{c}', {e.replace('@', c)}" for c in "xyz") + ")" for n, e in columns.items()) + "))"


def axis_features(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, vector, axis, shifted, dot, angle): each vector of ``VECTORS`` along each axis of ``RELATIVE``, of the newest frame and (shifted)
    of the one before; acceleration along the two velocities only. Unsigned forms are abs(dot) and least(angle, pi - angle).

    A long table: no column for each of the 360 features. Null where the vector or the axis is zero or missing.
    """
    rows = apply(base(poses), layers() + error_layers()).where("k >= 4")
    axes = {**RELATIVE, **{f"{n} shifted": f"was_{a}" for n, a in RELATIVE.items()}}
    rows = rows.selectExpr("track_id", "step", "k", *(e.replace("@", c) for e in axes.values() for c in "xyz"), _structs("vector", VECTORS))
    rows = rows.selectExpr("track_id", "step", "k", "vector", "vector_x", "vector_y", "vector_z", _structs("axis", axes))
    rows = rows.where("vector <> 'acc' OR axis LIKE 'vel%'")
    return apply(rows, PAIRS).selectExpr("track_id", "step", "k", "vector", "replace(axis, ' shifted', '') AS axis", "axis LIKE '% shifted' AS shifted", "dot", "angle")


PAIRS = [
    {"dot": dot("vector_@", "axis_@"), "size": norm("vector_@")},
    {"cosine": "dot / nullif(size, 0)"},
    {"angle": arc("cosine")},
]
