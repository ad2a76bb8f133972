"""Training tables for choosing a predictor by frame: features of the poses before it, the errors of each predictor, the best one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import ORDER, Layer, apply, dot, each
from . import evaluate, localized, segments
from .features import SCALARS, base, error_layers, layers
from .predict import KEYS

HELD = {"STATIC": "@1", "VEL_DEG1": "(2 * @1 - @2)", "VEL_DEG2": "(2.5e0 * @1 - 2 * @2 + 0.5e0 * @3)", "ACC_DEG2": "(3 * @1 - 3 * @2 + @3)", "JERK": "(4 * @1 - 6 * @2 + 4 * @3 - @4)"}
CIRCLES = {"CIRC_VEL_DEG1": "circ1", "CIRC_VEL_DEG2": "circ2", "CIRC_ACC": "circ3"}
CURVES = {"MIN_JERK": "joint", "MIN_JERK_SPLIT": "split"}
CLASSES = [*HELD, *CIRCLES, *CURVES]
#: Errors this close are equal: classes that predict the same by other formulas differ by rounding alone, in each engine by another.
TIE = "1e-6"
#: What the tree looks at.
FEATURES = [
    "timestep", "speed_deg1", "speed_deg2", "acc_mag", "jerk_mag", "speed_acc_ratio", "disp_mag_ratio", "bounce_angle", "bounce_angle_2_sum", "ortho_acc_mag",
    "plane_normal_dot", "acc_jerk_ratio", "circ_rad", "time_since_stationary", "time_since_dir_change", "dist_since_dir_change", "unit_rot_ax_diff",
]


def column(feature: str) -> str:
    """A feature's name in a training table: one that is also a class's gets an end, as names are told apart without their case."""
    return f"{feature}_value" if feature.upper() in CLASSES else feature


def class_errors() -> Layer:
    def size(parts: list[str]) -> str:
        return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"

    held = {m: size([f"{c} - {p.replace('@', c)}" for c in "xyz"]) for m, p in HELD.items()}
    curves = {m: size([f"{c} - coalesce({n}_{c}, {HELD['ACC_DEG2'].replace('@', c)})" for c in "xyz"]) for m, n in CURVES.items()}
    return held | {m: size([f"{n}_{c}" for c in "xyz"]) for m, n in CIRCLES.items()} | curves


def curved(rows: DataFrame) -> DataFrame:
    """``rows`` of ``features.base`` with joint_x .. split_z: where minimum-jerk curves through the poses before a row put it, null where there is none."""
    made = [f"{n}_{c}" for n in CURVES.values() for c in "xyz"]
    return segments.predictions(rows).selectExpr(*rows.columns, *(f"lag({c}) OVER {ORDER} AS {c}" for c in made))


def label() -> list[Layer]:
    """min_err, the number of the first class whose error is within ``TIE`` of it, and the label of the row before."""
    least = f"least({', '.join(CLASSES)})"
    first = "CASE " + " ".join(f"WHEN {m} <= min_err + {TIE} THEN {i}" for i, m in enumerate(CLASSES)) + " END"
    return [{"min_err": least}, {"label": first}, {"last_label": f"lag(label) OVER {ORDER}"}]


def best_vectors(poses: DataFrame, wide: bool = False) -> DataFrame:
    """(track_id, step, k, label, model, frame_kind, ex, ey, ez): the error of each frame's best class as a vector in the frames of ``localized``; k from 4.

    The frames' axes, all classes' predictions and the choice come from one pass over a track's window. Null where a row has no such frame.
    A wide table has ex0, ey0, ez0, ex1 .. for ``localized.FRAMES`` instead of model and frame_kind.
    """
    kept = ["track_id", "step", "k", "x", "y", "z", "qw", "qx", "qy", "qz", *(f"{n}_{c}" for n in CURVES.values() for c in "xyz")]
    frames = {f: a for f, a in localized.FRAMES.items() if a}
    axes = [f"{a}{c} AS {f}{i}_{c}" for f, of in frames.items() for i, a in enumerate(of) for c in "xyz"]
    rows = apply(curved(base(poses)), localized.layers()).selectExpr(*kept, *axes)
    rows = apply(rows, [*layers(), *error_layers(), class_errors(), *label()[:2]]).where("k >= 4")
    missed = {m: f"(@ - {p})" for m, p in HELD.items()} | {m: f"{n}_@" for m, n in CIRCLES.items()}
    missed |= {m: f"(@ - coalesce({n}_@, {HELD['ACC_DEG2']}))" for m, n in CURVES.items()}
    rows = apply(rows, [each("best_@", "CASE label " + " ".join(f"WHEN {i} THEN {missed[m]}" for i, m in enumerate(CLASSES)) + " END")])
    if wide:
        parts = [[f"best_{c}" for c in "xyz"], *([dot("best_@", f"{f}{i}_@") for i in range(3)] for f in frames)]
        return rows.selectExpr(*KEYS, "k", "label", *(f"{e} AS e{c}{i}" for i, of in enumerate(parts) for c, e in zip("xyz", of)))
    structs = ["named_struct('frame_kind', 'world', 'ex', best_x, 'ey', best_y, 'ez', best_z)"]
    structs += [f"named_struct('frame_kind', '{f}', " + ", ".join(f"'e{c}', {dot('best_@', f'{f}{i}_@')}" for i, c in enumerate("xyz")) + ")" for f in frames]
    return rows.selectExpr(*KEYS, "k", "label", "'best' AS model", f"inline(array({', '.join(structs)}))")


def training_table(poses: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(track_id, step, k, split, features, errors of ``CLASSES``, label, min_err, last_label); k from 4, all steps together.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). Features, errors and labels come from one pass over one window; tracks are split
    by ``evaluate.split_groups``, so no track is on two sides. A missing feature is null; where there is no minimum-jerk curve, its class takes the
    quadratic prediction, and so never the label.
    """
    names = features or list(SCALARS)
    rows = apply(curved(base(poses)), [*layers(), *error_layers()]).where("k >= 4")
    rows = rows.selectExpr(*KEYS, "k", *(f"{SCALARS[n]} AS {column(n)}" for n in names), *(f"{e} AS {m}" for m, e in class_errors().items()))
    split = evaluate.split_groups(poses.select("track_id").distinct(), "track_id")
    return apply(rows, label()).join(split, "track_id")


def missing(produced: DataFrame, declared: DataFrame, by: str = "name") -> DataFrame:
    """Names of ``declared`` that ``produced`` lacks."""
    return declared.join(F.broadcast(produced.select(by).distinct()), by, "left_anti")
