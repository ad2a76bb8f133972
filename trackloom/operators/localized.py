"""Errors of several predictors in several reference frames, and their statistics by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import Layer, apply, conjugate, cross, dot, each, lags, matrix, norm, unit
from ..sources.poses import described
from ..sources.store import saved
from .features import base
from .predict import KEYS

PREDICTORS = {"VEL_DEG1": "(2 * @1 - @2)", "VEL_DEG2": "(2.5e0 * @1 - 2 * @2 + 0.5e0 * @3)", "ACC_DEG2": "(3 * @1 - 3 * @2 + @3)", "JERK": "(4 * @1 - 6 * @2 + 4 * @3 - @4)"}
#: A frame's three axes: the world's, the object's own at its last pose, and two along velocities and the acceleration across them.
FRAMES = {"world": None, "object": ("ox", "oy", "oz"), "velocity": ("vh", "vw", "vb"), "velocity2": ("gh", "gw", "gb")}
MOMENTS = ["ex", "ey", "ez"]
PAIRS = [("ex", "ey"), ("ex", "ez"), ("ey", "ez")]


def layers() -> list[Layer]:
    """From (track_id, step, k, x, y, z, qw, qx, qy, qz) to the frames' axes."""
    return [
        lags(["x", "y", "z"], 4) | lags(["qw", "qx", "qy", "qz"], 1),
        each("v@", "(@1 - @2)") | each("a@", "(@1 - 2 * @2 + @3)") | matrix("r", "q@1"),
        each("g@", "(v@ + a@ / 2)") | {"nv": norm("v@")} | {f"o{a}{c}": f"r{i}{j}" for j, a in enumerate("xyz") for i, c in enumerate("xyz")},
        {"ng": norm("g@")} | unit("vh@", "v@", "nv"),
        unit("gh@", "g@", "ng") | {"av": dot("a@", "vh@")},
        each("vc@", "(a@ - vh@ * av)") | {"ag": dot("a@", "gh@")},
        each("gc@", "(a@ - gh@ * ag)") | {"nvc": norm("vc@")},
        {"ngc": norm("gc@")} | unit("vw@", "vc@", "nvc"),
        unit("gw@", "gc@", "ngc") | cross("vb@", "vh@", "vw@"),
        cross("gb@", "gh@", "gw@"),
    ]


def errors_in_frames(model: str) -> list[dict[str, str]]:
    """Of one model a row for each frame: its coordinates in the frame's axes."""
    err = f"(@ - {PREDICTORS[model]})"
    out = []
    for frame, axes in FRAMES.items():
        e = [err.replace("@", c) for c in "xyz"] if axes is None else [dot(err, f"{a}@") for a in axes]
        out.append({"model": f"'{model}'", "frame_kind": f"'{frame}'"} | dict(zip(MOMENTS, e)))
    return out


#: Models and frames by the numbers that a wide table's columns end in.
WIDE = [(m, f) for m in PREDICTORS for f in FRAMES]


def localized(poses: DataFrame, wide: bool = False) -> DataFrame:
    """(track_id, step, k, model, frame_kind, ex, ey, ez) of poses (track_id, frame, x, y, z, vx, vy, vz); k from 4. A wide table has ex0, ey0, ez0, ex1 ..
    for ``WIDE`` instead.

    Frames whose axes a row doesn't have, as it stands still or moves straight, give null coordinates.
    """
    rows = apply(base(poses), layers()).where("k >= 4")
    every = [r for m in PREDICTORS for r in errors_in_frames(m)]
    if wide:
        return rows.selectExpr(*KEYS, "k", *(f"{r[c]} AS {c}{i}" for i, r in enumerate(every) for c in MOMENTS))
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in r.items()) + ")" for r in every)
    return rows.selectExpr(*KEYS, "k", f"inline(array({structs}))")


def statistics(errors: DataFrame, wide: list[tuple[str, str]] | None = None) -> DataFrame:
    """By step, model, motion kind or all (null) and frame kind: n, means, deviations, covariances, their determinant, distances from
    the mean, the mean size and the 95 % interval of each mean. Null rows don't count; groups of one row have null deviations.

    A task sums a motion kind's rows where they pass, and hands on a row for each group; all kinds together come from these. The mean distance from the mean
    needs a second pass with the groups' means, a few hundred rows that are written; the mean square is the sum of the variances.
    ``wide`` names the models and frames of a wide table.
    """
    names = MOMENTS if wide is None else [f"{c}{i}" for i in range(len(wide)) for c in MOMENTS]
    kept = described(errors).select(*(GROUP if wide is None else ("step", "motion_kind")), *names)
    parts = kept.mapInArrow(_summed(_moments, wide), PARTS).withColumn("kind", F.explode(F.array("motion_kind", F.lit("all"))))
    stats = saved(parts.groupBy(*KEYS_OF).applyInPandas(_merged, STATS))
    means = {tuple(r[:4]): r[4:] for r in stats.select(*KEYS_OF, *(f"mean_{c}" for c in MOMENTS)).collect()}  # 12 groups for each motion kind and frame
    apart = kept.mapInArrow(_summed(_distances(means), wide), PARTS)
    apart = apart.select("step", "model", "frame_kind", F.inline(F.array(*(F.struct(k.alias("kind"), F.col("s")[i].alias("s")) for i, k in enumerate((F.col("motion_kind"), F.lit("all")))))))
    spread = apart.groupBy(*KEYS_OF).agg(F.sum("s").alias("s"))
    all_of = F.when(F.col("n") > 1, (F.col("n") - 1) / F.col("n") * (F.col("var_ex") + F.col("var_ey") + F.col("var_ez"))).otherwise(0.0)
    stats = stats.withColumn("mean_square_distance", all_of).join(F.broadcast(spread), KEYS_OF).withColumn("mean_distance", F.col("s") / F.col("n")).drop("s")
    return stats.selectExpr("*", f"{DET} AS det", *(f"{e} AS {n}" for n, e in INTERVALS.items()))


GROUP, KEYS_OF = ["step", "model", "frame_kind", "motion_kind"], ["step", "model", "kind", "frame_kind"]
PARTS = "step long, model string, frame_kind string, motion_kind string, s array<double>"
STATS = "step long, model string, kind string, frame_kind string, n long, " + ", ".join(
    f"{n} double" for n in (*(f"{f}_{c}" for f in ("mean", "std", "var") for c in MOMENTS), *(f"cov_{a}_{b}" for a, b in PAIRS), "mean_size")
)
#: Pairs of axes of a covariance's entries, as ``_moments`` has them.
ENTRIES = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def _summed(look, wide: list[tuple[str, str]] | None):
    """Arrow batches to a row for each group, when a task's rows are through; ``look`` adds a batch's errors to what it has of their groups."""

    def run(batches):
        at: dict[tuple, int] = {}
        state = None
        for b in batches:
            codes, names = np.zeros(b.num_rows, np.int64), []
            for c in GROUP if wide is None else ("step", "motion_kind"):
                coded = b[c].dictionary_encode()
                names.append(coded.dictionary.to_pylist())
                codes = codes * len(names[-1]) + coded.indices.to_numpy()
            n = len(wide or [0])
            codes = (np.arange(n)[:, None] * math.prod(map(len, names)) + codes).ravel()
            columns = [[b[f"{c}{i}" if wide else c] for i in range(n)] for c in MOMENTS]
            there = ~np.any([np.concatenate([v.is_null().to_numpy(zero_copy_only=False) for v in of]) for of in columns], axis=0)
            if not there.any():
                continue
            e = np.stack([np.concatenate([v.to_numpy(zero_copy_only=False) for v in of])[there] for of in columns])
            codes = codes[there]
            some = np.flatnonzero(np.bincount(codes))
            number = np.zeros(some[-1] + 1, np.int64)
            for code, (i, *place) in zip(some, zip(*np.unravel_index(some, [n, *map(len, names)]), strict=True), strict=True):
                key = [of[j] for of, j in zip(names, place, strict=True)]
                key = tuple(key if wide is None else [key[0], *wide[i], key[1]])
                number[code] = at.setdefault(key, len(at))
            state = look(list(at), number[codes], e, state)
        if at:
            columns = [pa.array(c, t) for c, t in zip(zip(*at, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(state.T.tolist(), pa.list_(pa.float64()))], names=[*GROUP, "s"])

    return run


def _moments(keys, which, e, state):
    """By group: n, means, sums of products about the means, summed sizes."""
    sums = lambda v: np.bincount(which, v, len(keys))
    n = np.bincount(which, minlength=len(keys)).astype(float)
    mean = np.stack([sums(c) for c in e]) / np.maximum(n, 1)
    off = e - mean[:, which]
    new = np.stack([n, *mean, *(sums(off[i] * off[j]) for i, j in ENTRIES), sums(np.sqrt((e * e).sum(axis=0)))])
    if state is None:
        return new
    old = np.zeros((len(new), len(keys)))
    old[:, : state.shape[1]] = state
    return _together(np.stack([old, new]))


def _together(parts: np.ndarray) -> np.ndarray:
    """Moments of parts (parts, moments, groups) as those of all their rows."""
    n = parts[:, 0]
    whole = n.sum(axis=0)
    mean = (n[:, None] * parts[:, 1:4]).sum(axis=0) / np.maximum(whole, 1)
    off = parts[:, 1:4] - mean
    products = [(parts[:, 4 + k] + n * off[:, i] * off[:, j]).sum(axis=0) for k, (i, j) in enumerate(ENTRIES)]
    return np.stack([whole, *mean, *products, parts[:, 10].sum(axis=0)])


def _merged(key, parts):
    n, *of = _together(np.array(parts["s"].to_list())[:, :, None])[:, 0].tolist()
    var = [v / (n - 1) if n > 1 else None for v in of[3:9]]
    std = [v and v**0.5 if v is not None else None for v in var[:3]]
    names = [f.split()[0] for f in STATS.split(", ")]
    return pd.DataFrame([[*key, int(n), *of[:3], *std, *var, of[9] / n]], columns=names)


def _distances(means: dict[tuple, tuple]):
    """Adds up by group the distances from the mean of its motion kind and from that of all."""

    def look(keys, which, e, state):
        out = np.zeros((2, len(keys)))
        if state is not None:
            out[:, : state.shape[1]] = state
        for i, kind in enumerate((None, "all")):
            mean = np.array([means[step, model, kind or own, frame] for step, model, frame, own in keys]).T
            out[i] += np.bincount(which, np.sqrt(((e - mean[:, which]) ** 2).sum(axis=0)), len(keys))
        return out

    return look


DET = (
    "var_ex * (var_ey * var_ez - cov_ey_ez * cov_ey_ez) - cov_ex_ey * (cov_ex_ey * var_ez - cov_ey_ez * cov_ex_ez)"
    " + cov_ex_ez * (cov_ex_ey * cov_ey_ez - var_ey * cov_ex_ez)"
)
#: Student's quantile by its series in the normal one, z.
_z = 1.959963984540054
_terms = [(_z**3 + _z) / 4, (5 * _z**5 + 16 * _z**3 + 3 * _z) / 96, (3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384]
QUANTILE = f"({_z} + " + " + ".join(f"{t!r} / nullif(pow(n - 1, {i}), 0)" for i, t in enumerate(_terms, 1)) + ")"
INTERVALS = {f"{side}_{c}": f"mean_{c} {sign} {QUANTILE} * std_{c} / sqrt(n)" for c in MOMENTS for side, sign in (("low", "-"), ("high", "+"))}


#: Eigenvalues and unit eigenvectors of a symmetric matrix (xx, xy, xz, yy, yz, zz) of a column each. The values are the roots of its characteristic cubic by
#: the cosine of a third of an angle; a vector is across the two rows of the matrix less the value that are furthest from parallel.
_rows = {"x": ("xx", "xy", "xz"), "y": ("xy", "yy", "yz"), "z": ("xz", "yz", "zz")}
_crosses = [("x", "y"), ("y", "z"), ("z", "x")]


def _of_value(i: int) -> list[Layer]:
    less = {f"l{i}{r}{c}": f"{m} - value{i}" if r == c else m for r, row in _rows.items() for c, m in zip("xyz", row)}
    pairs: Layer = {}
    for p, q in _crosses:
        pairs |= cross(f"v{i}{p}@", f"l{i}{p}@", f"l{i}{q}@")
    size = {f"s{i}{p}": dot(f"v{i}{p}@", f"v{i}{p}@") for p, _ in _crosses}
    pick = lambda c: f"CASE WHEN s{i}x >= s{i}y AND s{i}x >= s{i}z THEN v{i}x{c} / nullif(sqrt(s{i}x), 0) WHEN s{i}y >= s{i}z THEN v{i}y{c} / nullif(sqrt(s{i}y), 0) ELSE v{i}z{c} / nullif(sqrt(s{i}z), 0) END"
    chosen = {f"w{i}{c}": pick(c) for c in "xyz"}
    largest = f"CASE WHEN abs(w{i}x) >= abs(w{i}y) AND abs(w{i}x) >= abs(w{i}z) THEN w{i}x WHEN abs(w{i}y) >= abs(w{i}z) THEN w{i}y ELSE w{i}z END"
    return [less, pairs, size, chosen, {f"sign{i}": f"CASE WHEN {largest} < 0 THEN -1 ELSE 1 END"}, each(f"axis{i}@", f"sign{i} * w{i}@")]


EIGEN: list[Layer] = [
    {"mid": "(xx + yy + zz) / 3"},
    {"dx": "xx - mid", "dy": "yy - mid", "dz": "zz - mid"},
    {"spread": "sqrt((dx * dx + dy * dy + dz * dz + 2 * (xy * xy + xz * xz + yz * yz)) / 6)"},
    {"cosine": "(dx * (dy * dz - yz * yz) - xy * (xy * dz - yz * xz) + xz * (xy * yz - dy * xz)) / nullif(2 * spread * spread * spread, 0)"},
    {"third": "acos(greatest(-1e0, least(1e0, cosine))) / 3"},
    {"value0": "mid + 2 * spread * cos(third)", "value2": "mid + 2 * spread * cos(third + 2 * pi() / 3)"},
    {"value1": "3 * mid - value0 - value2"},
    *({k: v for layer in step for k, v in layer.items()} for step in zip(*(_of_value(i) for i in range(3)))),
]


def principal_axes(stats: DataFrame) -> DataFrame:
    """(step, model, kind, frame_kind, i, eigenvalue, ux, uy, uz): the covariances' eigenvalues, largest first, and unit eigenvectors whose largest entry is positive.

    Groups without covariances have none; neither have those of a matrix that is the same in all directions. Of two equal eigenvalues the vectors are null.
    """
    keys = ["step", "model", "kind", "frame_kind"]
    names = {"xx": "var_ex", "yy": "var_ey", "zz": "var_ez", "xy": "cov_ex_ey", "xz": "cov_ex_ez", "yz": "cov_ey_ez"}
    rows = apply(stats.selectExpr(*keys, *(f"{v} AS {k}" for k, v in names.items())), EIGEN).where("cosine IS NOT NULL")
    each_ = ", ".join(f"named_struct('i', {i}, 'eigenvalue', value{i}, 'ux', axis{i}x, 'uy', axis{i}y, 'uz', axis{i}z)" for i in range(3))
    return rows.selectExpr(*keys, f"inline(array({each_}))")


#: Kullback-Leibler divergence of one Gaussian (a_) from another (b_), both of three dimensions.
def divergence(a: str, b: str) -> str:
    n = {f"{p}_{q}": f"{b}cov_{p}_{q}" for p, q in PAIRS} | {f"{c}_{c}": f"{b}var_{c}" for c in MOMENTS}
    m = {k: v.replace(b, a, 1) for k, v in n.items()}
    xx, xy, xz, yy, yz, zz = (n[k] for k in ("ex_ex", "ex_ey", "ex_ez", "ey_ey", "ey_ez", "ez_ez"))
    minor = {"ex_ex": f"({yy} * {zz} - {yz} * {yz})", "ex_ey": f"({xz} * {yz} - {xy} * {zz})", "ex_ez": f"({xy} * {yz} - {xz} * {yy})",
             "ey_ey": f"({xx} * {zz} - {xz} * {xz})", "ey_ez": f"({xy} * {xz} - {xx} * {yz})", "ez_ez": f"({xx} * {yy} - {xy} * {xy})"}
    trace = " + ".join(f"{1 if k[:2] == k[3:] else 2} * {minor[k]} * {m[k]}" for k in minor)
    shift = " + ".join(f"{1 if k[:2] == k[3:] else 2} * {minor[k]} * ({b}mean_{k[:2]} - {a}mean_{k[:2]}) * ({b}mean_{k[3:]} - {a}mean_{k[3:]})" for k in minor)
    return f"(({trace}) / nullif({b}det, 0) - 3 + ({shift}) / nullif({b}det, 0) + ln(CASE WHEN {b}det > 0 AND {a}det > 0 THEN {b}det / {a}det END)) / 2"
