"""Banks of configurations: errors of all of them for each row, as a matrix, without a row for each.

``track_means`` sums a track's errors where its rows pass, and then means over tracks: a task gives a row for each configuration, however many rows
and tracks it has. ``medians`` finds the exact median of all rows' errors for each configuration by narrowing down: the errors are computed anew for each
pass and only counted, by a task in one table for all its rows, so rows times configurations are never written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.polynomial import Chebyshev, Polynomial
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layers import Layer, apply, conjugate, dot, lags, norm, quat, times
from ..sources.store import saved
from . import filters
from .features import base
from .orientation import unwrap_layers
from .predict import KEYS, down_sampled, order

#: Errors that a task looks at together, cells of a pass of ``medians``, and values of a configuration that it gathers in the end.
MATRIX, CELLS, FEW = 1 << 20, 256, 2048
Errors = Callable[[pd.DataFrame], np.ndarray]
#: Errors of a block of rows by filters, which stay in a core's cache.
BLOCK = 1 << 15
SUMS = "step long, configuration int, tracks long, s double"


def track_means(rows: DataFrame, errors: Errors, n: int) -> DataFrame:
    """(step, configuration, tracks, mean_err): the mean over tracks of a track's mean error, for ``n`` configurations.

    A track's rows must follow each other within one partition, as a window over tracks leaves them; ``errors`` gives a column for each configuration.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        tracks: dict[int, int] = {}
        key, total, count = None, np.zeros(n), 0

        def ended():
            if count:
                sums[key[1]] = sums.get(key[1], 0) + total / count
                tracks[key[1]] = tracks.get(key[1], 0) + 1

        for batch in batches:
            for at in range(0, len(batch), max(1, MATRIX // n)):
                b = batch.iloc[at : at + max(1, MATRIX // n)]
                track, step, found = b["track_id"].to_numpy(), b["step"].to_numpy(), errors(b)
                starts = np.flatnonzero(np.append(True, (np.diff(track) != 0) | (np.diff(step) != 0)))
                parts = np.add.reduceat(found, starts, axis=0)
                for i, first in enumerate(starts):
                    if key != (track[first], step[first]):
                        ended()
                        key, total, count = (track[first], step[first]), np.zeros(n), 0
                    total = total + parts[i]
                    count += (starts[i + 1] if i + 1 < len(starts) else len(b)) - first
        ended()
        for s, of in sums.items():
            yield pd.DataFrame({"step": s, "configuration": np.arange(n, dtype=np.int32), "tracks": tracks[s], "s": of})

    total = rows.mapInPandas(run, SUMS).groupBy("step", "configuration").agg(F.sum("tracks").alias("tracks"), F.sum("s").alias("s"))
    return total.select("step", "configuration", "tracks", (F.col("s") / F.col("tracks")).alias("mean_err"))


def medians(rows: DataFrame, errors: Errors, n: int, cells: int = CELLS, read: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> DataFrame:
    """(step, configuration, n, median): exact medians of all rows' errors, for ``n`` configurations. Errors must be numbers.

    ``errors`` may give anything that grows with the error, which ``read`` makes of it. Each pass counts the values below a configuration's range, and those within by
    even cells; the range becomes the cell of the middle, with half a cell to both sides, until it holds few values. Then these are gathered. A task gives its
    counts once, when its rows are through.
    """
    spark, kept = rows.sparkSession, saved(rows)

    together = max(1, MATRIX // 4 // n)

    def passed(look, ended, schema: str) -> DataFrame:
        def run(batches):
            sums: dict[int, object] = {}
            for batch in batches:
                for s, b in batch.groupby("step"):
                    for at in range(0, len(b), together):
                        sums[s] = look(s, errors(b.iloc[at : at + together]), sums.get(s))
            for s, of in sums.items():
                if of is not None:
                    yield ended(s, of).assign(step=s)

        return kept.mapInPandas(run, schema)

    def extremes(step, found, of):
        of = of or (0, np.inf, -np.inf)
        return of[0] + len(found), np.minimum(of[1], found.min(axis=0)), np.maximum(of[2], found.max(axis=0))

    def of_extremes(step, of):
        return pd.DataFrame({"configuration": np.arange(n, dtype=np.int32), "n": of[0], "low": of[1], "high": of[2]})

    whole = passed(extremes, of_extremes, "configuration int, n long, low double, high double, step long")
    state = whole.groupBy("step", "configuration").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # a row a step and configuration
    state["rank"], state["inside"] = (state["n"] - 1) // 2, state["n"]
    ready, configurations = [], len(state)
    while True:
        few = (state.inside <= FEW) | (state.high - state.low <= 4096 * np.spacing(np.maximum(state.low.abs(), state.high.abs())))
        if state.inside.sum() <= 4 * FEW * configurations:  # equal values, which are gathered as one
            few |= True
        ready.append(state[few])
        state = state[~few]
        if not len(state):
            break
        held = _held(state, cells)

        def count(step, found, of, held=held):
            if step not in held:
                return None
            which, low, unit, _ = held[step]
            at = (found if len(which) == n else found[:, which]) - low
            at *= unit
            at += 1
            np.clip(at, 0, cells + 1, out=at)
            at += np.arange(len(which)) * (cells + 2)  # the first cell is for all below, the last one for all above
            return (0 if of is None else of) + np.bincount(at.astype(np.int64).ravel(), minlength=len(which) * (cells + 2))

        def of_count(step, of, held=held):
            return pd.DataFrame({"configuration": held[step][0], "counts": list(of.reshape(-1, cells + 2))})

        ranks = {(s, c): r for s, c, r in zip(state["step"].tolist(), state["configuration"].tolist(), state["rank"].tolist(), strict=True)}
        counts = passed(count, of_count, "configuration int, counts array<long>, step long")
        found = counts.groupBy("step", "configuration").applyInPandas(_middle(ranks), "step long, configuration int, cell int, inside long").toPandas()
        state = state.drop(columns="inside").merge(found, on=["step", "configuration"])
        if not state.cell.between(1, cells).all():
            raise ValueError("errors that are not numbers, or not the same in each pass")
        width, low = (state.high - state.low) / cells, state.low.to_numpy(copy=True)
        state["low"] = np.maximum(low, low + (state.cell - 1.5) * width)
        state["high"] = np.minimum(state.high, low + (state.cell + 0.5) * width)
        state = state.drop(columns="cell")
    state = pd.concat(ready)
    held = _held(state, cells)

    def counted(values):
        return pd.concat(values).groupby(["configuration", "v"], as_index=False).sum()

    def gather(step, found, of):
        _, low, _, high = held[step]
        below, values, above = of or (0, [], np.inf)
        within = (found >= low) & (found <= high)
        row, column = np.nonzero(within)
        values = [*values, pd.DataFrame({"configuration": column.astype(np.int32), "v": found[row, column], "n": 1})]
        if len(values) > 64:
            values = [counted(values)]
        return below + (found < low).sum(axis=0), values, np.minimum(above, np.where(found > high, found, np.inf).min(axis=0))

    def of_gather(step, of):
        below, values, above = of
        every = np.arange(n, dtype=np.int32)
        parts = [counted(values), pd.DataFrame({"configuration": every, "v": -np.inf, "n": below}), pd.DataFrame({"configuration": every, "v": above, "n": 1})]
        return pd.concat([parts[0], *(p[p.n > 0] for p in parts[1:])])

    # All below count as one value, and of all above only the least is wanted.
    values = passed(gather, of_gather, "configuration int, v double, n long, step long").groupBy("step", "configuration", "v").agg(F.sum("n").alias("m"))
    values = values.withColumn("upto", F.sum("m").over(Window.partitionBy("step", "configuration").orderBy("v")))  # few values
    sizes = spark.createDataFrame(state[["step", "configuration", "n"]], "step long, configuration int, n long")
    values = values.join(F.broadcast(sizes), ["step", "configuration"])
    at = lambda rank: F.max(F.expr(f"CASE WHEN {rank} < upto AND {rank} >= upto - m THEN v END"))
    two = values.groupBy("step", "configuration", "n").agg(at("(n - 1) div 2").alias("first"), at("n div 2").alias("second")).toPandas()
    if np.isinf(two[["first", "second"]].to_numpy(float)).any() or two[["first", "second"]].isna().any(axis=None):
        raise ValueError("errors that are not numbers, or not the same in each pass")
    # Of an even number of rows, the mean of the two in the middle.
    two["median"] = (read(two["first"].to_numpy(float)) + read(two["second"].to_numpy(float))) / 2
    return spark.createDataFrame(two[["step", "configuration", "n", "median"]], "step long, configuration int, n long, median double")


def _middle(ranks: dict[tuple[int, int], int]):
    """Of a configuration's counts, an array from each task, the cell that holds the rank, and what it holds with its neighbours."""

    def middle(key, counts):
        of = np.sum(np.stack(counts["counts"].to_list()), axis=0)
        cell = int(np.searchsorted(np.cumsum(of), ranks[key], side="right"))
        return pd.DataFrame({"step": [key[0]], "configuration": [key[1]], "cell": [cell], "inside": [int(of[max(0, cell - 1) : cell + 2].sum())]})

    return middle


def _held(state: pd.DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By step the configurations, the low ends of their ranges, cells to a unit, and the high ends."""
    held = {}
    for step, g in state.groupby("step"):
        g = g.sort_values("configuration")
        low, high = g.low.to_numpy(float), g.high.to_numpy(float)
        held[int(step)] = g.configuration.to_numpy(np.int32), low, cells / np.where(high > low, high - low, 1.0), high
    return held


#: From a track's quaternions: the last turn's angle, and the scalar part of this turn and its vector part along the last one's axis.
TURNS: list[Layer] = [
    lags(["qw", "qx", "qy", "qz"], 2),
    times("now@", quat("q@"), conjugate(quat("q@1"))) | times("was@", quat("q@1"), conjugate(quat("q@2"))),
    {"size": norm("was@"), "along": dot("was@", "now@")},
    {"last": "CASE WHEN wasw < 0 THEN 2 * atan2(size, -wasw) ELSE 2 * atan2(size, wasw) END", "part": "coalesce(CASE WHEN wasw < 0 THEN -along ELSE along END / nullif(size, 0), 0e0)",
     "turn": f"2 * atan2({norm('now@')}, abs(noww))"},
]


def turns(poses: DataFrame) -> DataFrame:
    """(track_id, step, k, last, noww, part, turn), k from 1, the rows of a track one after another; at k = 1 there is no last turn."""
    return apply(base(poses), TURNS).where("k >= 1").select(*KEYS, "k", "last", "noww", "part", "turn")


def turn_errors(angles: Callable[[np.ndarray], np.ndarray]) -> Errors:
    """Angles between the orientation and the one that the last turn's axis and ``angles`` of its angle give; a track's first turn is all error."""

    def cosines(half: np.ndarray, phase: np.ndarray) -> np.ndarray:
        return np.cos(angles(2 * half) / 2 - phase)

    return lambda b: of_cosines(turn_cosines(cosines)(b))


def turn_cosines(cosines: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Errors:
    """What grows with these errors, see ``of_cosines``. The angles' halves meet a phase; ``cosines`` gives theirs from halves and phases of the rows, a column for each configuration."""

    def falling(b: pd.DataFrame) -> np.ndarray:
        now, part = b["noww"].to_numpy()[:, None], b["part"].to_numpy()[:, None]
        found = cosines(b["last"].fillna(0).to_numpy()[:, None] / 2, np.arctan2(part, now))
        found *= np.hypot(part, now)
        np.abs(found, out=found)
        np.minimum(found, 1, out=found)
        first = b["k"].to_numpy() == 1
        if first.any():
            found[first] = np.cos(b["turn"].to_numpy()[first, None] / 2)
        return np.negative(found, out=found)

    return falling


def of_cosines(falling: np.ndarray) -> np.ndarray:
    return 2 * np.arccos(-falling)


def saturated(scale: np.ndarray, power: np.ndarray) -> Errors:
    """x / (1 + |x / scale|^power)^(1 / power) for each pair, by logarithms, as x is not negative."""

    def angles(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            out = power * np.log(x) - power * np.log(scale)
        # Of a large power of x / scale the one added doesn't count.
        large = out > 600
        np.exp(np.minimum(out, 600, out=out), out=out) if large.any() else np.exp(out, out=out)
        out += 1
        np.log(out, out=out)
        out /= -power
        np.exp(out, out=out)
        out *= x
        return np.where(large, np.broadcast_to(scale, out.shape), out) if large.any() else out

    return turn_errors(angles)


def linear(scale: np.ndarray) -> Errors:
    return turn_errors(lambda x: scale * x)


def linear_cosines(scale: np.ndarray) -> Errors:
    """What grows with the errors of ``linear``. The cosines of evenly spaced scales come from those of every so manieth one, by the sum of two angles."""
    n, few = len(scale), max(1, round(len(scale) ** 0.5))
    if n < 3 or not np.allclose(scale, np.linspace(scale[0], scale[-1], n), rtol=0, atol=1e-14):
        return turn_cosines(lambda half, phase: np.cos(scale * half - phase))
    coarse, fine = scale[::few], np.linspace(scale[0], scale[-1], n)[:few] - scale[0]

    def cosines(half: np.ndarray, phase: np.ndarray) -> np.ndarray:
        at, more = coarse * half - phase, fine * half
        out = np.cos(at)[:, :, None] * np.cos(more)[:, None, :]
        out -= np.sin(at)[:, :, None] * np.sin(more)[:, None, :]
        return np.ascontiguousarray(out.reshape(len(half), -1)[:, :n])

    return turn_cosines(cosines)


def arctangent(scale: np.ndarray) -> Errors:
    """scale * atan2(2 sin(x / scale), 2 cos(x / scale) - 1) - x: what the nearest rotation to an extrapolated matrix turns by, where scale is 1."""
    return turn_errors(lambda x: scale * np.arctan2(2 * np.sin(x / scale), 2 * np.cos(x / scale) - 1) - x)


def _weights(bank: list[dict[int, list[float]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By poses at hand, the oldest first, a column for each filter; equal columns are one, and the second array has each filter's."""
    most, out = max(max(f) for f in bank), {}
    for size in range(most + 1):
        weights = np.zeros((size, len(bank)))
        for j, of in enumerate(bank):
            w = of[min(size, max(of))] if size else []
            weights[size - len(w) :, j] = w
        columns, which = np.unique(weights, axis=1, return_inverse=True) if size else (weights[:, :1], np.zeros(len(bank), int))
        out[size] = columns, which.reshape(-1)
    return out


def _slid(batches, axes: tuple[str, ...], most: int):
    """Of Arrow batches of rows (track_id, step, k, rows, ``axes``, ..), the rows with k from 1: (step, size, columns of these rows by name, past), where past (axes,
    rows, size) has what the axes were before each row, the oldest first, at most ``most`` rows back.

    A track's rows must follow each other within one partition. What is kept of a batch for the next one are its last ``most`` rows.
    """
    kept = None
    for batch in batches:
        new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if not len(new["k"]):
            continue
        old = len(kept["k"]) if kept else 0
        rows = {n: np.concatenate([kept[n], v]) for n, v in new.items()} if kept else new
        begins = np.append(True, (np.diff(rows["track_id"]) != 0) | (np.diff(rows["step"]) != 0))
        at = np.arange(len(begins))
        sizes = np.minimum(at - np.maximum.accumulate(np.where(begins, at, 0)), most)
        values = np.stack([rows[c].astype(float) for c in axes])
        wanted = (at >= old) & (rows["k"] > 0)
        # Rows of one step and size together, in their order.
        group = rows["step"] * (most + 1) + sizes
        for of in np.unique(group[wanted]):
            which = np.flatnonzero(wanted & (group == of))
            size = int(sizes[which[0]])
            past = values[:, which[:, None] + np.arange(-size, 0)]
            yield int(rows["step"][which[0]]), size, {n: v[which] for n, v in rows.items()}, past
        kept = {n: v[-most:] for n, v in rows.items()}


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of a track's rows that count, those with k from 1; the rows of a track one after another."""
    whole = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("rows", F.count(F.when(F.col("k") > 0, 1)).over(whole))


def _filtered(rows: DataFrame, axes: tuple[str, ...], bank: list[dict[int, list[float]]], measured: Callable, start: list[float], ended: Callable, schema: str) -> DataFrame:
    """``rows`` measured against what each filter makes of the rows before: a task hands on a row for each step and filter, however many rows it has.

    ``measured(columns, past, weights, of)`` changes of (``start``, filters) for a block of rows; filters that are the same for the poses at hand are measured once. ``ended``
    puts two such arrays of all filters together.
    """
    weights = _weights(bank)
    most = max(weights)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for step, size, columns, past in _slid(batches, axes, most):
            n = weights[size][0].shape[1]
            of = sums.setdefault((step, size), np.repeat(np.array(start, float)[:, None], n, axis=1))
            block = max(1, BLOCK // n)
            for at in range(0, past.shape[1], block):
                measured({c: v[at : at + block] for c, v in columns.items()}, past[:, at : at + block], weights[size][0], of)
        whole: dict[int, np.ndarray] = {}
        for (step, size), of in sums.items():
            every = of[:, weights[size][1]]
            whole[step] = ended(whole[step], every) if step in whole else every
        for step, of in whole.items():
            n = len(bank)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, step)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(v) for v in of)], names=["step", "configuration", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, f"step long, configuration int, {schema}").groupBy("step", "configuration")


def _made(past: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(axes, rows, filters): what each filter makes of the axes before each row."""
    axes, rows, size = past.shape
    return (past.reshape(axes * rows, size) @ weights).reshape(axes, rows, -1)


def _squares(columns: dict[str, np.ndarray], made: np.ndarray) -> np.ndarray:
    """Squared distances (rows, filters) of the positions from those that filters made; ``made`` is used up."""
    for of, c in zip(made, "xyz", strict=False):
        of -= columns[c][:, None]
        of *= of
    made[0] += made[1]
    made[0] += made[2]
    return made[0]


def _positions(poses: DataFrame) -> DataFrame:
    return _counted(down_sampled(poses).select(*KEYS, "k", "x", "y", "z"))


def filter_means(poses: DataFrame, bank: list[dict[int, list[float]]]) -> DataFrame:
    """As ``track_means``, of the distances of positions from what a bank of filters makes of those before them."""

    def measured(columns, past, weights, of):
        share = 1 / columns["rows"]
        of[0] += share.sum()
        of[1] += share @ np.sqrt(_squares(columns, _made(past, weights)))

    sums = _filtered(_positions(poses), ("x", "y", "z"), bank, measured, [0, 0], np.add, "tracks double, s double")
    return sums.agg(F.round(F.sum("tracks")).cast("long").alias("tracks"), F.sum("s").alias("s")).select("step", "configuration", "tracks", (F.col("s") / F.col("tracks")).alias("mean_err"))


def row_means(rows: DataFrame, errors: Errors, n: int) -> DataFrame:
    """(step, configuration, n, mean_err, most) of ``n`` configurations over all rows that have numbers."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), max(1, MATRIX // n)):
                b = batch.iloc[at : at + max(1, MATRIX // n)]
                found = errors(b)
                there = ~np.isnan(found).any(axis=1)
                found, step = found[there], b["step"].to_numpy()[there]
                for s in np.unique(step):
                    of = found[step == s]
                    yield pd.DataFrame({"step": s, "configuration": np.arange(n, dtype=np.int32), "n": len(of), "s": of.sum(axis=0), "most": of.max(axis=0)})

    rows = rows.mapInPandas(run, "step long, configuration int, n long, s double, most double")
    return rows.groupBy("step", "configuration").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_err"), F.max("most").alias("most"))


def filter_summary(poses: DataFrame, bank: list[dict[int, list[float]]]) -> DataFrame:
    """As ``row_means``, of the distances of positions from what a bank of filters makes of those before them."""

    def measured(columns, past, weights, of):
        off = np.sqrt(_squares(columns, _made(past, weights)))
        off = off[~np.isnan(off).any(axis=1)]
        if len(off):
            of[0] += len(off)
            of[1] += off.sum(axis=0)
            np.maximum(of[2], off.max(axis=0), out=of[2])

    def ended(a, b):
        return np.stack([a[0] + b[0], a[1] + b[1], np.maximum(a[2], b[2])])

    sums = _filtered(_positions(poses), ("x", "y", "z"), bank, measured, [0, 0, -np.inf], ended, "n double, s double, most double").agg(
        F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")
    )
    return sums.where("n > 0").select("step", "configuration", "n", (F.col("s") / F.col("n")).alias("mean_err"), "most")


def multiplied(v: np.ndarray, a: np.ndarray, j: np.ndarray) -> Errors:
    """Distances of the next displacement from multiples of velocity, acceleration and jerk, for rows of ``shape.local_motion``."""

    def errors(b: pd.DataFrame) -> np.ndarray:
        of = {c: b[c].to_numpy()[:, None] for c in b.columns if c != "step"}
        x = v * of["speed"] + a * of["acc_along"] + j * of["jerk0"] - of["next0"]
        y = a * of["acc_across"] + j * of["jerk1"] - of["next1"]
        z = j * of["jerk2"] - of["next2"]
        return np.sqrt(x * x + y * y + z * z)

    return errors


#: What a sweep measures of a track: shares of distances under 20 and 50, the mean distance, shares of angles under two and five degrees, the mean angle.
METRICS = ("under_20", "under_50", "mean_err", "under_2", "under_5", "mean_angle")


def _turned_positions(poses: DataFrame) -> DataFrame:
    """Positions and continuous rotation vectors rx, ry, rz, with the orientation qw .. qz, see ``_counted``."""
    return _counted(apply(base(poses), unwrap_layers("q@")).select(*KEYS, "k", "x", "y", "z", "qw", "qx", "qy", "qz", "rx", "ry", "rz"))


def _series(f: Callable, degree: int, low: float, high: float) -> list[float]:
    """Coefficients, the highest first, of the polynomial that meets a function at the Chebyshev points of a range."""
    return Chebyshev.interpolate(f, degree, [low, high]).convert(kind=Polynomial, domain=[low, high], window=[low, high]).coef[::-1].tolist()


#: sin(t) / t of t^2 up to a quarter of a half turn, and arccos(1 - y) / sqrt(2 y) of y up to that of a quarter turn, within 2e-15. NumPy's own functions take each number by itself.
SINE = _series(lambda t: np.sinc(np.sqrt(t) / np.pi), 6, 0, (np.pi / 4) ** 2)
ARC = _series(lambda y: 2 * np.arcsin(np.sqrt(y / 2)) / np.sqrt(2 * y), 9, 0, 1 - np.sqrt(0.5))


def _of(series: list[float], x: np.ndarray) -> np.ndarray:
    out = x * series[0]
    for c in series[1:-1]:
        out += c
        out *= x
    out += series[-1]
    return out


def _cosines(columns: dict[str, np.ndarray], made: np.ndarray) -> np.ndarray:
    """Cosines (rows, filters), without their signs, of half the angles between the orientations and the turns of rotation vectors (axes, rows, filters); ``made`` is used up."""
    along, other = made[0] * columns["qx"][:, None], made[1] * columns["qy"][:, None]
    along += other
    along += np.multiply(made[2], columns["qz"][:, None], out=other)
    made *= made
    length, part, cosine = made
    length += part
    length += cosine
    np.sqrt(length, out=length)
    # Half the half angle, less quarter turns by which the whole changes its sign only.
    np.multiply(length, 1 / (2 * np.pi), out=part)
    np.rint(part, out=part)
    part *= -np.pi / 2
    part += np.multiply(length, 0.25, out=other)
    sine = _of(SINE, np.multiply(part, part, out=other))
    sine *= part
    np.multiply(sine, sine, out=part)
    np.multiply(part, -2, out=cosine)
    cosine += 1
    cosine *= columns["qw"][:, None]
    np.subtract(1, part, out=part)
    np.sqrt(part, out=part)
    sine *= part
    along *= sine
    along *= 2
    along /= np.maximum(length, 1e-300, out=length)
    cosine += along
    return np.abs(cosine, out=cosine)


def _angles(cosines: np.ndarray) -> np.ndarray:
    """Angles from cosines of their halves, from 0; ``cosines`` is used up."""
    np.minimum(cosines, 1, out=cosines)
    cosines += 1
    cosines *= 0.5
    np.sqrt(cosines, out=cosines)
    np.subtract(1, cosines, out=cosines)
    out = _of(ARC, cosines)
    cosines *= 32
    out *= np.sqrt(cosines, out=cosines)
    return out


def _metrics(columns: dict[str, np.ndarray], past: np.ndarray, weights: np.ndarray, of: np.ndarray) -> None:
    """Adds the sums of a block of rows, each by its share of its track: of one, and of each of ``METRICS``."""
    share = 1 / columns["rows"]
    square, cosines = _squares(columns, _made(past[:3], weights)), _cosines(columns, _made(past[3:], weights))
    of[0] += share.sum()
    of[1] += share @ (square < 400)
    of[2] += share @ (square < 2500)
    of[3] += share @ np.sqrt(square, out=square)
    of[4] += share @ (cosines > np.cos(np.radians(1)))
    of[5] += share @ (cosines > np.cos(np.radians(2.5)))
    of[6] += share @ _angles(cosines)


def spline_sweep(poses: DataFrame, configurations: list[tuple[int, int, int]] | None = None, modes: tuple[str, ...] = filters.MODES) -> DataFrame:
    """(step, mode, degree, controls, inputs, tracks, ``METRICS``): every configuration's metrics by track, then their means over tracks.

    Poses are (track_id, frame, x, y, z, vx, vy, vz). Rows never meet configurations one by one: a block is multiplied with all weights.
    """
    columns = [(m, *c) for m in modes for c in configurations or filters.grid()]
    bank = [filters.spline_filters(*c, m) for m, *c in columns]
    sums = _filtered(_turned_positions(poses), ("x", "y", "z", "rx", "ry", "rz"), bank, _metrics, [0] * (1 + len(METRICS)), np.add, ", ".join(f"{m} double" for m in ("tracks", *METRICS)))
    found = sums.agg(F.sum("tracks").alias("tracks"), *(F.sum(m).alias(m) for m in METRICS)).withColumn("tracks", F.round("tracks").cast("long"))
    named = poses.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(columns)], "configuration int, mode string, degree int, controls int, inputs int")
    found = found.join(F.broadcast(named), "configuration")
    return found.select("step", "mode", "degree", "controls", "inputs", "tracks", *((F.col(m) / F.col("tracks")).alias(m) for m in METRICS))
