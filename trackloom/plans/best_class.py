"""Errors of each frame's best class in four reference frames, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as le
from ..operators import localized as lo
from .features import significant
from .learning import LABELLED
from .motion import _turned
from .sql import TRACKS

STATS = ["mean_ex", "mean_ey", "mean_ez", "std_ex", "std_ez", "cov_ex_ey", "mean_size", "mean_distance", "mean_square_distance", "low_ey", "high_ey"]
GROUP = ["step", "kind", "frame_kind"]


def best_class_statistics(spark, d):
    """Statistics of the best class's error vectors by motion kind and in all: what no way of choosing among the classes can beat."""
    return lo.statistics(le.best_vectors(_turned(spark, d), wide=True), [("best", f) for f in lo.FRAMES]).selectExpr(*GROUP, "n", *(significant(n) for n in STATS))


def best_class_vectors(spark, d):
    """Mean length of the best class's error, and mean size of its parts along and across the velocity, by step and class."""
    rows = le.best_vectors(_turned(spark, d)).where("frame_kind = 'velocity' AND ex IS NOT NULL AND ez IS NOT NULL")
    sizes = [F.round(F.avg(F.abs(c)), 4).alias(n) for c, n in (("ex", "along"), ("ey", "across"), ("ez", "aside"))]
    return rows.groupBy("step", "label").agg(F.count("*").alias("n"), *sizes)


QUERIES = {f.__name__: f for f in (best_class_statistics, best_class_vectors)}

_held = {0: "c1", 1: "2 * c1 - c2", 2: "2.5e0 * c1 - 2 * c2 + 0.5e0 * c3", 3: "3 * c1 - 3 * c2 + c3", 4: "4 * c1 - 6 * c2 + 4 * c3 - c4"}


def _missed(c: str) -> str:
    held = " ".join(f"WHEN {i} THEN {c} - ({e.replace('c', c)})" for i, e in _held.items())
    circles = " ".join(f"WHEN {i} THEN circ{i - 4}_{c}" for i in (5, 6, 7))
    curves = " ".join(f"WHEN {i} THEN {c} - coalesce({n}_{c}, {_held[3].replace('c', c)})" for i, n in ((8, "joint"), (9, "split")))
    return f"CASE label {held} {circles} {curves} END"


def _dot(a: str, b: str) -> str:
    return "(" + "+".join(f"{a.replace('@', c)}*{b.replace('@', c)}" for c in "xyz") + ")"


def _unit(name: str, a: str) -> str:
    return ", ".join(f"({a.replace('@', c)}) / nullif(sqrt({_dot(f'({a})', f'({a})')}), 0) AS {name}{c}" for c in "xyz")


def _cross(name: str, a: str, b: str) -> str:
    return ", ".join(f"{a}{p}*{b}{q}-{a}{q}*{b}{p} AS {name}{c}" for c, p, q in ("xyz", "yzx", "zxy"))


def _turned_back(c: str) -> str:
    """A column of the rotation matrix of the quaternion before, times the error."""
    w, x, y, z = "qw1", "qx1", "qy1", "qz1"
    columns = {
        "x": (f"1-2*({y}*{y}+{z}*{z})", f"2*({x}*{y}+{w}*{z})", f"2*({x}*{z}-{w}*{y})"),
        "y": (f"2*({x}*{y}-{w}*{z})", f"1-2*({x}*{x}+{z}*{z})", f"2*({y}*{z}+{w}*{x})"),
        "z": (f"2*({x}*{z}+{w}*{y})", f"2*({y}*{z}-{w}*{x})", f"1-2*({x}*{x}+{y}*{y})"),
    }[c]
    return "+".join(f"({m})*mis{a}" for m, a in zip(columns, "xyz", strict=True))


_vectors = f"""{LABELLED},
v1 AS (SELECT f.*, l2.label, {', '.join(f'{_missed(c)} AS mis{c}' for c in 'xyz')} FROM f JOIN l2 USING (track_id, step, k)),
v2 AS (SELECT *, {_unit('fh', '@1-@2')}, {_unit('gh', '1.5e0*@1-2*@2+0.5e0*@3')}, {', '.join(f'{c}1-2*{c}2+{c}3 AS ac{c}' for c in 'xyz')} FROM v1),
v3 AS (SELECT *, {', '.join(f"ac{c}-{_dot('ac@', 'fh@')}*fh{c} AS fo{c}, ac{c}-{_dot('ac@', 'gh@')}*gh{c} AS go{c}" for c in 'xyz')} FROM v2),
v4 AS (SELECT *, {_unit('fw', 'fo@')}, {_unit('gw', 'go@')} FROM v3),
v5 AS (SELECT *, {_cross('fb', 'fh', 'fw')}, {_cross('gb', 'gh', 'gw')} FROM v4),
ve AS (
  SELECT track_id, step, label, 'world' AS frame_kind, misx AS ex, misy AS ey, misz AS ez FROM v5
  UNION ALL SELECT track_id, step, label, 'object', {', '.join(_turned_back(c) for c in 'xyz')} FROM v5
  UNION ALL SELECT track_id, step, label, 'velocity', {', '.join(_dot('mis@', f'{a}@') for a in ('fh', 'fw', 'fb'))} FROM v5
  UNION ALL SELECT track_id, step, label, 'velocity2', {', '.join(_dot('mis@', f'{a}@') for a in ('gh', 'gw', 'gb'))} FROM v5)"""
_by = ", ".join(GROUP)
_square = " + ".join(f"({c} - mean_{c}) * ({c} - mean_{c})" for c in lo.MOMENTS)
SQL = {
    "best_class_statistics": f"""{_vectors},
{TRACKS},
c0 AS (SELECT ve.*, unnest([motion_kind, 'all']) AS kind FROM ve JOIN tr USING (track_id) WHERE ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL),
s0 AS (SELECT {_by}, count(*) AS n, {', '.join(f'avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}' for c in lo.MOMENTS)}, covar_samp(ex, ey) AS cov_ex_ey, avg(sqrt(ex * ex + ey * ey + ez * ez)) AS mean_size FROM c0 GROUP BY ALL),
d0 AS (SELECT {_by}, avg(sqrt({_square})) AS mean_distance, avg({_square}) AS mean_square_distance FROM c0 JOIN s0 USING ({_by}) GROUP BY ALL),
s2 AS (SELECT s0.*, mean_distance, mean_square_distance, {lo.INTERVALS['low_ey']} AS low_ey, {lo.INTERVALS['high_ey']} AS high_ey FROM s0 JOIN d0 USING ({_by}))
SELECT {_by}, n, {', '.join(significant(n) for n in STATS)} FROM s2""",
    "best_class_vectors": f"""{_vectors}
SELECT step, label, count(*) AS n, round(avg(abs(ex)), 4) AS along, round(avg(abs(ey)), 4) AS across, round(avg(abs(ez)), 4) AS aside FROM ve
WHERE frame_kind = 'velocity' AND ex IS NOT NULL AND ez IS NOT NULL GROUP BY ALL""",
}
