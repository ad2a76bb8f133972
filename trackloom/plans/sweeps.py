"""Queries on grids of parameters, and the same results in SQL, where each row meets each cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import banks
from ..operators import filters as fl
from ..sources import poses as src
from ..sources.store import saved
from .features import turned_sql
from .motion import _turned
from .sql import STEPS

SIGMOID = [(s, p) for s in np.linspace(0.4, np.pi, 33).tolist() for p in np.linspace(0.5, 5, 35).tolist()]
SLOPES, ARCS = np.linspace(0, 1, 500).tolist(), np.linspace(0.0001, 5, 100).tolist()
SINCS = [(r, k) for r in np.linspace(2.0001, 3.5, 10).tolist() for k in np.linspace(0.0001, 5, 10).tolist()]


def _named(spark, found, cells, names, value, digits):
    """With the cells' parameters, and best, which marks the first cell of the least value."""
    table = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cells)], "configuration int, " + ", ".join(f"{n} double" for n in names))
    rows = saved(found.join(F.broadcast(table), "configuration").withColumn(value, F.round(value, digits)))  # a row a step and cell
    first = rows.groupBy("step").agg(F.min(F.struct(value, "configuration")).alias("b")).select("step", F.col("b.configuration").alias("first"))
    rows = rows.join(F.broadcast(first), "step").withColumn("best", F.col("configuration") == F.col("first"))
    return rows.select("step", *(F.round(n, 6).alias(n) for n in names), value, "best")


def rotation_scale_grid(spark, d):
    """Mean over tracks of the angle off when the last turn is repeated, saturated by a scale and a power."""
    scale, power = np.array(SIGMOID).T
    return _named(spark, banks.track_means(banks.turns(_turned(spark, d)), banks.saturated(scale, power), len(SIGMOID)), SIGMOID, ["scale", "power"], "mean_err", 5)


def rotation_slope_medians(spark, d):
    """Median of the angle off when the last turn is repeated times a factor."""
    rows = banks.turns(_turned(spark, d)).where("k >= 2")
    return _named(spark, banks.medians(rows, banks.linear_cosines(np.array(SLOPES)), len(SLOPES), read=banks.of_cosines), SLOPES, ["slope"], "median", 5)


def rotation_arc_grid(spark, d):
    """Mean over tracks of the angle off with the arctangent map of the last turn, by its scale."""
    return _named(spark, banks.track_means(banks.turns(_turned(spark, d)), banks.arctangent(np.array(ARCS)), len(ARCS)), ARCS, ["scale"], "mean_err", 5)


def sinc_filter_grid(spark, d):
    """Mean over tracks of the distance off of the tapered-sinc filter, by radius and k."""
    return _named(spark, banks.filter_means(src.event_poses(spark, d), [fl.sinc_filters(*c) for c in SINCS]), SINCS, ["radius", "k"], "mean_err", 4)


QUERIES = {f.__name__: f for f in (rotation_scale_grid, rotation_slope_medians, rotation_arc_grid, sinc_filter_grid)}


def _turn(to: str, at: str) -> str:
    """The four parts of to times the conjugate of at, quaternions with columns of these prefixes."""
    a, b = ({c: f"{p}{c}" for c in "wxyz"} for p in (to, at))
    return ", ".join(
        f"{e} AS {to}_{c}"
        for c, e in {
            "w": f"{a['w']} * {b['w']} + {a['x']} * {b['x']} + {a['y']} * {b['y']} + {a['z']} * {b['z']}",
            "x": f"{a['x']} * {b['w']} - {a['w']} * {b['x']} - {a['y']} * {b['z']} + {a['z']} * {b['y']}",
            "y": f"{a['y']} * {b['w']} - {a['w']} * {b['y']} - {a['z']} * {b['x']} + {a['x']} * {b['z']}",
            "z": f"{a['z']} * {b['w']} - {a['w']} * {b['z']} - {a['x']} * {b['y']} + {a['y']} * {b['x']}",
        }.items()
    )


_turns = f"""{turned_sql()},
b1 AS (SELECT *, {', '.join(f'lag(q{c}, {i}) OVER w AS {"pr"[i - 1]}{c}' for i in (1, 2) for c in 'wxyz')} FROM q WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
b2 AS (SELECT *, {_turn('q', 'p')}, {_turn('p', 'r')} FROM b1 WHERE k >= 1),
b3 AS (SELECT *, sqrt(p_x * p_x + p_y * p_y + p_z * p_z) AS size, CASE WHEN p_w < 0 THEN -1 ELSE 1 END AS side FROM b2),
tu AS (SELECT track_id, step, k, 2 * acos(least(1, abs(q_w))) AS turn, q_w, 2 * atan2(size, abs(p_w)) AS last,
  coalesce(side * (q_x * p_x + q_y * p_y + q_z * p_z) / nullif(size, 0), 0) AS part FROM b3)"""


def _means(cells: str, angle: str, names: list[str], digits: int) -> str:
    """Means over tracks for each cell of a table ``cells`` of an angle that looks at last; a track's first turn counts whole."""
    by = ", ".join(names)
    return f"""{_turns}, gr AS ({cells}),
e1 AS (SELECT track_id, step, {by}, CASE WHEN k = 1 THEN turn ELSE 2 * acos(least(1, abs(q_w * cos({angle} / 2) + part * sin({angle} / 2)))) END AS err FROM tu, gr),
e2 AS (SELECT step, {by}, avg(err) AS m FROM e1 GROUP BY track_id, step, {by}),
e3 AS (SELECT step, {by}, round(avg(m), {digits}) AS mean_err FROM e2 GROUP BY ALL)
SELECT step, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, mean_err, row_number() OVER (PARTITION BY step ORDER BY mean_err, {by}) = 1 AS best FROM e3"""


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


_past = ", ".join(f"list({c}) OVER (PARTITION BY track_id, step ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p{c}" for c in "xyz")
_filters = ", ".join(f"({r!r}::DOUBLE, {k!r}::DOUBLE, {n}, {_list(w)})" for r, k in SINCS for f in [fl.sinc_filters(r, k)] for n in range(1, 5) for w in [[0.0] * (n - len(f[min(n, max(f))])) + f[min(n, max(f))]])
SQL = {
    "rotation_scale_grid": _means(
        f"SELECT * FROM (SELECT unnest({_list(sorted({s for s, _ in SIGMOID}))}) AS scale), (SELECT unnest({_list(sorted({p for _, p in SIGMOID}))}) AS power)",
        "(last / pow(1 + pow(abs(last / scale), power), 1 / power))", ["scale", "power"], 5,
    ),
    "rotation_arc_grid": _means(f"SELECT unnest({_list(ARCS)}) AS scale", "(scale * atan2(2 * sin(last / scale), 2 * cos(last / scale) - 1) - last)", ["scale"], 5),
    "rotation_slope_medians": f"""{_turns}, gr AS (SELECT unnest({_list(SLOPES)}) AS slope),
e1 AS (SELECT step, slope, 2 * acos(least(1, abs(q_w * cos(slope * last / 2) + part * sin(slope * last / 2)))) AS err FROM tu, gr WHERE k >= 2),
e2 AS (SELECT step, slope, round(median(err), 5) AS median FROM e1 GROUP BY ALL)
SELECT step, round(slope, 6) AS slope, median, row_number() OVER (PARTITION BY step ORDER BY median, slope) = 1 AS best FROM e2""",
    "sinc_filter_grid": f"""WITH {STEPS}, pa AS (SELECT *, {_past} FROM st), fi AS (SELECT * FROM (VALUES {_filters}) f(radius, kk, n, w)),
e1 AS (SELECT track_id, step, radius, kk, sqrt({' + '.join(f'pow({c} - list_dot_product(p{c}, w), 2)' for c in 'xyz')}) AS err FROM pa JOIN fi ON n = len(px) WHERE k > 0),
e2 AS (SELECT step, radius, kk, avg(err) AS m FROM e1 GROUP BY track_id, step, radius, kk),
e3 AS (SELECT step, radius, kk, round(avg(m), 4) AS mean_err FROM e2 GROUP BY ALL)
SELECT step, round(radius, 6) AS radius, round(kk, 6) AS k, mean_err, row_number() OVER (PARTITION BY step ORDER BY mean_err, radius, kk) = 1 AS best FROM e3""",
}
