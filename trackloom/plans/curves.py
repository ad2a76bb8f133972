"""Queries on minimum-jerk movements, and the same results in SQL written from the definition: every duration is tried with all poses of a movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.layers import apply
from ..operators import segments
from ..sources import poses as src
from .sql import POSES, STEPS

#: Moving averages of so many poses, one of another, make of jumpy tracks smooth ones; as they are small, they are enlarged.
AVERAGED, TIMES, ENLARGED = 8, 4, 20
_WINDOW = f"(PARTITION BY track_id ORDER BY frame ROWS BETWEEN {AVERAGED - 1} PRECEDING AND CURRENT ROW)"


def smoothed(poses):
    """Poses whose positions are moving averages of theirs, with all other columns."""
    rows = apply(poses, [{f"{c}{i + 1}": f"avg({c}{i or ''}) OVER {_WINDOW}" for c in "xyz"} for i in range(TIMES)])
    return rows.selectExpr(*(f"{ENLARGED} * {c}{TIMES} AS {c}" if c in ("x", "y", "z") else c for c in poses.columns))


def smooth_poses(spark, d):
    return smoothed(src.event_poses(spark, d))


def min_jerk_errors(spark, d):
    """Mean errors of the minimum-jerk predictions, of all axes together and of each by itself, and of the quadratic one, by the movement's length so far."""
    e = segments.min_jerk_errors(smooth_poses(spark, d)).where("err IS NOT NULL OR axes > 0")
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("err", "split", "quad")]
    return e.groupBy("step", F.least("moving", F.lit(10)).alias("poses")).agg(F.count("*").alias("n"), F.count("err").alias("n_joint"), F.sum("axes").alias("n_axes"), *means)


def min_jerk_tracks(spark, d):
    """By track and step: rows, rows in a movement, the longest movement, and how often each minimum-jerk prediction beats the quadratic one."""
    e = segments.min_jerk_errors(smooth_poses(spark, d))
    better = [F.count_if(F.col(c) < F.col("quad") - F.lit(1e-6)).alias(f"{c}_better") for c in ("err", "split")]
    return e.groupBy("track_id", "step").agg(F.count("*").alias("n"), F.count_if(F.col("moving") >= 2).alias("in_movement"), F.max("moving").alias("longest"), *better)


QUERIES = {f.__name__: f for f in (min_jerk_errors, min_jerk_tracks)}

_smooth = POSES.replace("p AS (", "p0 AS (")
for _i in range(TIMES):
    _smooth += f",\np{_i + 1 if _i + 1 < TIMES else 's'} AS (SELECT track_id, frame, {', '.join(f'avg({c}) OVER w AS {c}' for c in 'xyz')} FROM p{_i} WINDOW w AS {_WINDOW})"
SMOOTH = _smooth + f",\np AS (SELECT track_id, frame, {', '.join(f'{ENLARGED} * {c} AS {c}' for c in 'xyz')} FROM ps)" + STEPS.removeprefix(POSES)


def _square(parts):
    return "sqrt(" + " + ".join(f"({e}) * ({e})" for e in parts) + ")"


def _tried(name: str, n: str, axes: str) -> str:
    """<name>: the prediction of ``axes`` for the row after each that has moved for two rows or more."""
    total = lambda e: f"list_sum(list_transform(range(1, n + 2), lambda i: w[i] * s[i] * {e}))"
    curve = lambda t: f"10 * pow({t}, 3) - 15 * pow({t}, 4) + 6 * pow({t}, 5)"
    return f"""{name}1 AS (SELECT track_id, step, k, {n} AS n, {', '.join(f'list({c}) OVER g AS p{c}' for c in axes)} FROM mv4
  WINDOW g AS (PARTITION BY track_id, step, k - {n} ORDER BY k ROWS UNBOUNDED PRECEDING)),
{name}2 AS (SELECT *, (1 + j / 8e0) * n AS d FROM (SELECT *, unnest(range(33)) AS j FROM {name}1 WHERE n >= 2)),
{name}3 AS (SELECT *, list_transform(range(n + 1), lambda i: {curve('(i / d)')}) AS s, list_transform(range(n + 1), lambda i: pow(0.91e0, 2 * i)) AS w FROM {name}2),
{name}4 AS (SELECT *, {total('s[i]')} AS e, {', '.join(f'{total(f"(p{c}[i] - p{c}[1])")} AS b_{c}' for c in axes)} FROM {name}3),
{name}5 AS (SELECT *, row_number() OVER (PARTITION BY track_id, step, k ORDER BY ({' + '.join(f'b_{c} * b_{c}' for c in axes)}) / e DESC, j) AS place, least((n + 1) / d, 1e0) AS t FROM {name}4),
{name} AS (SELECT track_id, step, k, {', '.join(f'p{c}[1] + ({curve("t")}) * b_{c} / e AS {name}_{c}' for c in axes)} FROM {name}5 WHERE place = 1)"""


_turn = "acos(greatest(-1, least(1, (vx * ux + vy * uy + vz * uz) / nullif(v * u, 0))))"
#: From st (track_id, step, k, x, y, z) to mv4, with n and nx, ny, nz, and the predictions in joint and splitx, splity, splitz.
FITS = f"""mv1 AS (SELECT track_id, step, k, x, y, z,
  {', '.join(f'{c} - lag({c}) OVER w AS v{c}, lag({c}) OVER w - lag({c}, 2) OVER w AS u{c}' for c in 'xyz')},
  {', '.join(f'{c} - 6 * lag({c}) OVER w + 15 * lag({c}, 2) OVER w - 20 * lag({c}, 3) OVER w + 15 * lag({c}, 4) OVER w - 6 * lag({c}, 5) OVER w + lag({c}, 6) OVER w AS j{c}' for c in 'xyz')}
  FROM st WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
mv2 AS (SELECT *, {_square(['vx', 'vy', 'vz'])} AS v, {_square(['ux', 'uy', 'uz'])} AS u, {_square(['vx - ux', 'vy - uy', 'vz - uz'])} AS a, {_square(['jx', 'jy', 'jz'])} AS j FROM mv1),
mv3 AS (SELECT *, k = 0 OR v < 10 OR (k >= 2 AND u >= 10 AND coalesce({_turn} > pi() / 6, false)) OR coalesce(j > 0.1 AND j > 1.25 * a / (step * step), false) AS o,
  {', '.join(f'k = 0 OR v{c} < 10 OR (k >= 2 AND u{c} >= 10 AND sign(v{c}) <> sign(u{c})) OR coalesce(abs(j{c}) > 0.1 AND abs(j{c}) > 1.25 * abs(v{c} - u{c}), false) AS o{c}' for c in 'xyz')} FROM mv2),
mv4 AS (SELECT *, k - max(CASE WHEN o THEN k END) OVER w AS n, {', '.join(f'k - max(CASE WHEN o{c} THEN k END) OVER w AS n{c}' for c in 'xyz')}
  FROM mv3 WINDOW w AS (PARTITION BY track_id, step ORDER BY k ROWS UNBOUNDED PRECEDING)),
{_tried('joint', 'n', 'xyz')},
{', '.join(_tried(f'split{c}', f'n{c}', c) for c in 'xyz')}"""
_joined = "LEFT JOIN joint USING (track_id, step, k) " + " ".join(f"LEFT JOIN split{c} USING (track_id, step, k)" for c in "xyz")
_errors = f"""WITH {SMOOTH},
{FITS},
nx AS (SELECT *, {', '.join(f'lead({c}) OVER w AS t{c}, 3 * {c} - 3 * lag({c}) OVER w + lag({c}, 2) OVER w AS q{c}' for c in 'xyz')} FROM mv4 WINDOW w AS (PARTITION BY track_id, step ORDER BY k)),
er AS (SELECT track_id, step, k, n AS moving, {_square([f'joint_{c} - t{c}' for c in 'xyz'])} AS err, {_square([f'coalesce(split{c}_{c}, q{c}) - t{c}' for c in 'xyz'])} AS split,
  {' + '.join(f'CAST(split{c}_{c} IS NOT NULL AS INT)' for c in 'xyz')} AS axes, {_square([f'q{c} - t{c}' for c in 'xyz'])} AS quad FROM nx {_joined} WHERE tx IS NOT NULL AND k >= 2)"""
SQL = {
    "min_jerk_errors": f"""{_errors}
SELECT step, least(moving, 10) AS poses, count(*) AS n, count(err) AS n_joint, CAST(sum(axes) AS BIGINT) AS n_axes, round(avg(err), 4) AS mean_err, round(avg(split), 4) AS mean_split,
  round(avg(quad), 4) AS mean_quad FROM er WHERE err IS NOT NULL OR axes > 0 GROUP BY ALL""",
    "min_jerk_tracks": f"""{_errors}
SELECT track_id, step, count(*) AS n, count(*) FILTER (moving >= 2) AS in_movement, max(moving) AS longest, count(*) FILTER (err < quad - 1e-6) AS err_better,
  count(*) FILTER (split < quad - 1e-6) AS split_better FROM er GROUP BY ALL""",
}
#: q with where the curves through the poses before a row put it.
CURVED = f"""{FITS},
qf AS (SELECT q.*, {', '.join(f'lag(joint_{c}) OVER w AS joint_{c}, lag(split{c}_{c}) OVER w AS split_{c}' for c in 'xyz')} FROM q {_joined} WINDOW w AS (PARTITION BY track_id, step ORDER BY k))"""
