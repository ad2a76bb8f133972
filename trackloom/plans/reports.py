"""Queries that report on predictors: errors in reference frames, score tables, places, sweeps; and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.layers import apply
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import gram
from ..operators import localized as lo
from ..operators import predict as pr
from ..operators.selection import quantiles
from ..sources import poses as src
from ..sources.store import saved
from .features import ctes, significant, turned_sql
from .motion import _turned
from .queries import FIVE, MODELS
from .sql import ALL, KEYS, KIN, LAGS, SCORES, TRACKS, _dot, _err, _errors, A, V

STATS = ["mean_ex", "mean_ey", "mean_ez", "std_ex", "cov_ex_ey", "cov_ey_ez", "det", "mean_size", "mean_distance", "mean_square_distance", "low_ex", "high_ex", "low_ez", "high_ez"]
GROUP = ["step", "model", "kind", "frame_kind"]


def _statistics(spark, d):
    return lo.statistics(lo.localized(_turned(spark, d), wide=True), lo.WIDE)


def local_error_statistics(spark, d):
    """Statistics of four predictors' errors in four frames, by motion kind and in all."""
    return _statistics(spark, d).selectExpr(*GROUP, "n", *(significant(n) for n in STATS))


def local_error_extremes(spark, d):
    """Least and largest bounds of the means' intervals over the moving kinds, and over the still kinds."""
    s = _statistics(spark, d).where("kind <> 'all'").withColumn("still", F.col("kind").startswith("static"))
    out = s.groupBy("step", "frame_kind", "still").agg(*(f(f"{n}_{c}").alias(f"{n}_{c}") for c in lo.MOMENTS for n, f in (("low", F.min), ("high", F.max))))
    return out.selectExpr("step", "frame_kind", "still", *(significant(f"{n}_{c}") for c in lo.MOMENTS for n in ("low", "high")))


def local_error_divergence(spark, d):
    """Divergence of each frame's Gaussian from the world's, by step, model and motion kind."""
    s = _statistics(spark, d).select(*GROUP, "det", *(f"mean_{c}" for c in lo.MOMENTS), *(f"var_{c}" for c in lo.MOMENTS), *(f"cov_{a}_{b}" for a, b in lo.PAIRS))
    world = s.where("frame_kind = 'world'").drop("frame_kind")
    both = s.where("frame_kind <> 'world'").select(*GROUP, *(F.col(c).alias(f"a_{c}") for c in s.columns[4:]))
    both = both.join(world.select("step", "model", "kind", *(F.col(c).alias(f"b_{c}") for c in s.columns[4:])), ["step", "model", "kind"])
    return both.selectExpr(*GROUP, f"round({lo.divergence('a_', 'b_')}, 4) AS divergence")


def local_error_axes(spark, d):
    """Eigenvalues and eigenvectors of the covariances."""
    return lo.principal_axes(_statistics(spark, d)).selectExpr(*GROUP, "i", significant("eigenvalue"), *(f"round({c}, 4) + 0e0 AS {c}" for c in ("ux", "uy", "uz")))


def object_sequence_scores(spark, d):
    """Scores by object, by sequence and in total: a row for each group and model, with its place, and whether the model
    reaches the threshold model in some group of its kind. The duplicate cameras and the bound that looks ahead are left out."""
    return ev.score_groups(ev.scores(pr.long_errors(pr.errors(src.event_poses(spark, d), MODELS))), src.tracks(src.event_poses(spark, d)), "VEL_DEG1", ["VEL_BCS"])


def ratio_distributions(spark, d):
    """Mean, least, largest, median and deviation of what the true next displacement is as a share of velocity, acceleration and its orthogonal part."""
    rows = apply(pr.with_history(pr.down_sampled(src.event_poses(spark, d)), 3).where("k >= 3"), RATIOS)
    each = "inline(array(" + ", ".join(f"named_struct('ratio', '{n}', 'value', {n})" for n in ("velocity", "acceleration", "orthogonal")) + "))"
    rows = saved(rows.selectExpr("step", each).where("value IS NOT NULL"))
    aggs = [F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.round(F.stddev_pop("value"), 3).alias("std")]
    medians = quantiles(rows, ["step", "ratio"], "value", 0.5).select("step", "ratio", F.round("quantile", 4).alias("median"))
    return rows.groupBy("step", "ratio").agg(*aggs).join(F.broadcast(medians), ["step", "ratio"])


RATIOS = [
    {f"v{c}": f"({c}1 - {c}2)" for c in "xyz"} | {f"a{c}": f"({c}1 - 2 * {c}2 + {c}3)" for c in "xyz"} | {f"n{c}": f"({c} - {c}1)" for c in "xyz"},
    {"vv": "vx * vx + vy * vy + vz * vz", "av": "ax * vx + ay * vy + az * vz", "nv": "nx * vx + ny * vy + nz * vz"},
    {f"o{c}": f"(a{c} - v{c} * av / nullif(vv, 0))" for c in "xyz"},
    {"oo": "ox * ox + oy * oy + oz * oz", "no": "nx * ox + ny * oy + nz * oz", "na": "(nx - vx) * ax + (ny - vy) * ay + (nz - vz) * az", "aa": "ax * ax + ay * ay + az * az"},
    {"velocity": "nv / nullif(vv, 0)", "acceleration": "na / nullif(aa, 0)", "orthogonal": "no / nullif(oo, 0)"},
    # 2D bound: the best combination of the velocity and the acceleration across it.
    {f"e{c}": f"(n{c} - v{c} * coalesce(velocity, 0) - o{c} * coalesce(orthogonal, 0))" for c in "xyz"},
]


def best_scaled_plane(spark, d):
    """Error of the best combination of the last velocity and the acceleration across it, looking at the true next pose."""
    rows = apply(pr.with_history(pr.down_sampled(src.event_poses(spark, d)), 3).where("k >= 3"), RATIOS)
    return rows.selectExpr(*KEYS.split(", "), "round(sqrt(ex * ex + ey * ey + ez * ez), 4) AS err")


def switch_threshold_sweep(spark, d):
    """A hundred thresholds of the switch by the cosine of the last turn; 'velocity' and 'best' are the bounds that it lies between."""
    return ev.bounce_report(src.event_poses(spark, d)).selectExpr("step", "way", "t", "round(mean_err, 5) AS mean_err")


def sequence_model_errors(spark, d):
    """The model that is best in a sequence on its training tracks, and its mean error on all and on test tracks."""
    e = pr.long_errors(pr.errors(src.event_poses(spark, d), FIVE)).select("track_id", "step", "model", "err")
    of = e.select("step", "model", "err", (F.col("track_id") % 22).alias("seq"), (F.col("track_id") % 5 == 0).alias("test"))
    sums = of.groupBy("step", "seq", "model").agg(*(f(c).alias(n) for n, f, c in (("n", F.count, F.col("err")), ("s", F.sum, F.col("err")), ("n_test", F.count, F.when(F.col("test"), F.col("err"))), ("s_test", F.sum, F.when(F.col("test"), F.col("err"))))))
    train = F.round((F.col("s") - F.coalesce("s_test", F.lit(0.0))) / F.nullif(F.col("n") - F.col("n_test"), F.lit(0)), 6)
    first = F.row_number().over(Window.partitionBy("step", "seq").orderBy(train.asc_nulls_last(), "model"))
    kept = sums.select("*", first.alias("i")).where("i = 1")
    return kept.groupBy("step", "model").agg(F.count("*").alias("sequences"), F.round(F.sum("s") / F.sum("n"), 5).alias("mean_all"), F.round(F.try_divide(F.sum("s_test"), F.sum("n_test")), 5).alias("mean_test"))


def body_split(spark, d):
    """A fifth of the bodies' tracks, whole bodies at a time, tests; 15 % validate; the rest trains."""
    t = src.tracks(src.event_poses(spark, d))
    return ev.split_groups(t, "body").groupBy("body", "split").agg(F.count("*").alias("tracks"))


def grouped_means(spark, d):
    """Mean over tracks of their means by motion kind and sequence, by motion kind, and in all: a rollup."""
    e = ev.scores(pr.long_errors(pr.errors(src.event_poses(spark, d), FIVE))).join(src.tracks(src.event_poses(spark, d)), "track_id")
    out = e.groupBy("step", "model", "motion_kind", "seq_name", "track_id").agg(F.sum("mean_err").alias("m")).groupBy("step", "model", "motion_kind", "seq_name")
    cells = out.agg(F.sum("m").alias("s"), F.count("*").alias("n"))
    rolled = cells.rollup("step", "model", "motion_kind", "seq_name").agg(F.grouping_id().alias("g"), (F.sum("s") / F.sum("n")).alias("macro"), F.sum("n").alias("tracks"))
    return rolled.where("g IN (0, 1, 3)").select("step", "model", "motion_kind", "seq_name", "tracks", F.round("macro", 5).alias("macro"))


def collinear_features(spark, d):
    """Of all scalar features, those that go as they are too close to an earlier one."""
    rows = ft.scalar_features(_turned(spark, d))
    return gram.collinear(gram.correlations(rows, list(ft.SCALARS))).select("feature", F.round("closest", 4).alias("closest"), "dropped")


QUERIES = {
    f.__name__: f
    for f in (
        local_error_statistics, local_error_extremes, local_error_divergence, local_error_axes, object_sequence_scores, ratio_distributions, best_scaled_plane,
        switch_threshold_sweep, sequence_model_errors, body_split, grouped_means, collinear_features,
    )
}

_rows = ", ".join("{" + ", ".join(f"'{n}': {e}" for n, e in r.items()) + "}" for m in lo.PREDICTORS for r in lo.errors_in_frames(m))
_by = ", ".join(GROUP)
_moments = (
    "count(*) AS n, " + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}, var_samp({c}) AS var_{c}" for c in lo.MOMENTS) + ", "
    + ", ".join(f"covar_samp({a}, {b}) AS cov_{a}_{b}" for a, b in lo.PAIRS) + ", avg(sqrt(ex * ex + ey * ey + ez * ez)) AS mean_size"
)
_square = " + ".join(f"({c} - mean_{c}) * ({c} - mean_{c})" for c in lo.MOMENTS)
STATISTICS = f"""{turned_sql()},
{ctes(lo.layers(), 'q', 'f')},
u AS (SELECT {KEYS}, unnest([{_rows}], recursive := true) FROM f WHERE k >= 4),
{TRACKS},
c0 AS (SELECT u.*, unnest([motion_kind, 'all']) AS kind FROM u JOIN tr USING (track_id) WHERE ex IS NOT NULL AND ey IS NOT NULL AND ez IS NOT NULL),
s0 AS (SELECT {_by}, {_moments} FROM c0 GROUP BY ALL),
d0 AS (SELECT {_by}, avg(sqrt({_square})) AS mean_distance, avg({_square}) AS mean_square_distance FROM c0 JOIN s0 USING ({_by}) GROUP BY ALL),
s1 AS (SELECT s0.*, mean_distance, mean_square_distance FROM s0 JOIN d0 USING ({_by})),
s2 AS (SELECT *, {lo.DET} AS det, {', '.join(f'{e} AS {n}' for n, e in lo.INTERVALS.items())} FROM s1)"""
_gauss = ["det", *(f"mean_{c}" for c in lo.MOMENTS), *(f"var_{c}" for c in lo.MOMENTS), *(f"cov_{a}_{b}" for a, b in lo.PAIRS)]
_eight = [m for m in ALL if m != "VEL_BCS"]
_bounds = ", ".join(f"{f}({n}_{c}) AS {n}_{c}" for c in lo.MOMENTS for n, f in (("low", "min"), ("high", "max")))
_ratios = ctes(RATIOS, "h3", "ra").replace(" FROM h3)", " FROM (SELECT * FROM h WHERE k >= 3))")
SQL = {
    "local_error_statistics": f"{STATISTICS} SELECT {_by}, n, {', '.join(significant(n) for n in STATS)} FROM s2",
    "local_error_extremes": f"""{STATISTICS}, x AS (SELECT step, frame_kind, starts_with(kind, 'static') AS still, {_bounds} FROM s2 WHERE kind <> 'all' GROUP BY ALL)
SELECT step, frame_kind, still, {', '.join(significant(f'{n}_{c}') for c in lo.MOMENTS for n in ('low', 'high'))} FROM x""",
    "local_error_divergence": f"""{STATISTICS},
ga AS (SELECT {_by}, {', '.join(f'{c} AS a_{c}' for c in _gauss)} FROM s2 WHERE frame_kind <> 'world'),
gb AS (SELECT step, model, kind, {', '.join(f'{c} AS b_{c}' for c in _gauss)} FROM s2 WHERE frame_kind = 'world')
SELECT {_by}, round({lo.divergence('a_', 'b_')}, 4) AS divergence FROM ga JOIN gb USING (step, model, kind)""",
    "local_error_axes": f"""{STATISTICS},
q1 AS (SELECT {_by}, var_ex AS a, var_ey AS b, var_ez AS c, cov_ex_ey AS d, cov_ex_ez AS e, cov_ey_ez AS f, (var_ex + var_ey + var_ez) / 3 AS q FROM s2),
q2 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q1),
q3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / nullif(2 * p * p * p, 0)))) / 3 AS t FROM q2),
q4 AS (SELECT *, unnest([0, 1, 2]) AS i FROM q3),
q5 AS (SELECT *, q + 2 * p * cos(t + CASE i WHEN 0 THEN 0 WHEN 1 THEN 4 * pi() / 3 ELSE 2 * pi() / 3 END) AS v FROM q4),
-- The adjugate of the matrix less the value is the eigenvector times itself: the column of its largest diagonal entry is along it.
q6 AS (SELECT *, (b - v) * (c - v) - f * f AS xx, (a - v) * (c - v) - e * e AS yy, (a - v) * (b - v) - d * d AS zz, e * f - d * (c - v) AS xy, d * f - e * (b - v) AS xz, d * e - f * (a - v) AS yz FROM q5),
q7 AS (SELECT *, CASE WHEN abs(xx) >= abs(yy) AND abs(xx) >= abs(zz) THEN [xx, xy, xz] WHEN abs(yy) >= abs(zz) THEN [xy, yy, yz] ELSE [xz, yz, zz] END AS u FROM q6),
q8 AS (SELECT *, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS n FROM q7),
q9 AS (SELECT *, CASE WHEN list_max(n) >= -list_min(n) THEN 1 ELSE -1 END AS s FROM q8)
SELECT {_by}, i, {significant('eigenvalue', 'v')}, round(s * n[1], 4) + 0e0 AS ux, round(s * n[2], 4) + 0e0 AS uy, round(s * n[3], 4) + 0e0 AS uz FROM q9 WHERE p > 0""",
    "object_sequence_scores": f"""{_errors(_eight)}{SCORES}, {TRACKS},
j AS (SELECT s.*, body_name, seq_name FROM s JOIN tr USING (track_id) WHERE NOT is_cam2),
g AS (SELECT step, model, 'object' AS grouping, body_name AS name, avg(score) AS score, count(*) AS tracks FROM j GROUP BY ALL UNION ALL
      SELECT step, model, 'sequence', seq_name, avg(score), count(*) FROM j GROUP BY ALL UNION ALL
      SELECT step, model, 'total', 'Avg', avg(score), count(*) FROM j GROUP BY ALL),
t2 AS (SELECT step, grouping, name, score AS bar FROM g WHERE model = 'VEL_DEG1'),
r2 AS (SELECT step, model, grouping, name, tracks, round(score, 6) AS score, round(bar, 6) AS bar FROM g JOIN t2 USING (step, grouping, name)),
p2 AS (SELECT *, row_number() OVER w - 1 AS place, max(CASE WHEN model = 'VEL_DEG1' THEN 1 ELSE 0 END) OVER w AS d FROM r2
       WINDOW w AS (PARTITION BY step, grouping, name ORDER BY score DESC, model)),
q2 AS (SELECT *, max(CASE WHEN model = 'VEL_DEG1' THEN place END) OVER (PARTITION BY step, grouping, name) AS bar_place FROM p2)
SELECT step, model, grouping, name, tracks, score, CAST(place AS INT) AS place, CAST(bar_place - place AS INT) AS places_ahead,
       bool_or(score >= bar) OVER (PARTITION BY step, grouping, model) AS reaches FROM q2""",
    "ratio_distributions": f"""WITH {LAGS}, {_ratios},
l AS ({' UNION ALL '.join(f"SELECT step, '{n}' AS ratio, {n} AS value FROM ra WHERE {n} IS NOT NULL" for n in ('velocity', 'acceleration', 'orthogonal'))})
SELECT step, ratio, count(*) AS n, round(avg(value), 3) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_pop(value), 3) AS std,
  round(median(value), 4) AS median FROM l GROUP BY ALL""",
    "best_scaled_plane": f"WITH {LAGS}, {_ratios} SELECT {KEYS}, round(sqrt(ex * ex + ey * ey + ez * ez), 4) AS err FROM ra",
    "switch_threshold_sweep": f"""WITH {LAGS},
c AS (SELECT step, coalesce({_dot(V, {c: f'({c}2-{c}3)' for c in 'xyz'})}/nullif(sqrt({_dot(V, V)})*sqrt({_dot({c: f'({c}2-{c}3)' for c in 'xyz'}, {c: f'({c}2-{c}3)' for c in 'xyz'})}),0),1) AS cosine,
             {_err('ACC_DEG2')} AS q, {_err('VEL_DEG1')} AS v FROM h WHERE k >= 3)
SELECT step, 'switch' AS way, CAST(t AS INT) AS t, round(avg(CASE WHEN floor((cosine + 1) / 2 * 100) < t THEN v ELSE q END), 5) AS mean_err FROM c, range(0, 101) r(t) GROUP BY ALL
UNION ALL SELECT step, 'velocity', NULL, round(avg(v), 5) FROM c GROUP BY 1 UNION ALL SELECT step, 'best', NULL, round(avg(least(v, q)), 5) FROM c GROUP BY 1""",
    "sequence_model_errors": f"""{_errors(FIVE)},
q AS (SELECT step, track_id % 22 AS seq, model, count(*) AS n, sum(err) AS s, count(err) FILTER (track_id % 5 = 0) AS n_test, sum(err) FILTER (track_id % 5 = 0) AS s_test FROM l GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY step, seq ORDER BY round((s - coalesce(s_test, 0)) / nullif(n - n_test, 0), 6) NULLS LAST, model) AS i FROM q)
SELECT step, model, count(*) AS sequences, round(sum(s) / sum(n), 5) AS mean_all, round(sum(s_test) / nullif(sum(n_test), 0), 5) AS mean_test FROM o WHERE i = 1 GROUP BY ALL""",
    "body_split": f"""WITH {TRACKS}, b AS (SELECT body, count(*) AS tracks, (body * 2654435761) % 4294967296 AS h FROM tr GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY h, body) AS i, count(*) OVER () AS n FROM b)
SELECT body, CASE WHEN i <= ceil(n * 0.2) THEN 'test' WHEN i <= ceil(n * 0.2) + ceil(n * 0.15) THEN 'validation' ELSE 'train' END AS split, tracks FROM o""",
    "grouped_means": f"""{_errors(FIVE)}{SCORES}, {TRACKS}
SELECT step, model, motion_kind, seq_name, count(*) AS tracks, round(avg(mean_err), 5) AS macro FROM s JOIN tr USING (track_id)
GROUP BY GROUPING SETS ((step, model, motion_kind, seq_name), (step, model, motion_kind), (step, model))""",
    "collinear_features": f"""{turned_sql()},
{ctes(ft.layers(), 'q', 'f')},
s2 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ft.SCALARS.items())} FROM f WHERE k >= 4),
c2 AS (SELECT [{', '.join(f"{{'feature': '{b}', 'r': abs(corr({a}, {b}))}}" for i, a in enumerate(ft.SCALARS) for b in list(ft.SCALARS)[i + 1:])}] AS l FROM s2),
p3 AS (SELECT unnest(l, recursive := true) FROM c2)
SELECT feature, round(max(r) FILTER (NOT isnan(r)), 4) AS closest, coalesce(max(r) FILTER (NOT isnan(r)) > 0.7, false) AS dropped FROM p3 GROUP BY 1""",
}
