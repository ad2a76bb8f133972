"""Queries on learning which predictor to use, on filters and on files, and the same results in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import matrix
from ..operators import banks
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import filters as fl
from ..operators import learning as le
from ..operators import predict as pr
from ..operators.orientation import unwrap_layers
from ..operators import rotation, segments, shape, tree
from ..sources import poses as src
from ..sources.store import saved, scratch
from .curves import CURVED, smoothed
from .features import ctes, significant, turned_sql
from .motion import ROT, SQL as MOTION_SQL, W, _turned
from .sql import KEYS, POSES, STEPS, TRACKS

SPLIT = """WITH i AS (SELECT track_id, row_number() OVER (ORDER BY (track_id * 2654435761) % 4294967296, track_id) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id AS track_id FROM events))
SELECT track_id, CASE WHEN i <= ceil(n * 0.2) THEN 'test' WHEN i <= ceil(n * 0.2) + ceil(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM i"""


def training_table(spark, d):
    rows = le.training_table(_turned(spark, d), le.FEATURES)
    return rows.selectExpr("track_id", "step", "k", "split", "label", "last_label", *(significant(n) for n in [*le.FEATURES, *le.CLASSES, "min_err"]))


def label_counts(spark, d):
    """How often each class is best, and its mean error there, by split and step."""
    rows = le.training_table(_turned(spark, d), le.FEATURES)
    return rows.groupBy("split", "step", "label").agg(F.count("*").alias("n"), F.round(F.avg("min_err"), 4).alias("mean_err"))


def feature_projection(spark, d):
    """A chosen subset of the features, in a fixed order, from the long table of names and values."""
    chosen = ["bounce_angle", "speed_deg1", "vel_dot"]
    rows = ft.scalar_features(_turned(spark, d))
    long = rows.select("track_id", "step", "k", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in chosen))))
    wide = long.groupBy("track_id", "step", "k").pivot("name", chosen).agg(F.max("value"))
    return wide.selectExpr("track_id", "step", "k", *(significant(n) for n in chosen))


def feature_completeness(spark, d):
    """Declared features that no row has a value of, and how often the others have one."""
    rows = ft.scalar_features(_turned(spark, d))
    counts = rows.agg(*(F.count(n).alias(n) for n in ft.SCALARS))
    long = counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in ft.SCALARS))))
    declared = spark.createDataFrame([(n,) for n in [*ft.SCALARS, "not_produced"]], "name string")
    lacking = le.missing(long.where("n > 0"), declared)
    return long.where("n > 0").unionByName(lacking.withColumn("n", F.lit(0).cast("long")))


def multiplier_errors(spark, d):
    """Mean error of displacements made of multiples of velocity, acceleration and jerk, in the frame of the motion."""
    rows = shape.local_motion(src.event_poses(spark, d)).drop("track_id", "k")  # rows without a frame are left out where they are counted
    v, a, j = np.array(MULTIPLIERS).T
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(MULTIPLIERS)], "configuration int, v double, a double, j double")
    found = banks.row_means(rows, banks.multiplied(v, a, j), len(MULTIPLIERS)).join(F.broadcast(table), "configuration")
    return found.select("step", "v", "a", "j", F.round("mean_err", 4).alias("mean_err"))


MULTIPLIERS = [(v, a, j) for v in (0.0, 1.0) for a in (0.0, 0.5, 1.0) for j in (0.0, 1.0)]
_parts = ["v * speed + a * acc_along + j * jerk0 - next0", "a * acc_across + j * jerk1 - next1", "j * jerk2 - next2"]
MULTIPLIED = "sqrt(" + " + ".join(f"({p}) * ({p})" for p in _parts) + ")"


def _grown(spark, d):
    """The tree of depth 8 over all scalar features of the training tracks, made smooth, and the test tracks' rows with their bins. The table is written
    once: each level reads it again."""
    features = [le.column(n) for n in ft.SCALARS]
    table = saved(le.training_table(smoothed(_turned(spark, d)), list(ft.SCALARS)).select("track_id", "step", "k", "split", *features, *le.CLASSES))
    rows = saved(tree.sketched(table, features))
    return tree.fit(rows.where("split = 'train'"), features, le.CLASSES, 8), rows.where("split = 'test'"), features


def tree_depth_scores(spark, d):
    """Mean error on test tracks of the tree cut at each depth; depth 0 is the best choice of each row."""
    grown, rows, features = _grown(spark, d)
    return tree.depth_scores(rows, grown, features, le.CLASSES)


def feature_importance(spark, d):
    """The ten features of each step whose dealing out anew raises the tree's error most."""
    grown, rows, features = _grown(spark, d)
    return tree.importance(rows, grown, features, le.CLASSES).where("place < 10")


SPLINE, SINC, SINC_SPLINE = (2, 4, 6), (5.5, 8.0), (2.2, 5, 6, 4.7, 8.0)


def spline_errors(spark, d):
    """Errors of spline fits in four modes and of two tapered-sinc ones, all in one pass."""
    bank = {m: fl.spline_filters(*SPLINE, m) for m in fl.MODES} | {"sinc": fl.sinc_filters(*SINC), "sinc_spline": fl.sinc_spline_filters(*SINC_SPLINE)}
    found = banks.filter_summary(src.event_poses(spark, d), list(bank.values()))
    name = F.element_at(F.array(*map(F.lit, bank)), F.col("configuration") + 1)
    return found.select("step", name.alias("model"), "n", F.round("mean_err", 4).alias("mean_err"), F.round("most", 4).alias("most"))


def spline_sweep(spark, d):
    """Every spline fit of degree 1 to 5, up to 10 control points and 20 poses, in four modes."""
    return banks.spline_sweep(_turned(spark, d))


#: Degree, control points and poses of the fits that spline_metrics looks at.
FITS = [(1, 2, 3), (2, 4, 6), (3, 5, 9)]


def spline_metrics(spark, d):
    """Six metrics of three spline fits in four modes, on positions and rotation vectors: means over tracks of what they are by track."""
    found = banks.spline_sweep(_turned(spark, d), FITS)
    return found.select("step", "mode", "degree", "controls", "inputs", "tracks", *(F.round(m, 4).alias(m) for m in banks.METRICS))


def chosen_bodies(spark, d):
    """Frames of the tracks of a list of bodies."""
    p = src.described(src.event_poses(spark, d)).where(F.col("body_name").isin("3D Touch", "Cat", "Teapot"))
    return p.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))


def track_grid(spark, d):
    """All pairs of body and sequence, and those that have data."""
    pairs = spark.createDataFrame([(b, s, *n) for b, x in enumerate(src.BODIES) for s, y in enumerate(src.SEQUENCES) for n in [(x, y)]], "body int, seq int, body_name string, seq_name string")
    seen = src.tracks(src.event_poses(spark, d)).groupBy("body", "seq").agg(F.count("*").alias("tracks"))
    return pairs.join(seen, ["body", "seq"], "left").select("body", "seq", "body_name", "seq_name", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def _oriented(spark, d) -> DataFrame:
    rows = rotation.oriented(_turned(spark, d))
    return rows.selectExpr("track_id", "frame", "x", "y", "z", "vx", "vy", "vz", "array(" + ", ".join(matrix("r", "q@").values()) + ") AS rot")


def _number(c: str = "track_id"):
    return F.regexp_extract(c, r"track=(\d+)", 1).cast("long").alias("track_id")


def pose_text_round_trip(spark, d):
    """Poses written as text files, of many tracks each, and read again."""
    path = scratch(spark)
    src.write_pose_text(_oriented(spark, d), path)
    back = src.read_pose_text(spark, path, sections=True).select(_number(), "frame", "x", "y", "z", "rot")
    trace = F.col("rot")[0] + F.col("rot")[4] + F.col("rot")[8]
    return back.groupBy("track_id").agg(F.count("*").alias("n"), F.max("frame").alias("last"), F.round(F.sum(F.col("x") * F.col("frame")), 3).alias("moment"), F.round(F.sum(trace), 4).alias("trace"))


def vector_text_round_trip(spark, d):
    """The same with rotations as vectors, whose matrices are made on reading."""
    path = scratch(spark)
    rows = _oriented(spark, d).withColumn("rot", F.array("x", "y", "z")).select("track_id", "frame", F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), "rot")
    src.write_pose_text(rows, path)
    back = src.read_vector_text(spark, path, sections=True).withColumn("track_id", F.regexp_extract("track_id", r"track=(\d+)", 1).cast("long"))
    trace = F.col("rot")[0] + F.col("rot")[4] + F.col("rot")[8]
    return back.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("frame")), 3).alias("moment"), F.round(F.sum(trace), 4).alias("trace"))


def scene_round_trip(spark, d):
    """Poses as scene files, a frame's key and its one object, read again; the keys' gaps."""
    path = scratch(spark)
    rows = _oriented(spark, d).where("frame % 4 <> 3")
    src.write_scene_json(rows, path)
    back = src.read_scene_json(spark, path, sections=True).select(_number(), "frame", "x")
    gap = F.col("frame") - F.lag("frame", 1).over(pr.Window.partitionBy("track_id").orderBy("frame"))
    gaps = back.select("track_id", "x", F.coalesce(gap, F.lit(0)).alias("gap"))
    return gaps.groupBy("track_id").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"), F.max("gap").alias("largest_gap"), F.round(F.sum("x"), 4).alias("sum_x"))


def tracker_files(spark, d):
    """Tracker files of every second track, off by half a unit, against the true poses."""
    path, p = scratch(spark), _oriented(spark, d)
    src.write_pose_text(p.where("track_id % 2 = 0 AND frame % 3 = 1").selectExpr("track_id", "frame", "x + 0.5 * (frame % 2) AS x", "y", "z", "rot"), path)
    back = src.read_pose_text(spark, path, sections=True).select(_number(), "frame", "x", "y", "z")
    return src.with_tracker(p, back, 3).groupBy("track_id").agg(F.count("*").alias("n"), F.count("off").alias("n_tracker"), F.round(F.avg("off"), 5).alias("mean_off"))


def stored_results(spark, d):
    """Scores stored by metric, read again one metric at a time, and compared with the scores of another threshold."""
    path = scratch(spark)
    e = pr.long_errors(pr.errors(src.event_poses(spark, d), ["STATIC", "VEL_DEG1", "ACC_DEG2"]))
    for name, threshold in (("a", 20.0), ("b", 30.0)):
        s = ev.scores(e, threshold).select("track_id", "step", "model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("score", "mean_err")))))
        s.write.partitionBy("metric").option("compression", "zstd").parquet(f"{path}/{name}")
    a, b = (spark.read.parquet(f"{path}/{n}") for n in "ab")
    both = a.join(b.withColumnRenamed("value", "other"), ["track_id", "step", "model", "metric"], "full_outer")
    same = F.sum(F.col("value").eqNullSafe(F.col("other")).cast("long")).alias("same")
    return both.groupBy("metric", "step").agg(F.count("*").alias("n"), same, F.round(F.max(F.abs(F.col("value") - F.col("other"))), 6).alias("largest"))


def arm_movements(spark, d):
    """Movements between still poses: how many poses are in one, how far they have come at most."""
    rows = segments.movements(_still(spark, d))
    return rows.groupBy("track_id", "step").agg(F.count("*").alias("n"), F.sum((F.col("moving") > 0).cast("long")).alias("in_movement"), F.max("moving").alias("longest"))


def _still(spark, d):
    """Poses on a coarse grid, many of which stand still."""
    return src.event_poses(spark, d).select("track_id", "frame", F.floor(F.col("x") / 20).cast("double").alias("x"), F.floor(F.col("y") / 20).cast("double").alias("y"), F.lit(0.0).alias("z"))


def matrix_errors(spark, d):
    """Mean and largest angle off of the rotation nearest to the extrapolated matrix."""
    return segments.matrix_errors(_turned(spark, d)).groupBy("step").agg(F.count("*").alias("n"), F.avg("err").alias("mean_err"), F.max("err").alias("most"))


QUERIES = {
    f.__name__: f
    for f in (
        training_table, label_counts, feature_projection, feature_completeness, multiplier_errors, tree_depth_scores, feature_importance, spline_errors, spline_sweep, spline_metrics,
        chosen_bodies, track_grid, pose_text_round_trip, vector_text_round_trip, scene_round_trip, tracker_files, stored_results,
        arm_movements, matrix_errors,
    )
}

LABELLED = f"""{turned_sql()},
{CURVED},
{ctes([*ft.layers(), *ft.error_layers()], 'qf', 'f')},
e2 AS (SELECT {KEYS}, {', '.join(f'{ft.SCALARS[n]} AS {n}' for n in le.FEATURES)}, {', '.join(f'{e} AS {m}' for m, e in le.class_errors().items())} FROM f WHERE k >= 4),
{ctes(le.label(), 'e2', 'l2')}"""
_table = f"""{LABELLED},
sp AS ({SPLIT}),
tt AS (SELECT * FROM l2 JOIN sp USING (track_id))"""
_features = f"""{turned_sql()},
{ctes(ft.layers(), 'q', 'f')},
s2 AS (SELECT {KEYS}, {', '.join(f'{e} AS {n}' for n, e in ft.SCALARS.items())} FROM f WHERE k >= 4)"""


def _filter_sql(filters, model):
    most = max(filters)
    w = "CASE len(px) " + " ".join(f"WHEN {n} THEN [{', '.join(map(repr, ws))}]" for n, ws in filters.items()) + " END"
    past = ", ".join(f"list({c}) OVER (PARTITION BY track_id, step ORDER BY k ROWS BETWEEN {most} PRECEDING AND 1 PRECEDING) AS p{c}" for c in "xyz")
    off = " + ".join(f"({c} - list_dot_product(p{c}, w)) * ({c} - list_dot_product(p{c}, w))" for c in "xyz")
    return f"SELECT step, '{model}' AS model, sqrt({off}) AS err FROM (SELECT *, {w} AS w FROM (SELECT *, {past} FROM st) WHERE k > 0)"


_filters = {m: fl.spline_filters(*SPLINE, m) for m in fl.MODES} | {"sinc": fl.sinc_filters(*SINC), "sinc_spline": fl.sinc_spline_filters(*SINC_SPLINE)}
_six = ", ".join(f"list({c}) OVER (PARTITION BY track_id, step ORDER BY k ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS p{c}" for c in ("x", "y", "z", "rx", "ry", "rz"))
_fits = ", ".join(
    f"('{m}', {d_}, {c}, {i}, {n}, {[0.0] * (n - len(w)) + list(map(float, w))})" for m in fl.MODES for d_, c, i in FITS for f in [fl.spline_filters(d_, c, i, m)] for n in range(1, 10) for w in [f[min(n, max(f))]]
)
_metrics = f"""{turned_sql()},
{ctes(unwrap_layers('q@'), 'q', 'f')},
pa AS (SELECT track_id, step, k, x, y, z, qw, qx, qy, qz, {_six} FROM f),
fi AS (SELECT * FROM (VALUES {_fits}) f(mode, degree, controls, inputs, n, w)),
m1 AS (SELECT *, {', '.join(f'list_dot_product(p{c}, CAST(w AS DOUBLE[])) AS g{c}' for c in ('x', 'y', 'z', 'rx', 'ry', 'rz'))} FROM pa JOIN fi ON n = len(px) WHERE k > 0),
m2 AS (SELECT *, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy) + (z - gz) * (z - gz)) AS off, sqrt(grx * grx + gry * gry + grz * grz) AS t FROM m1),
m3 AS (SELECT *, 2 * acos(least(1, abs(qw * cos(t / 2) + CASE WHEN t = 0 THEN 0.5 ELSE sin(t / 2) / t END * (qx * grx + qy * gry + qz * grz)))) AS ang FROM m2),
m4 AS (SELECT track_id, step, mode, degree, controls, inputs, avg(CAST(off < 20 AS INT)) AS a, avg(CAST(off < 50 AS INT)) AS b, avg(off) AS c, avg(CAST(ang < radians(2) AS INT)) AS d,
  avg(CAST(ang < radians(5) AS INT)) AS e, avg(ang) AS g FROM m3 GROUP BY ALL)"""
_trace = "(1 - 2 * (qy * qy + qz * qz)) + (1 - 2 * (qx * qx + qz * qz)) + (1 - 2 * (qx * qx + qy * qy))"
#: The poses with their rotations, a row a frame.
_frames = turned_sql().replace(STEPS, POSES + ", st AS (SELECT track_id, 1 AS step, frame AS k, x, y, z FROM p)")
_local = MOTION_SQL["local_motion"].split("\nSELECT ")[0]
_coarse = STEPS.replace("value AS x,", "floor(value / 20) AS x,").replace("CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z", "floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 20) AS y, 0e0 AS z")
SQL = {
    "arm_movements": f"""WITH {_coarse}, {ctes(segments.ARM, 'st', 'f')}
SELECT track_id, step, count(*) AS n, count(*) FILTER (moving > 0) AS in_movement, max(moving) AS longest FROM f GROUP BY ALL""",
    "training_table": f"{_table} SELECT track_id, step, k, split, label, last_label, {', '.join(significant(n) for n in [*le.FEATURES, *le.CLASSES, 'min_err'])} FROM tt",
    "label_counts": f"{_table} SELECT split, step, label, count(*) AS n, round(avg(min_err), 4) AS mean_err FROM tt GROUP BY ALL",
    "feature_projection": f"{_features} SELECT {KEYS}, {', '.join(significant(n) for n in ('bounce_angle', 'speed_deg1', 'vel_dot'))} FROM s2",
    "feature_completeness": f"""{_features}, c2 AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, count({n}) AS n FROM s2" for n in ft.SCALARS)})
SELECT * FROM c2 UNION ALL SELECT 'not_produced', 0""",
    "multiplier_errors": f"""{_local}, mu AS (SELECT * FROM (VALUES {', '.join(map(str, MULTIPLIERS))}) t(v, a, j))
SELECT step, CAST(v AS DOUBLE) AS v, CAST(a AS DOUBLE) AS a, CAST(j AS DOUBLE) AS j, round(avg({MULTIPLIED}), 4) AS mean_err FROM r, mu WHERE jerk2 IS NOT NULL GROUP BY ALL""",
    "spline_errors": f"""WITH {STEPS}, l AS ({' UNION ALL '.join(_filter_sql(f, m) for m, f in _filters.items())})
SELECT step, model, count(*) AS n, round(avg(err), 4) AS mean_err, round(max(err), 4) AS most FROM l GROUP BY ALL""",
    "spline_metrics": f"""{_metrics}
SELECT step, mode, CAST(degree AS INT) AS degree, CAST(controls AS INT) AS controls, CAST(inputs AS INT) AS inputs, count(*) AS tracks, round(avg(a), 4) AS under_20, round(avg(b), 4) AS under_50,
  round(avg(c), 4) AS mean_err, round(avg(d), 4) AS under_2, round(avg(e), 4) AS under_5, round(avg(g), 4) AS mean_angle FROM m4 GROUP BY ALL""",
    "chosen_bodies": f"""WITH {POSES}, {TRACKS} SELECT track_id, count(*) AS n, round(sum(x), 4) AS sum_x FROM p
WHERE track_id IN (SELECT track_id FROM tr WHERE body_name IN ('3D Touch', 'Cat', 'Teapot')) GROUP BY 1""",
    "track_grid": f"""WITH {TRACKS},
b AS (SELECT unnest(range(0, {len(src.BODIES)})) AS body), s AS (SELECT unnest(range(0, {len(src.SEQUENCES)})) AS seq),
n AS (SELECT body, seq, count(*) AS tracks FROM tr GROUP BY ALL)
SELECT CAST(b.body AS INT) AS body, CAST(s.seq AS INT) AS seq, {src.BODIES}[b.body + 1] AS body_name, {src.SEQUENCES}[s.seq + 1] AS seq_name, coalesce(tracks, 0) AS tracks
FROM b CROSS JOIN s LEFT JOIN n ON b.body = n.body AND s.seq = n.seq""",
    "pose_text_round_trip": f"{_frames} SELECT track_id, count(*) AS n, max(k) AS last, round(sum(x * k), 3) AS moment, round(sum({_trace}), 4) AS trace FROM q GROUP BY 1",
    "vector_text_round_trip": f"{_frames} SELECT track_id, count(*) AS n, round(sum(x * k), 3) AS moment, round(sum({_trace}), 4) AS trace FROM q GROUP BY 1",
    "scene_round_trip": f"""WITH {POSES}, g AS (SELECT track_id, x, coalesce(frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame), 0) AS gap FROM p WHERE frame % 4 <> 3)
SELECT track_id, count(*) AS n, CAST(sum(gap) AS BIGINT) AS gaps, max(gap) AS largest_gap, round(sum(x), 4) AS sum_x FROM g GROUP BY 1""",
    "tracker_files": f"""WITH {POSES} SELECT track_id, count(*) AS n, count(*) FILTER (track_id % 2 = 0 AND frame % 3 = 1) AS n_tracker,
round(avg(abs(x + 0.5 * (frame % 2) - x)) FILTER (track_id % 2 = 0 AND frame % 3 = 1), 5) AS mean_off FROM p GROUP BY 1""",
    "stored_results": MOTION_SQL["sweep_metrics"].split(", a AS (")[0] + """,
s AS (SELECT track_id, step, model, avg(CAST(err <= 20 AS INT)) AS a1, avg(CAST(err <= 30 AS INT)) AS b1, avg(err) AS m FROM l WHERE model IN ('STATIC', 'VEL_DEG1', 'ACC_DEG2') GROUP BY ALL),
u AS (SELECT step, 'score' AS metric, a1 AS v, b1 AS w FROM s UNION ALL SELECT step, 'mean_err', m, m FROM s)
SELECT metric, step, count(*) AS n, count(*) FILTER (v = w) AS same, round(max(abs(v - w)), 6) AS largest FROM u GROUP BY ALL""",
}
