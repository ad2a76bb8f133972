"""The pose-track queries by name, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import predict as pr
from ..operators.selection import quantiles
from ..sources import poses as src
from ..sources.store import saved

MODELS = [*pr.LINEAR, "VEL_ANG", "VEL_BCS"]
FIVE = ["STATIC", "VEL_DEG1", "VEL_DEG2", "ACC_DEG2", "JERK"]


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or c)


def _poses(spark: SparkSession, d: str) -> DataFrame:
    return src.event_poses(spark, d)


def _long(spark, d, models=MODELS) -> DataFrame:
    return pr.long_errors(pr.errors(_poses(spark, d), models))


def tracks(spark, d):
    return src.tracks(_poses(spark, d))


def valid_tracks(spark, d):
    return src.tracks(_poses(spark, d)).where("NOT is_cam2").groupBy("motion_kind").agg(F.count("*").alias("n"))


def down_sampling(spark, d):
    return pr.down_sampled(_poses(spark, d)).groupBy(*pr.KEYS).agg(F.count("*").alias("n"), F.max("k").alias("last_k"), r6(F.sum("x"), "sum_x"))


def kinematics(spark, d):
    k = pr.kinematics(_poses(spark, d))
    return k.select(*pr.KEYS, "k", *(r6(c) for c in ("speed", "acc", "jerk", "turn", "vel_bcs_ratio")))


def prediction_errors(spark, d):
    return _long(spark, d).select(*pr.KEYS, "k", "model", r6("err"))


def track_scores(spark, d):
    return ev.scores(_long(spark, d)).select("track_id", "step", "model", "n", r6("score"), r6("mean_err"))


def best_models(spark, d):
    return ev.best_model(pr.errors(_poses(spark, d), FIVE), FIVE).select(*pr.KEYS, "k", "model", r6("err"))


def best_model_counts(spark, d):
    return ev.best_model(pr.errors(_poses(spark, d), FIVE), FIVE).groupBy("step", "model").agg(F.count("*").alias("n"), r6(F.avg("err"), "mean_err"))


def previous_best_label(spark, d):
    best = ev.best_model(pr.errors(_poses(spark, d), FIVE), FIVE)
    return best.select(*pr.KEYS, "k", F.lag("ordinal").over(pr.order()).alias("last_label"))


def hindsight_switch(spark, d):
    e = ev.switched(pr.errors(_poses(spark, d), FIVE), FIVE, causal=False)
    return e.groupBy("step").agg(r6(F.avg("err"), "mean_err"))


def causal_switch(spark, d):
    e = ev.switched(pr.errors(_poses(spark, d), FIVE), FIVE, causal=True)
    return e.groupBy("step").agg(r6(F.avg("err"), "mean_err"))


def macro_micro(spark, d):
    return ev.macro_and_micro(_long(spark, d)).select("step", "model", r6("macro"), r6("micro"))


def model_ranking(spark, d):
    means = ev.macro_and_micro(_long(spark, d)).select("step", "model", r6("macro"))
    return ev.ranked(means, "macro", ["step"])


def best_two_models(spark, d):
    return model_ranking(spark, d).where("place < 2")


def score_table(spark, d):
    s = ev.scores(_long(spark, d, FIVE)).join(src.tracks(_poses(spark, d)), "track_id").where("NOT is_cam2")
    return s.groupBy("step", "motion_kind").pivot("model", FIVE).agg(r6(F.avg("score"), "score"))


def mean_error_by_step_and_all(spark, d):
    e = ev.best_model(pr.errors(_poses(spark, d), FIVE), FIVE)
    return e.rollup("step").agg(r6(F.avg("err"), "mean_err"), F.count("*").alias("n"))


def local_errors(spark, d):
    e = ev.local_errors(_poses(spark, d), "VEL_DEG1")
    return e.select(*pr.KEYS, "k", "frame_kind", *(r6(c) for c in ("ex", "ey", "ez")))


def error_statistics(spark, d):
    stats = ev.mean_interval(ev.error_stats(ev.local_errors(_poses(spark, d), "VEL_DEG1").where("frame_kind = 'world'"), ["step"]), "ex")
    names = ["mean_ex", "mean_ey", "std_ex", "var_ez", "cov_ex_ey", "mean_mag", "low", "high"]
    return stats.select("step", "n", *(F.round(n, 4).alias(n) for n in names))


def bounce_sweep(spark, d):
    return ev.bounce_sweep(_poses(spark, d)).select("step", "t", r6("mean_err"))


def since_still(spark, d):
    rows = pr.with_history(pr.down_sampled(_poses(spark, d)), 1)
    rows = rows.select(*pr.KEYS, "k", (F.sqrt((F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2) < 30).alias("still"))
    return pr.since(rows, "still", 2, "rows_since").select(*pr.KEYS, "k", F.col("rows_since").cast("long").alias("rows_since"))


def smoothed(spark, d):
    rows = pr.fir(pr.down_sampled(_poses(spark, d)), [0.5, 0.3, 0.2], "x", "smooth_x")
    return rows.select(*pr.KEYS, "k", r6("smooth_x"))


def frame_gaps(spark, d):
    w = Window.partitionBy("track_id").orderBy("frame")
    # Frames by the day of the track: days without an event are gaps.
    day = F.datediff(F.to_date("ts"), F.min(F.to_date("ts")).over(Window.partitionBy("user_id"))).cast("long")
    kept = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("track_id"), day.alias("frame")).distinct()
    return kept.select("track_id", "frame", (F.col("frame") - F.lag("frame", 1).over(w)).alias("gap")).select("track_id", "frame", F.coalesce("gap", F.lit(0)).alias("gap"))


def sub_sequences(spark, d):
    """Range join: frames and the bounds [low, high) of their track's parts, which meet by tens of frames, so that a frame meets a part or two."""
    p = _poses(spark, d).withColumn("ten", F.expr("frame div 10"))
    bounds = p.groupBy("track_id").agg(F.max("frame").alias("last")).select("track_id", F.explode(F.sequence(F.lit(0), F.expr("last div 20"))).alias("part"))
    bounds = bounds.select("track_id", "part", (F.col("part") * 20).alias("low"), (F.col("part") * 20 + 20).alias("high"))
    bounds = bounds.select("*", F.explode(F.sequence(F.expr("low div 10"), F.expr("(high - 1) div 10"))).alias("ten"))
    joined = p.join(bounds, ["track_id", "ten"]).where("frame >= low AND frame < high")
    return joined.groupBy("track_id", "part").agg(F.count("*").alias("n"), r6(F.avg("x"), "mean_x"))


def tracker_errors(spark, d):
    """Row i of the tracker's copy belongs to frame 1 + 3 i; truth without a tracker row is kept."""
    p = _poses(spark, d)
    calc = p.where("frame % 3 = 1").select("track_id", F.expr("frame div 3").alias("i"), (F.col("x") + 0.5).alias("cx"))
    calc = calc.select("track_id", (F.col("i") * 3 + 1).alias("frame"), "cx")
    both = p.join(calc, ["track_id", "frame"], "left")
    return both.groupBy("track_id").agg(F.count("*").alias("n"), F.count("cx").alias("n_calc"), r6(F.avg(F.abs(F.col("cx") - F.col("x"))), "mean_diff"))


def track_bounds(spark, d):
    p = _poses(spark, d)
    return p.groupBy("track_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n"))


def ratio_distribution(spark, d):
    """Of a ratio: its spread, and the share of rows under some values, which takes no group's values together as a median would."""
    k = pr.kinematics(_poses(spark, d)).where("vel_bcs_ratio IS NOT NULL")
    c = "vel_bcs_ratio"
    under = [r6(F.avg((F.col(c) < t).cast("int")), f"under_{n}") for n, t in (("0", 0.0), ("half", 0.5), ("1", 1.0))]
    return k.groupBy("step").agg(r6(F.avg(c), "mean"), r6(F.min(c), "least"), r6(F.max(c), "most"), r6(F.stddev_pop(c), "std"), *under)


def error_histogram(spark, d):
    """Density of each model's errors in 35 equal bins, up to the largest of the models' 90th percentiles."""
    e = saved(_long(spark, d, FIVE).select("step", "model", "err"))
    ends = quantiles(e, ["step", "model"], "err", 0.9).groupBy("step").agg(F.max("quantile").alias("top"))
    cells = e.join(F.broadcast(ends), "step").where("err >= 0 AND err < top").groupBy("step", "model", "top", F.floor(F.col("err") / F.col("top") * 35).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("step", "model"))
    return cells.select("step", "model", "bin", "n", F.round(F.col("n") / total / (F.col("top") / 35), 6).alias("density"))


def turn_fit(spark, d):
    w = pr.order()
    rows = pr.kinematics(_poses(spark, d)).select("step", F.lag("turn", 2).over(w).alias("a"), F.lag("turn", 1).over(w).alias("b"), F.col("turn").alias("c"))
    rows = rows.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL").select("step", F.floor(F.col("a") / 0.1).cast("int").alias("bin"), "b", "c")
    fits = rows.groupBy("step", "bin").agg(F.count("*").alias("n"), F.regr_slope("c", "b").alias("slope"), F.regr_intercept("c", "b").alias("intercept"))
    return fits.where("n > 1 AND abs(slope) < 2").select("step", "bin", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def standard_scaling(spark, d):
    k = pr.kinematics(_poses(spark, d))
    fitted = k.where("track_id % 5 <> 0").groupBy("step").agg(F.avg("speed").alias("m"), F.stddev_pop("speed").alias("s"))
    return k.join(F.broadcast(fitted), "step").select("track_id", "step", "k", r6((F.col("speed") - F.col("m")) / F.col("s"), "scaled"))


def feature_correlation(spark, d):
    k = pr.kinematics(_poses(spark, d)).where("turn IS NOT NULL AND vel_bcs_ratio IS NOT NULL")
    names = ["speed", "acc", "jerk", "turn", "vel_bcs_ratio"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = k.agg(*(F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs))
    return one.select(F.inline(rows)).select("a", "b", F.round("r", 4).alias("r"), (F.abs("r") > 0.7).alias("collinear"))


def track_split(spark, d):
    """ceil(0.2 n) test and ceil(0.15 n) validation tracks in the order of a hash; the rest trains."""
    return ev.split_groups(_poses(spark, d).select("track_id").distinct(), "track_id")


def compare_results(spark, d):
    """Two stored results: rows on one side only, and the largest difference of each metric; nulls equal nulls.

    The results are the track scores of steps 1 and 2, and of steps 2 and 3 with the threshold at 30.
    """
    e = _long(spark, d, FIVE)
    a = ev.scores(e.where("step < 3")).select("track_id", "step", "model", "score", "mean_err")
    b = ev.scores(e.where("step > 1"), 30.0).select("track_id", "step", "model", F.col("score").alias("score2"), F.col("mean_err").alias("mean_err2"))
    both = a.join(b, ["track_id", "step", "model"], "full_outer")
    left = F.sum(F.when(F.col("score2").isNull(), 1).otherwise(0)).alias("only_left")
    right = F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).alias("only_right")
    return both.agg(left, right, r6(F.max(F.abs(F.col("score") - F.col("score2"))), "score_diff"), r6(F.max(F.abs(F.col("mean_err") - F.col("mean_err2"))), "err_diff"))


def short_names(spark, d):
    t = src.tracks(_poses(spark, d)).select("body_name", "seq_name").distinct()
    cut = F.when(F.length("body_name") < 11, F.col("body_name")).otherwise(F.concat(F.substring("body_name", 1, 8), F.lit("...")))
    word = lambda w: F.concat(F.substring(w, 1, 1), F.when(F.substring(w, -1, 1).isin("1", "2"), F.substring(w, -1, 1)).otherwise(""))
    return t.select("body_name", "seq_name", cut.alias("body_short"), F.array_join(F.transform(F.split("seq_name", "_"), word), "_").alias("seq_short"))


def best_model_per_sequence(spark, d):
    e = _long(spark, d, FIVE).withColumn("seq", (F.col("track_id") % 22).cast("int"))
    sums = e.groupBy("step", "seq", "model").agg(F.sum("err").alias("s"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("step", "seq").orderBy(F.round("s", 6), "model"))
    kept = sums.select("*", first.alias("i")).where("i = 1")
    return kept.select("step", "seq", "model", r6(F.col("s") / F.col("n"), "mean_err"))


QUERIES = {
    f.__name__: f
    for f in (
        tracks, valid_tracks, down_sampling, kinematics, prediction_errors, track_scores, best_models, best_model_counts, previous_best_label,
        hindsight_switch, causal_switch, macro_micro, model_ranking, best_two_models, score_table, mean_error_by_step_and_all, local_errors,
        error_statistics, bounce_sweep, since_still, smoothed, frame_gaps, sub_sequences, tracker_errors, track_bounds, ratio_distribution,
        error_histogram, turn_fit, standard_scaling, feature_correlation, track_split, compare_results, short_names, best_model_per_sequence,
    )
}
