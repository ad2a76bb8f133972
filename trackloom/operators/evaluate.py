"""Scores, rankings and statistics of prediction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import Vec, cross, dot, minus, norm, scale, vec
from ..sources.store import saved
from .predict import KEYS, down_sampled, linear, order, with_history

THRESHOLD = 20.0


def scores(long: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """By track, step and model: rows, share of errors up to the threshold, mean error."""
    share = F.avg((F.col("err") <= threshold).cast("double"))
    return long.groupBy("track_id", "step", "model").agg(F.count("*").alias("n"), share.alias("score"), F.avg("err").alias("mean_err"))


def best_model(wide: DataFrame, models: list[str]) -> DataFrame:
    """(track_id, step, k, ordinal, model, err): the model of each row of ``wide`` with the least error; ties to the least ordinal, a null or NaN error never wins."""
    inf = F.lit(float("inf"))
    each = F.array(*(F.struct(F.coalesce(F.nanvl(F.col(m), inf), inf).alias("err"), F.lit(i).alias("ordinal"), F.lit(m).alias("model")) for i, m in enumerate(models)))
    return wide.select(*KEYS, "k", F.array_min(each).alias("b")).select(*KEYS, "k", "b.ordinal", "b.model", "b.err")


def switched(wide: DataFrame, models: list[str], causal: bool) -> DataFrame:
    """Error of switching to the best of ``models``: in hindsight, or the previous row's best; the first row holds."""
    each = F.array(*(F.struct(F.coalesce(F.nanvl(F.col(m), F.lit(float("inf"))), F.lit(float("inf"))).alias("err"), F.lit(i).alias("i")) for i, m in enumerate(models)))
    rows = wide.select(*KEYS, "k", "STATIC", F.array(*models).alias("errs"), F.array_min(each).alias("best"))
    if not causal:
        return rows.select(*KEYS, "k", F.col("best.err").alias("err"))
    last = F.lag("best.i").over(order())
    return rows.select(*KEYS, "k", F.coalesce(F.element_at("errs", last + 1), F.col("STATIC")).alias("err"))


def macro_and_micro(long: DataFrame) -> DataFrame:
    """By step and model: the mean over tracks of their means, and the mean over rows."""
    tracks = long.groupBy("track_id", "step", "model").agg(F.sum("err").alias("s"), F.count("err").alias("n"))
    return tracks.groupBy("step", "model").agg(F.avg(F.col("s") / F.col("n")).alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def ranked(means: DataFrame, value: str, by: list[str]) -> DataFrame:
    """0-based place of each model in its group, the least value first, ties by name."""
    w = Window.partitionBy(*by).orderBy(value, "model")
    return means.withColumn("place", F.row_number().over(w) - 1)


def local_errors(poses: DataFrame, model: str) -> DataFrame:
    """Errors of one model in the world frame and in one along the last velocity and the acceleration's orthogonal part.

    Rows without a velocity, or whose acceleration is along it, have no velocity frame and null coordinates there.
    """
    rows = with_history(down_sampled(poses)).where("k >= 3")
    p = [vec(suffix=str(i)) for i in (1, 2, 3)]
    v = minus(p[0], p[1])
    named = lambda prefix, a: [c.alias(f"{prefix}{n}") for c, n in zip(a, "xyz")]
    rows = rows.select(*KEYS, "k", *named("v", v), *named("a", minus(v, minus(p[1], p[2]))), *named("e", minus(vec(), linear(model))))

    def unit(a: Vec) -> Vec:
        n = norm(a)
        return [F.try_divide(c, n) for c in a]

    # Each axis gets a name of its own, so that it is computed once.
    rows = rows.select("*", *named("u", unit(vec("v"))))
    rows = rows.select("*", *named("c", minus(vec("a"), scale(vec("u"), dot(vec("a"), vec("u"))))))
    rows = rows.select("*", *named("w", unit(vec("c"))))
    err = vec("e")
    local = [dot(err, vec("u")), dot(err, vec("w")), dot(err, cross(vec("u"), vec("w")))]
    names = lambda kind, e: F.struct(F.lit(kind).alias("frame_kind"), *(c.alias(f"e{n}") for n, c in zip("xyz", e)))
    return rows.select(*KEYS, "k", F.inline(F.array(names("world", err), names("velocity", local))))


def error_stats(local: DataFrame, by: list[str]) -> DataFrame:
    """N, means, sample standard deviations, covariances and their determinant, mean magnitude; groups and all of them."""
    cols = ["ex", "ey", "ez"]
    pairs = [("ex", "ey"), ("ex", "ez"), ("ey", "ez")]
    kept = local.where(" AND ".join(f"{c} IS NOT NULL" for c in cols))
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in cols), *(F.stddev_samp(c).alias(f"std_{c}") for c in cols)]
    aggs += [F.var_samp(c).alias(f"var_{c}") for c in cols] + [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs]
    aggs += [F.avg(F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez"))).alias("mean_mag")]
    out = kept.rollup(*by).agg(*aggs)
    xx, yy, zz = (F.col(f"var_{c}") for c in cols)
    xy, xz, yz = (F.col(f"cov_{a}_{b}") for a, b in pairs)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    return out.withColumn("det", det)


def mean_interval(stats: DataFrame, column: str, z: float = 1.959963984540054) -> DataFrame:
    """Confidence interval of a mean; Student's quantile by its series in the normal one, for n > 30 or so."""
    v = (F.col("n") - 1).cast("double")
    t = z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v)
    half = t * F.col(f"std_{column}") / F.sqrt("n")
    mean = F.col(f"mean_{column}")
    return stats.withColumn("low", mean - half).withColumn("high", mean + half)


def score_groups(scores: DataFrame, tracks: DataFrame, bar: str, left_out: list[str]) -> DataFrame:
    """(step, model, grouping, name, tracks, score, place, places_ahead, reaches): mean scores by object, by sequence and of all tracks.

    place is 0 for the best score, ties by name; places_ahead counts from the model ``bar``'s place; reaches tells whether a model reaches that model's
    score in some group of the grouping. Models ``left_out`` and duplicate cameras don't count.
    """
    rows = scores.where(~F.col("model").isin(left_out)).join(tracks, "track_id").where("NOT is_cam2")
    cells = rows.groupBy("step", "model", "body_name", "seq_name").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    groups = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), n.alias("name")) for g, n in (("object", F.col("body_name")), ("sequence", F.col("seq_name")), ("total", F.lit("Avg")))))).alias("g")
    means = cells.select("step", "model", "s", "n", groups).groupBy("step", "model", "g.grouping", "g.name").agg((F.sum("s") / F.sum("n")).alias("raw"), F.sum("n").alias("tracks"))
    means = means.withColumn("score", F.round("raw", 6))
    group = Window.partitionBy("step", "grouping", "name")
    placed = means.withColumn("place", F.row_number().over(group.orderBy(F.desc("score"), "model")) - 1)
    of_bar = lambda c: F.max(F.when(F.col("model") == bar, F.col(c))).over(group)
    placed = placed.select("*", of_bar("score").alias("bar"), (of_bar("place") - F.col("place")).alias("places_ahead"))
    reaches = F.max(F.col("score") >= F.col("bar")).over(Window.partitionBy("step", "grouping", "model"))
    return placed.select("step", "model", "grouping", "name", "tracks", "score", "place", "places_ahead", reaches.alias("reaches"))


def split_groups(rows: DataFrame, key: str, test: float = 0.2, validation: float = 0.15) -> DataFrame:
    """``rows`` with split: all rows of a key together, keys in the order of a hash; ceil of each share of the keys, the rest trains.

    The distinct keys are written once. The order needs no single task: keys are counted in up to 4096 ranges of their hash, ranges before a key's are added up from these counts, and
    keys are numbered within their range.
    """
    h = (F.col(key) * 2654435761) % 4294967296
    keys = saved(rows.select(key).distinct().select(key, h.alias("h__"), F.expr(f"((({key} * 2654435761) % 4294967296) div 1048576)").alias("range__")))
    counts = keys.groupBy("range__").agg(F.count("*").alias("n__"))  # at most 4096 rows
    other = counts.select(F.col("range__").alias("r__"), F.col("n__").alias("m__"))
    before = counts.join(F.broadcast(other), F.expr("r__ < range__"), "left").groupBy("range__").agg(F.coalesce(F.sum("m__"), F.lit(0)).alias("before__"))
    total = counts.agg(F.sum("n__").alias("total__"))
    placed = keys.join(F.broadcast(before), "range__").crossJoin(F.broadcast(total))
    at = F.col("before__") + F.row_number().over(Window.partitionBy("range__").orderBy("h__", key))
    tests = F.ceil(F.col("total__") * test)
    split = F.when(F.col("i__") <= tests, "test").when(F.col("i__") <= tests + F.ceil(F.col("total__") * validation), "validation").otherwise("train")
    return rows.join(placed.select(key, "total__", at.alias("i__")).select(key, split.alias("split")), key)


def _turn_cosine(rows: DataFrame) -> DataFrame:
    p = [vec(suffix=str(i)) for i in (1, 2, 3)]
    v, u = minus(p[0], p[1]), minus(p[1], p[2])
    err = lambda m: norm(minus(vec(), linear(m)))
    return rows.select("step", F.coalesce(F.try_divide(dot(u, v), norm(u) * norm(v)), F.lit(1.0)).alias("cos"), err("ACC_DEG2").alias("quad"), err("VEL_DEG1").alias("vel"))


def bounce_report(poses: DataFrame, thresholds: int = 100) -> DataFrame:
    """(step, way, t, mean_err): ``bounce_sweep``, and the mean errors of velocity alone and of the better one of each frame.

    Rows are grouped by how many thresholds they pass, then thresholds are joined to these few
    groups, so the work does not grow with rows times thresholds.
    """
    rows = _turn_cosine(with_history(down_sampled(poses)).where("k >= 3"))
    passed = F.floor((F.col("cos") + 1) / 2 * thresholds).cast("int")
    cells = rows.groupBy("step", passed.alias("cell")).agg(F.sum("quad").alias("quad"), F.sum("vel").alias("vel"), F.sum(F.least("quad", "vel")).alias("best"), F.count("*").alias("n"))
    ways = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(thresholds)), lambda t: F.struct(F.lit("switch").alias("way"), t.alias("t"), F.when(F.col("cell") < t, F.col("vel")).otherwise(F.col("quad")).alias("s"))),
        F.array(*(F.struct(F.lit(w).alias("way"), F.lit(None).cast("int").alias("t"), F.col(c).alias("s")) for w, c in (("velocity", "vel"), ("best", "best")))),
    )
    return cells.select("step", "n", F.inline(ways)).groupBy("step", "way", "t").agg((F.sum("s") / F.sum("n")).alias("mean_err"))


def bounce_sweep(poses: DataFrame, thresholds: int = 20) -> DataFrame:
    """By step and threshold t: mean error of the quadratic, but velocity where the cosine of the last turn is under t."""
    return bounce_report(poses, thresholds).where("way = 'switch'").select("step", "t", "mean_err")
