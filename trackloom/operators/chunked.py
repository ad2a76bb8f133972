"""Computations along tracks too long for one task.

A track is cut into chunks of its rows. What looks a few rows back is computed within a chunk and copies of the rows just before it; what is carried along the whole
track, sums and last events, is first computed within chunks, then over one summary row a chunk, and put together. The exchanges are by track, step and chunk, so
that a track with most of all rows is spread over all tasks; only the summaries, a row for each ``size`` rows, go by track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layers import ORDER, Layer, apply, arc, dot, each, lags, norm
from .features import STILL, TURN
from .predict import KEYS, down_sampled

SIZE = 100_000
CHUNK = [*KEYS, "chunk"]
BY = "PARTITION BY track_id, step, chunk ORDER BY k"


def numbered(rows: DataFrame, by: list[str], bucket: str, order: list[str], name: str = "frame") -> DataFrame:
    """``rows`` with their number, from 0, among those of ``by`` in the order of ``bucket``, then ``order``; no null in these.

    Rows are numbered within a bucket, and counts of the buckets before are added.
    """
    at = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("n__")).select(*by, bucket, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    return rows.withColumn("at__", at).join(counts, [*by, bucket]).withColumn(name, (F.col("before__") + F.col("at__")).cast("long")).drop("at__", "before__")


def chunked(rows: DataFrame, size: int, history: int) -> DataFrame:
    """``rows`` (track_id, step, k, ..) with chunk and own; the last ``history`` rows of a chunk are there again in the next one, not as its own."""
    if not 0 <= history <= size:
        raise ValueError("a chunk has to hold the history")
    chunk = F.expr(f"k div {size}")
    again = F.when(F.col("k") % size >= size - history, F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own")), F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))))
    return rows.select("*", F.inline(again.otherwise(F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))))))


def within(rows: DataFrame, layers: list[Layer]) -> DataFrame:
    """Layers that look no further back than the history, computed by chunk; the chunks' own rows."""
    return apply(rows, [{n: e.replace(ORDER, f"({BY})") for n, e in layer.items()} for layer in layers]).where("own")


def carried(rows: DataFrame, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with each name's sum or max (its kind) of an expression over all of the track's rows up to this one.

    Sums take null as 0, a max is null until there is a value; of structs it is the one with the largest first field, as for the value at the last event.
    """
    upto = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = rows.selectExpr("*", *(f"{kind}({e}) {upto} AS {n}__in" for n, (kind, e) in totals.items()))
    whole = rows.groupBy(*CHUNK).agg(*(F.expr(f"{kind}({e})").alias(n) for n, (kind, e) in totals.items()))
    earlier = "OVER (PARTITION BY track_id, step ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = whole.selectExpr(*CHUNK, *(f"{kind}({n}) {earlier} AS {n}__before" for n, (kind, _) in totals.items()))
    joined = inside.join(before, CHUNK)
    both = {n: f"coalesce({n}__before, 0) + coalesce({n}__in, 0)" if kind == "sum" else f"greatest({n}__before, {n}__in)" for n, (kind, _) in totals.items()}
    return joined.selectExpr(*rows.columns, *(f"{e} AS {n}" for n, e in both.items()))


#: The move to the pose before the target, v, and the one before that; the acceleration's direction against the one a row earlier.
MOTION: list[Layer] = [
    lags(["x", "y", "z"], 4),
    each("v@", "(@1 - @2)") | each("u@", "(@2 - @3)") | each("a@", "(@1 - 2 * @2 + @3)") | each("b@", "(@2 - 2 * @3 + @4)"),
    {"nv": norm("v@"), "nu": norm("u@"), "na": norm("a@"), "nb": norm("b@"), "uv": dot("u@", "v@"), "ab": dot("a@", "b@")},
    {"turn_cos": "uv / nullif(nu * nv, 0)", "near": "ab / nullif(na * nb, 0)"},
    {"turn": arc("turn_cos")},
]


def since_events(poses: DataFrame, size: int = SIZE) -> DataFrame:
    """(track_id, step, k, still_rows, turn_rows, dist_since_turn, flips, signed), k from 4: rows since the object was still, rows and way since it last turned sharply,
    how often the acceleration has changed sides, and its size with that sign. As in ``features`` and ``orientation``, for tracks of any length.

    Poses are (track_id, frame, x, y, z); what comes out does not depend on ``size``.
    """
    rows = within(chunked(down_sampled(poses).select(*KEYS, "k", "x", "y", "z"), size, 4), MOTION).select(*CHUNK, "k", "nv", "na", "turn", "near")
    still, turned = f"k > 0 AND (k < 2 OR nv < {STILL})", f"k > 0 AND (k < 3 OR coalesce(turn > {TURN}, false))"
    rows = carried(rows, {"way": ("sum", "nv"), "flips": ("sum", "CASE WHEN near < 0 THEN 1L ELSE 0L END")})
    # The way up to a turn leaves out the turn's own move.
    held = f"CASE WHEN {turned} THEN named_struct('k', k, 'way', way - coalesce(nv, 0)) END"
    rows = carried(rows, {"still_at": ("max", f"CASE WHEN {still} THEN k END"), "turn_at": ("max", held)})
    return rows.where("k >= 4").selectExpr(
        *KEYS, "k", "k - still_at AS still_rows", "k - turn_at.k AS turn_rows", "way - turn_at.way AS dist_since_turn", "flips", "CASE WHEN flips % 2 = 1 THEN -na ELSE na END AS signed"
    )
