"""Queries on tracks too long for one task, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunked
from .features import significant

#: Rows of a chunk here: the given tables' tracks are short.
ROWS = 256


def hot_poses(spark, d):
    """Poses of five tracks that share all events: a track is an event type, its frames are numbered by days."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("track_id"), F.to_date("ts").alias("day"), "ts", "event_id", "value", "props")
    rows = chunked.numbered(events, ["track_id"], "day", ["ts", "event_id"])
    y, z = F.regexp_extract("props", "([0-9]+)", 1).cast("double"), (F.col("event_id") % 97).cast("double")
    return rows.select("track_id", "frame", F.col("value").alias("x"), y.alias("y"), z.alias("z"))


SINCE = ["dist_since_turn", "signed"]


def long_track_features(spark, d):
    """What is carried along tracks that hold a fifth of all rows each."""
    rows = chunked.since_events(hot_poses(spark, d), ROWS)
    return rows.selectExpr("track_id", "step", "k", "still_rows", "turn_rows", *(significant(n) for n in SINCE), "CAST(flips AS BIGINT) AS flips")


def long_track_summary(spark, d):
    """Of each such track: rows, its longest stretch without rest and without a turn, and how often the acceleration changed sides."""
    rows = chunked.since_events(hot_poses(spark, d), ROWS)
    return rows.groupBy("track_id", "step").agg(
        F.count("*").alias("n"), F.max("still_rows").alias("longest_move"), F.max("turn_rows").alias("longest_straight"), F.max("flips").cast("long").alias("flips")
    )


QUERIES = {f.__name__: f for f in (long_track_features, long_track_summary)}

_w = "(PARTITION BY track_id, step ORDER BY k)"
_upto = "(PARTITION BY track_id, step ORDER BY k ROWS UNBOUNDED PRECEDING)"
_size = lambda a, b: "sqrt(" + "+".join(f"({a.replace('@', c)}) * ({b.replace('@', c)})" for c in "xyz") + ")"
_dot = lambda a, b: "(" + "+".join(f"({a.replace('@', c)}) * ({b.replace('@', c)})" for c in "xyz") + ")"
_v, _u, _a, _b = "@1-@2", "@2-@3", "@1-2*@2+@3", "@2-2*@3+@4"
_long = f"""WITH p AS (
  SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value AS x,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z FROM events),
st AS (SELECT track_id, s AS step, frame // s AS k, x, y, z FROM p, (VALUES (1), (2), (3)) v(s) WHERE frame % s = 0),
l AS (SELECT track_id, step, k, {', '.join(f'lag({c}, {i}) OVER {_w} AS {c}{i}' for i in range(1, 5) for c in 'xyz')} FROM st),
m AS (SELECT track_id, step, k, {_size(_v, _v)} AS nv, {_size(_a, _a)} AS na,
  {_dot(_a, _b)} < 0 AS away, acos(greatest(-1, least(1, {_dot(_u, _v)} / nullif({_size(_u, _u)} * {_size(_v, _v)}, 0)))) AS turn, {_size(_u, _u)} * {_size(_v, _v)} > 0 AS moves FROM l),
e AS (SELECT *, k > 0 AND (k < 2 OR nv < 10) AS still, k > 0 AND (k < 3 OR coalesce(moves AND turn > pi() / 6, false)) AS turned FROM m),
f AS (SELECT *, max(CASE WHEN still THEN k END) OVER {_upto} AS still_at, max(CASE WHEN turned THEN k END) OVER {_upto} AS turn_at, count(*) FILTER (away) OVER {_upto} AS flips FROM e),
g AS (SELECT *, sum(nv) OVER (PARTITION BY track_id, step, turn_at ORDER BY k ROWS UNBOUNDED PRECEDING) AS way FROM f),
r AS (SELECT track_id, step, k, k - still_at AS still_rows, k - turn_at AS turn_rows, way AS dist_since_turn, flips, CASE WHEN flips % 2 = 1 THEN -na ELSE na END AS signed FROM g WHERE k >= 4)"""
SQL = {
    "long_track_features": f"{_long} SELECT track_id, step, k, still_rows, turn_rows, {', '.join(significant(n) for n in SINCE)}, flips FROM r",
    "long_track_summary": f"{_long} SELECT track_id, step, count(*) AS n, max(still_rows) AS longest_move, max(turn_rows) AS longest_straight, max(flips) AS flips FROM r GROUP BY ALL",
}
